"""Runs a query on Spark and its SQL on DuckDB and compares them as bags."""

from collections import Counter
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir, sql):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if Path(sf_dir, f"{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def norm(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(norm, v)) if isinstance(v, list | tuple) else v


def assert_same(df, sf_dir, sql):
    names, rows = duck(sf_dir, sql)
    assert sorted(df.columns) == sorted(names)
    order = [names.index(c) for c in df.columns]
    want = Counter(tuple(norm(r[i]) for i in order) for r in rows)
    got = Counter(tuple(norm(v) for v in r) for r in df.collect())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
