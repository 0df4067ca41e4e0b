"""Key predicates, semi-join reduction and cells of a key's pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key on a side of a cell, about.
CELL_ROWS = 512


def not_nan(name: str) -> Column:
    return ~F.isnan(F.col(name))


def semi_reduced(probe: DataFrame, probe_key: str, build: DataFrame, build_key: str) -> DataFrame:
    """The probe rows that have a partner, before a wide probe side is shuffled.

    The counterpart of a pre-check in the hash table's directory; Spark's own
    runtime Bloom filter only fires where the build side has a selective filter.
    """
    keys = build.select(build[build_key].alias("__k")).filter("__k IS NOT NULL").distinct()
    return probe.join(keys, probe[probe_key] == keys["__k"], "left_semi")


def in_cells(left: DataFrame, right: DataFrame, left_key: str, right_key: str, uid: int, rows: int = CELL_ROWS) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides dealt over all shuffle partitions by key and cell, and the names of a cell's two columns there.

    A key with many rows on either side is a grid of cells of about ``rows`` by ``rows`` rows: a row goes to all
    cells of its line, a pair is in one cell only.  So tasks get even shares of a join's output, which grows
    with the product of a key's rows, not of its input; the copies are about 2 / ``rows`` of the output at most,
    and one for each ``rows`` rows where a key has few rows on the other side.  A row's line is the hash of its
    columns, the same on a retry; equal rows share a line.
    """
    i, j = f"n{uid}_i", f"n{uid}_j"
    lines = lambda df, key, name: df.groupBy(df[key].alias(f"{name}_k")).agg(F.ceil(F.count("*") / rows).cast("int").alias(name))
    many = lines(left, left_key, "__p").join(lines(right, right_key, "__q"), F.col("__p_k") == F.col("__q_k"))
    many = many.filter("__p > 1 OR __q > 1").select(F.col("__p_k").alias("__k"), "__p", "__q")

    def dealt(df: DataFrame, key: str, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        columns, line = df.columns, F.coalesce(F.expr(f"pmod(xxhash64({', '.join(df.columns)}), {n_own})"), F.lit(0))
        cells = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n_other), F.lit(1)) - 1))
        df = df.join(many, df[key] == many["__k"], "left").select(*columns, line.cast("int").alias(own), cells.alias(other))
        return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key, i, j)

    return dealt(left, left_key, i, "__p", j, "__q"), dealt(right, right_key, j, "__q", i, "__p"), [i, j]
