"""Scan with positional projection: reorder, drop or repeat columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

from joinloom.plans.refs import LateRef


def scan(table, attrs, deferred: set[int], uid: int) -> tuple[DataFrame, list]:
    """Only the projected columns are selected, so a Parquet scan reads no others.

    Column names carry ``uid``, which differs for each use of a node, so one
    table scanned twice never gives ambiguous references.
    """
    fields, ref = table.df.columns, f"n{uid}_ref"
    columns, outs = [], []
    for pos, (i, _) in enumerate(attrs):
        if pos in deferred:
            outs.append(LateRef(ref, table, i))
        else:
            outs.append(f"n{uid}_c{pos}")
            columns.append(table.df[fields[i]].alias(outs[-1]))
    if deferred:
        columns.append(table.df[fields[table.primary_key]].alias(ref))
    return table.df.select(*columns), outs


def renamed(df: DataFrame, outs: list, uid: int) -> tuple[DataFrame, list]:
    """The same rows with names that carry ``uid``, for one more use of a node."""
    new = {c: f"n{uid}_c{k}" for k, c in enumerate(df.columns)}
    outs = [LateRef(new[o.ref], o.table, o.column) if isinstance(o, LateRef) else new[o] for o in outs]
    return df.select(*[df[c].alias(n) for c, n in new.items()]), outs
