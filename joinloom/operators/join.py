"""Inner equi-join on one key with positional projection over left ++ right."""

from __future__ import annotations

from pyspark.sql import DataFrame

from joinloom.functions.keys import not_nan


def inner_equi_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, source: list, positions: list[int], uid: int, nan_free: bool, cells: list[str]) -> tuple[DataFrame, list]:
    """NULL keys match nothing, -0.0 equals 0.0, and with ``nan_free`` NaN matches
    nothing either (Spark alone would match NaN with NaN).  ``cells``: columns of both
    sides that must be equal too.  Columns that no output
    needs are dropped right after the join."""
    condition = left[left_key] == right[right_key]
    if nan_free:
        left, right = left.filter(not_nan(left_key)), right.filter(not_nan(right_key))
        condition = left[left_key] == right[right_key]
    for c in cells:
        condition &= left[c] == right[c]
    joined = left.join(right, condition, "inner")
    columns, outs, refs = [], [], []
    for pos, i in enumerate(positions):
        item = source[i]
        if isinstance(item, str):
            outs.append(f"n{uid}_c{pos}")
            columns.append(joined[item].alias(outs[-1]))
        else:
            outs.append(item)
            refs.append(item.ref)
    return joined.select(*columns, *[joined[r] for r in dict.fromkeys(refs)]), outs
