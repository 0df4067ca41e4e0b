"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

A conversation that was logged after each turn is there many times, as prefixes of
its last snapshot.  A rolling hash of a conversation's first 1, 2, ... turns (the
running XOR of two 64-bit hashes of position, role and text) names every prefix.  An
anti-join removes conversations whose whole hash is a proper prefix of another one;
of equal ones the smallest conv_id stays.  What is left is rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chat_format(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) -> conv_id, n_turns, chat: the maximal
    conversations, each turn rendered as ``<|role|>``, a line end, its text, a line end.

    Turns go by turn, role and text, nulls first, so ties and repeated rows have an
    order; repeated rows are turns each.  A null role is rendered as ``unknown`` and a
    null text as empty; for prefixes they count as these.  A turn with a null conv_id
    is a conversation of its own, which any other that begins with that turn, or equals
    it, replaces; equal ones are one.  A conversation is one row, hence made in one task,
    however long it is.  Other columns are not read.  Empty in, empty out.
    """
    role, text = F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    a, b = F.xxhash64("pos", "role", "text"), F.xxhash64("text", F.lit(7), "role", "pos")
    t = turns.filter("conv_id IS NOT NULL").select("conv_id", "turn", role, text).withColumn("pos", F.row_number().over(order))
    t = t.withColumns({"a": a, "b": b})
    t = t.withColumns({"a": F.bit_xor("a").over(so_far), "b": F.bit_xor("b").over(so_far), "last": F.lead("pos").over(order).isNull()})
    whole = t.filter("last").groupBy("pos", "a", "b").agg(F.min("conv_id").alias("conv_id"))
    prefixes = t.filter("NOT last").select("pos", "a", "b").distinct()
    maximal = whole.join(prefixes, ["pos", "a", "b"], "left_anti").select(F.col("conv_id").alias("kept"))
    kept = t.select("conv_id", "pos", "role", "text").join(maximal, F.col("conv_id") == F.col("kept"), "left_semi")
    piece = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n"))
    chat = kept.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece")))).alias("p"))
    chat = chat.select("conv_id", "n_turns", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("chat"))
    alone = turns.filter("conv_id IS NULL").select("conv_id", role, text).distinct().withColumn("pos", F.lit(1))
    alone = alone.withColumns({"a": a, "b": b}).join(t.filter("pos = 1").select("pos", "a", "b"), ["pos", "a", "b"], "left_anti")
    return chat.unionByName(alone.select("conv_id", F.lit(1).cast("long").alias("n_turns"), piece.alias("chat")))


#: For the query: its rows from the table ``conversations``, which has no null conv_id.
SQL = """
WITH t AS (SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM conversations),
p AS (SELECT *, string_agg(role || chr(30) || text, chr(31)) OVER (PARTITION BY conv_id ORDER BY pos) AS prefix, max(pos) OVER (PARTITION BY conv_id) AS n FROM t),
whole AS (SELECT min(conv_id) AS conv_id, prefix FROM p WHERE pos = n GROUP BY prefix),
kept AS (SELECT conv_id FROM whole WHERE prefix NOT IN (SELECT prefix FROM p WHERE pos < n))
SELECT conv_id, count(*) AS n_turns, string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY pos) AS chat FROM t JOIN kept USING (conv_id) GROUP BY conv_id
"""
