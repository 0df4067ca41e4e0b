"""Exact top-k search in Hamming space by incremental multi-index hashing.

A code is cut into m segments, so wide that a value of one is met by about 16 codes: a
probe is a shuffled row and dearer than comparing that many codes.  Segments are indexed
by value.  Codes at distance d share, in some segment, a value within d // m bits.  A step
probes all values that differ from a query's segments in exactly r bits - in all segments
while such values are few, then segment by segment - and verifies the new candidates'
distances.  When a of the segments were searched to r bits and the others to r - 1, all
codes at distances under m * r + a are found.  A query is finished when its kth distance
is under that; only others go on.  Each probe carries the query's kth distance so far, so
a candidate that is farther doesn't leave the join.

Equal codes are one entry with the smallest ids that can matter, and equal queries are
one query, so a vector that very many rows hold is neither a large bucket nor many
searches.  No bucket is capped.
"""

from __future__ import annotations

from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joinloom.llm.workspace import Workspace

#: Bits of a segment at most and at least.
WIDEST, NARROWEST = 20, 4
#: Codes that share a segment's value, as a power of two.
SHARE = 4
#: A step searches all segments while a segment has no more probes than this.
TOGETHER = 600


def segments(bits: int, codes: int) -> tuple[int, int]:
    """How many segments a code has, and how wide they are."""
    wide = min(WIDEST, max(NARROWEST, (max(codes, 2) - 1).bit_length() - SHARE))
    m = -(-bits // wide)
    return m, -(-bits // m)


def binary_code(vector: str | Column, m: int, width: int) -> Column:
    """The signs of a vector's first m * width numbers, an array of m segments; missing
    numbers, null and NaN give 0."""
    v = F.col(vector) if isinstance(vector, str) else vector

    def bit(x: Column) -> Column:
        return F.when((x > 0) & ~F.isnan(x), 1).otherwise(0)

    return F.transform(
        F.sequence(F.lit(0), F.lit(m - 1)),
        lambda s: F.aggregate(F.sequence(F.lit(0), F.lit(width - 1)), F.lit(0), lambda code, i: code * 2 + bit(F.get(v, s * width + i))),
    )


def masks(width: int, radius: int) -> Column:
    """All numbers of ``width`` bits of which ``radius`` are set."""
    every = F.sequence(F.lit(0), F.lit(width - 1))
    out = F.array(F.struct(F.lit(0).alias("m"), F.lit(0).alias("at")))
    for _ in range(radius):  # one more bit, above the last
        out = F.flatten(F.transform(out, lambda x: F.transform(F.slice(every, x["at"] + 1, F.lit(width)), lambda b: F.struct((x["m"] + F.pow(F.lit(2), b).cast("int")).alias("m"), (b + 1).alias("at")))))
    return F.transform(out, lambda x: x["m"])


def _distance(a: str, b: str, m: int) -> Column:
    return reduce(Column.__add__, [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(m)])


def top_k(items: DataFrame, queries: DataFrame, k: int, bits: int | None = None) -> DataFrame:
    """items and queries (vec_id, embedding) -> query_id, rank (from 1), vec_id, distance.

    The k items, other than the query's own vec_id, with the smallest Hamming distance
    between the vectors' sign codes; ties by vec_id.  ``bits``: how many numbers of a
    vector count, by default as many as the longest vector has.  Rows with a null
    vec_id or embedding are neither searched nor found.  Rows with one vec_id: the
    item's nearest code counts; of a query, the smallest code.  Fewer than k other
    items give fewer rows; an empty table gives none.  Other columns are not read.
    """
    spark = items.sparkSession
    work = Workspace(spark, "top-k")
    most = k + 1

    def given(df: DataFrame) -> DataFrame:
        return df.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")

    total, longest = given(items).agg(F.count_distinct("vec_id"), F.max(F.size("embedding"))).first()
    bits = max(1, bits or max(longest or 0, given(queries).agg(F.max(F.size("embedding"))).first()[0] or 0))
    m, width = segments(bits, total)

    def coded(df: DataFrame) -> DataFrame:
        return given(df).select("vec_id", binary_code("embedding", m, width).alias("code"))

    if m * width > bits:
        cut = coded

        def coded(df: DataFrame) -> DataFrame:
            return cut(df.withColumn("embedding", F.slice("embedding", 1, bits)))

    # A code's smallest ids: row_number() <= n limits groups before the shuffle too.
    # Repeated rows of an id are one, or they would take other ids' places.
    by_id = Window.partitionBy("code").orderBy("vec_id")
    ids = coded(items).distinct().withColumn("n", F.row_number().over(by_id)).filter(F.col("n") <= most)
    ids = work.stage(ids.select("code", "vec_id"), "ids")
    codes = ids.select("code").distinct()
    index = work.stage(codes.select("code", F.posexplode("code").alias("segment", "value")), "index")
    asked = work.stage(coded(queries).groupBy("vec_id").agg(F.min("code").alias("code")).withColumnRenamed("vec_id", "query_id"), "queries")
    # kth: of the distances known so far, more than any where there are fewer.
    open_ = work.stage(asked.select(F.col("code").alias("q"), F.lit(bits).alias("kth")).distinct(), "open")
    spread = spark.sparkContext.defaultParallelism
    best = None
    steps = [(r, first, last) for r in range(width + 1) for first, last in ([(0, m)] if comb(width, r) <= TOGETHER else [(i, i + 1) for i in range(m)])]
    for radius, first, last in steps:
        # Queries are few and make many probes each, so they are dealt out first.
        probe = open_.repartition(spread, "q").select("q", "kth", F.posexplode("q").alias("segment", "own")).filter(F.col("segment").between(first, last - 1))
        probe = probe.select("q", "kth", "segment", F.explode(masks(width, radius)).alias("mask"), "own")
        probe = probe.select("q", "kth", "segment", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
        # A code is new where no smaller radius, and at this one no earlier segment, found it.
        # The optimiser takes the probes for as few as the queries; they mustn't be broadcast.
        apart = F.transform(F.arrays_zip(F.col("q").alias("x"), F.col("code").alias("y")), lambda z: F.bit_count(z["x"].bitwiseXOR(z["y"])))
        near = probe.join(index.hint("merge"), ["segment", "value"]).filter(_distance("q", "code", m) <= F.col("kth"))
        near = near.filter((F.array_min(apart) == radius) & (F.array_position(apart, radius) == F.col("segment") + 1))
        found = near.select("q", "code", _distance("q", "code", m).alias("distance")).join(ids, "code").select("q", "vec_id", "distance")
        if best is not None:
            found = found.unionByName(best.join(open_, "q", "left_semi"))
        found = found.groupBy("q", "vec_id").agg(F.min("distance").alias("distance"))
        rank = Window.partitionBy("q").orderBy("distance", "vec_id")
        found = found.withColumn("n", F.row_number().over(rank)).filter(F.col("n") <= most).drop("n")
        found = work.stage(found if best is None else found.unionByName(best.join(open_, "q", "left_anti")), "best")
        known = found.groupBy("q").agg(F.count("*").alias("n"), F.max("distance").alias("d"))
        far = F.when(F.col("n") >= most, F.col("d")).otherwise(F.lit(bits))
        left = open_.select("q").join(known, "q", "left").select("q", far.alias("kth"), F.coalesce("n", F.lit(0)).alias("n"))
        left = left.filter(~(((F.col("n") >= most) & (F.col("kth") < m * radius + last)) | (F.col("n") >= total)))
        before = [x for x in (best, open_) if x is not None]
        best, open_ = found, work.stage(left.select("q", "kth"), "open")
        work.release(*before)
        if open_.isEmpty():
            break
    out = asked.join(best, F.col("code") == F.col("q")).filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return work.result(out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance"))


def sql(k: int, every: int) -> str:
    """For the query: brute force over the table ``embeddings``."""
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS c FROM embeddings),
d AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.c, v.c), lambda z: abs(coalesce(z[1], 0) - coalesce(z[2], 0)))) AS INTEGER) AS distance FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % {every} = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, distance FROM d
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= {k}
"""
