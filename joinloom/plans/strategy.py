"""How a join's build side is stated to Catalyst.

``auto``  no hint: adaptive execution re-plans on measured bytes.  It broadcasts a
          side that turns out small, and in a session set up by ``tune`` builds hash
          tables on the side whose partitions are measured to fit, else sorts.
``plan``  the side named by the plan: broadcast if the optimiser's estimate of
          it, which counts compressed bytes, is within a quarter of
          ``broadcast_bytes``, else one hash table per shuffle partition.
``shuffle_hash``  as ``plan``, never broadcast.
``sort_merge``  no hash table at all, for sides of which no partition fits memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

POLICIES = ("auto", "plan", "shuffle_hash", "sort_merge")


#: Bytes in memory of a byte in Parquet, at a cautious guess.
MARGIN = 4


def tune(spark: SparkSession, hash_bytes: int = 64 << 20) -> SparkSession:
    """Lets adaptive execution build a hash table where each partition of a side is
    measured to be within ``hash_bytes``."""
    spark.conf.set("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", str(hash_bytes))
    return spark


def estimated_bytes(df: DataFrame) -> int:
    """The optimiser's size estimate of a DataFrame (planning only, no job)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def hinted(left: DataFrame, right: DataFrame, build_left: bool, policy: str, broadcast_bytes: int) -> tuple[DataFrame, DataFrame]:
    if policy == "auto":
        return left, right
    if policy == "sort_merge":
        return left.hint("merge"), right
    side = left if build_left else right
    small = policy == "plan" and MARGIN * estimated_bytes(side) <= broadcast_bytes
    side = side.hint("broadcast" if small else "shuffle_hash")
    return (side, right) if build_left else (left, side)
