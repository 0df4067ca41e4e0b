"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and
returns the columns of ``documents``; the last returns pieces of sequences.  SQL
cannot express the first and the last stage, so there is none for the whole; the
tests run every stage against a brute-force version.

In every stage a null text is empty and is kept, a null doc_id is never taken for another
row's, repeated rows are each kept or each dropped, other columns pass unread whatever
their names, texts are taken whole, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from joinloom.llm.decontaminate import Settings, without_contaminated
from joinloom.llm.line_dedup import deduplicated
from joinloom.llm.minhash import without_near_duplicates
from joinloom.llm.packing import pack
from joinloom.llm.queries import vocabulary
from joinloom.llm.toxicity import without_toxic
from joinloom.llm.workspace import Workspace


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more go; an empty text has the bias's score."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies (by doc_id, then line) of line runs of 50 words or more go, and documents
    that consist of them.  Rows without a doc_id are left as they are."""
    return deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five-word shingles, similarity 0.8) the smallest doc_id stays, with
    all its rows.  Rows without a doc_id or without words are near-duplicates of none."""
    return without_near_duplicates(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or with other parameters, go; items
    without an id are not looked for."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Settings(short=True))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens; an empty text is its end id alone."""
    return pack(docs, vocabulary())


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's rows are written to the shared folder before the next, and
    deleted when that one's are written."""
    work, docs = Workspace(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, work.stage(stage(spark, docs, sf_dir), name)
        work.release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
