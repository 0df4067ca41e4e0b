"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from joinloom.llm import binary_search, chat, line_dedup, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_minhash_near_dedup")
def op1(spark, sf_dir):
    from joinloom.llm.minhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), shingle=4, percent=80)


@query("op2_token_counts")
def op2(spark, sf_dir):
    from joinloom.llm.token_counts import token_counts

    return token_counts(_read(spark, sf_dir, "documents"), vocabulary(), 512)


@query("op8_packing")
def op8(spark, sf_dir):
    from joinloom.llm.packing import pack

    return pack(_read(spark, sf_dir, "documents"), vocabulary())


@query("op4_quality_classifier")
def op4(spark, sf_dir):
    from joinloom.llm.quality import quality

    return quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


@query("op7_toxicity")
def op7(spark, sf_dir):
    from joinloom.llm.toxicity import toxicity

    return toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


@query("op9_benchmark_decontamination")
def op9(spark, sf_dir):
    from joinloom.llm.decontaminate import Settings, decontaminate

    return decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), Settings(short=True))


@query("op6_line_dedup", line_dedup.SQL)
def op6(spark, sf_dir):
    return line_dedup.line_dedup(_read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "new_text")


@query("op3_url_filters", url_filter.SQL)
def op3(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages")
    return url_filter.url_filter(url_filter.captures_of(pages), url_filter.entries_of(pages)).select("page_id", "blocked", "matched_key")


@query("op5_chat_formatting", chat.SQL)
def op5(spark, sf_dir):
    return chat.chat_format(_read(spark, sf_dir, "conversations"))


#: Neighbours, and which ids are queries (those divisible by it).
NEIGHBOURS, EVERY = 10, 50


@query("op10_exact_top_k_search", binary_search.sql(NEIGHBOURS, EVERY))
def op10(spark, sf_dir):
    vectors = _read(spark, sf_dir, "embeddings")
    return binary_search.top_k(vectors, vectors.filter(f"vec_id % {EVERY} = 0"), NEIGHBOURS)
