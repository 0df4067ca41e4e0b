import duckdb
import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from joinloom.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), SF, SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_table_twice_deals_its_pairs_over_the_tasks(spark, tmp_path):
    """The pairs of one large nation are made by all tasks, not by as many as its rows' bytes ask for."""
    spark.read.parquet(f"{SF}/nation.parquet").write.parquet(f"{tmp_path}/nation.parquet")
    nation = "IF(id % 10 = 0, cast(id % 25 AS int), 7)"
    spark.range(8000).selectExpr("id AS c_custkey", f"{nation} AS c_nationkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(3000).selectExpr("id AS s_suppkey", f"{nation} AS s_nationkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    df = QUERIES["q18_table_twice"](spark, str(tmp_path))
    made = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert len(made) == 4 and max(made) < 2 * sum(made) / 4
    con = duckdb.connect()
    for t in ("nation", "customer", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    sums = "count(*), CAST(sum(c_custkey * s_suppkey) AS bigint), count(DISTINCT c_custkey * 3000 + s_suppkey), min(c_nation), max(s_nation)"
    df.createOrReplaceTempView("q18_result")
    assert [tuple(spark.sql(f"SELECT {sums} FROM q18_result").first())] == con.execute(f"SELECT {sums} FROM ({SQL['q18_table_twice']})").fetchall()
