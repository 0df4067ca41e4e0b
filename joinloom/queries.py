"""The registered queries of the join engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinloom.plans.builder import Builder
from joinloom.sources.catalog import Catalog

#: Unique columns of the test tables that have one.
PRIMARY_KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey",
    "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id",
    "labels": "doc_id", "benchmark": "item_id",
}
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def register(f: Callable[[Builder], DataFrame]) -> Query:
        QUERIES[name] = run = lambda spark, sf_dir: f(Builder(Catalog(spark, sf_dir, PRIMARY_KEYS)))
        SQL[name] = sql
        return run

    return register


@query("q01_scan_project", "SELECT n_nationkey, n_name FROM nation")
def _(b):
    return b.scan("nation", "n_nationkey", "n_name").compile()


@query("q02_scan_reorder_repeat", "SELECT n_name AS a, n_nationkey AS b, n_nationkey AS c FROM nation")
def _(b):
    return b.scan("nation", "n_name", "n_nationkey", "n_nationkey").compile(["a", "b", "c"])


@query("q03_scan_all_types", "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem")
def _(b):
    return b.scan("lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag").compile()


@query("q04_join_int32", "SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(b):
    left = b.scan("customer", "c_custkey", "c_name", "c_nationkey")
    return left.join(b.scan("nation", "n_nationkey", "n_name"), "c_nationkey = n_nationkey", ["c_custkey", "c_name", "n_name"]).compile()


def _lineitem_orders(b, build_left=False):
    left = b.scan("lineitem", "l_orderkey", "l_linenumber", "l_extendedprice")
    right = b.scan("orders", "o_orderkey", "o_custkey", "o_totalprice")
    return left.join(right, "l_orderkey = o_orderkey", build_left=build_left)


_LO = "SELECT l_orderkey, l_linenumber, l_extendedprice, o_orderkey, o_custkey, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@query("q05_join_int64", _LO)
def _(b):
    return _lineitem_orders(b).compile()


@query("q06_join_fp64", "SELECT a.p_partkey AS a, b.p_partkey AS b, a.p_retailprice AS price FROM part a JOIN part b ON a.p_retailprice = b.p_retailprice WHERE NOT isnan(a.p_retailprice)")
def _(b):
    left, right = (b.scan("part", "p_partkey", "p_retailprice") for _ in range(2))
    return left.join(right, "p_retailprice = p_retailprice", ["#0", "#2", "#1"]).compile(["a", "b", "price"])


@query("q07_join_varchar", "SELECT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON a.text = b.text")
def _(b):
    left, right = (b.scan("documents", "doc_id", "text") for _ in range(2))
    return left.join(right, "text = text", ["#0", "#2"]).compile(["a", "b"])


_SN = "SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey"


def _supplier_nation(b, build_left):
    left = b.scan("supplier", "s_suppkey", "s_name", "s_nationkey")
    rel = left.join(b.scan("nation", "n_nationkey", "n_name"), "s_nationkey = n_nationkey", ["s_suppkey", "s_name", "n_name"], build_left)
    return rel.compile(build="plan")


@query("q08_build_left", _SN)
def _(b):
    return _supplier_nation(b, True)


@query("q09_build_right", _SN)
def _(b):
    return _supplier_nation(b, False)


@query("q10_build_by_cardinality", "SELECT o_orderkey, o_totalprice, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(b):
    left = b.scan("orders", "o_orderkey", "o_totalprice", "o_custkey")
    return left.join(b.scan("customer", "c_custkey", "c_name"), "o_custkey = c_custkey", ["o_orderkey", "o_totalprice", "c_name"]).compile(build="auto")


@query("q11_many_to_many", "SELECT c_custkey, s_suppkey, c_nationkey FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def _(b):
    left = b.scan("customer", "c_custkey", "c_nationkey")
    return left.join(b.scan("supplier", "s_suppkey", "s_nationkey"), "c_nationkey = s_nationkey", ["c_custkey", "s_suppkey", "c_nationkey"]).compile()


@query("q12_null_keys", "SELECT c_custkey, c_nationkey, n_name FROM customer JOIN nation ON nullif(c_nationkey, 0) = nullif(n_nationkey, 0)")
def _(b):
    c = b.catalog
    c.add("customer0", c.read("customer").withColumn("k", F.expr("nullif(c_nationkey, 0)")))
    c.add("nation0", c.read("nation").withColumn("nk", F.expr("nullif(n_nationkey, 0)")))
    left = b.scan("customer0", "c_custkey", "c_nationkey", "k")
    return left.join(b.scan("nation0", "nk", "n_name"), "k = nk", ["c_custkey", "c_nationkey", "n_name"]).compile()


@query("q13_null_payload", "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(b):
    c = b.catalog
    c.add("customer1", c.read("customer").withColumn("seg", F.expr("nullif(c_mktsegment, 'BUILDING')")))
    left = b.scan("customer1", "c_custkey", "seg", "c_nationkey")
    return left.join(b.scan("nation", "n_nationkey", "n_name"), "c_nationkey = n_nationkey", ["c_custkey", "seg", "n_name"]).compile()


@query("q14_no_match", "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_name = r_name")
def _(b):
    left = b.scan("nation", "n_nationkey", "n_name")
    return left.join(b.scan("region", "r_regionkey", "r_name"), "n_name = r_name", ["n_nationkey", "r_regionkey"]).compile()


_CHAIN = ["l_orderkey", "l_linenumber", "o_totalprice", "c_name", "n_name", "r_name"]
_CHAIN_SQL = f"SELECT {', '.join(_CHAIN)} FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _chain_scans(b):
    return (
        b.scan("lineitem", "l_orderkey", "l_linenumber"), b.scan("orders", "o_orderkey", "o_custkey", "o_totalprice"),
        b.scan("customer", "c_custkey", "c_nationkey", "c_name"), b.scan("nation", "n_nationkey", "n_regionkey", "n_name"),
        b.scan("region", "r_regionkey", "r_name"),
    )


def chain(b):
    """Five tables, left-deep."""
    li, o, c, n, r = _chain_scans(b)
    rel = li.join(o, "l_orderkey = o_orderkey").join(c, "o_custkey = c_custkey").join(n, "c_nationkey = n_nationkey")
    return rel.join(r, "n_regionkey = r_regionkey", _CHAIN).compile()


query("q15_linear_chain", _CHAIN_SQL)(chain)


@query("q16_bushy", _CHAIN_SQL.replace(", r_name", "").replace(" JOIN region ON n_regionkey = r_regionkey", ""))
def _(b):
    li, o, c, n, _ = _chain_scans(b)
    left, right = li.join(o, "l_orderkey = o_orderkey"), c.join(n, "c_nationkey = n_nationkey")
    return left.join(right, "o_custkey = c_custkey", _CHAIN[:-1]).compile()


@query("q17_right_deep", _CHAIN_SQL)
def _(b):
    li, o, c, n, r = _chain_scans(b)
    right = c.join(n.join(r, "n_regionkey = r_regionkey"), "c_nationkey = n_nationkey")
    right = o.join(right, "o_custkey = c_custkey")
    return li.join(right, "l_orderkey = o_orderkey", _CHAIN).compile()


@query("q18_table_twice", "SELECT c_custkey, s_suppkey, a.n_name AS c_nation, b.n_name AS s_nation FROM customer JOIN nation a ON c_nationkey = a.n_nationkey JOIN supplier ON a.n_nationkey = s_nationkey JOIN nation b ON s_nationkey = b.n_nationkey")
def _(b):
    left = b.scan("customer", "c_custkey", "c_nationkey").join(b.scan("nation", "n_nationkey", "n_name"), "c_nationkey = n_nationkey", ["c_custkey", "n_nationkey", "n_name"])
    right = b.scan("supplier", "s_suppkey", "s_nationkey").join(b.scan("nation", "n_nationkey", "n_name"), "s_nationkey = n_nationkey", ["s_suppkey", "s_nationkey", "n_name"])
    rel = left.join(right, "n_nationkey = s_nationkey", ["#0", "#3", "#2", "#5"], spread=True)  # last, as it multiplies rows
    return rel.compile(["c_custkey", "s_suppkey", "c_nation", "s_nation"])


@query("q19_key_dropped", "SELECT l_linenumber, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(b):
    left = b.scan("lineitem", "l_orderkey", "l_linenumber")
    return left.join(b.scan("orders", "o_orderkey", "o_totalprice"), "l_orderkey = o_orderkey", ["l_linenumber", "o_totalprice"]).compile()


_DL = "SELECT d.doc_id, d.text, d.source, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id"


def _documents_labels(b, documents="documents"):
    left = b.scan(documents, "doc_id", "text", "source")
    return left.join(b.scan("labels", "doc_id", "quality"), "doc_id = doc_id", ["#0", "#1", "#2", "#4"])


@query("q20_early_strings", _DL)
def _(b):
    return _documents_labels(b).compile(strings="early")


@query("q21_late_strings", _DL)
def _(b):
    return _documents_labels(b).compile(strings="late")


@query("q22_long_strings", f"{_DL} WHERE strlen(d.text) > 8185")
def _(b):
    c = b.catalog
    c.add("long_documents", c.read("documents").filter("octet_length(text) > 8185"), "doc_id")
    return _documents_labels(b, "long_documents").compile(strings="late")


@query("q23_shared_subtree", "SELECT a.c_custkey AS k, a.n_name AS left_nation, b.n_name AS right_nation FROM (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey) a JOIN (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey) b ON a.c_custkey = b.c_custkey")
def _(b):
    shared = b.scan("customer", "c_custkey", "c_nationkey").join(b.scan("nation", "n_nationkey", "n_name"), "c_nationkey = n_nationkey", ["c_custkey", "n_name"])
    return shared.join(shared, "c_custkey = c_custkey", ["#0", "#1", "#3"]).compile(["k", "left_nation", "right_nation"])


@query("q24_skewed_probe", "SELECT event_id, user_id, event_type, c_name FROM events JOIN customer ON user_id = c_custkey")
def _(b):
    left = b.scan("events", "event_id", "user_id", "event_type")
    return left.join(b.scan("customer", "c_custkey", "c_name"), "user_id = c_custkey", ["event_id", "user_id", "event_type", "c_name"]).compile()


@query("q25_partitioned_build", _LO)
def _(b):
    return _lineitem_orders(b).compile(build="shuffle_hash")
