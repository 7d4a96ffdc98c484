"""Queries of the query surface: predicates, projection, expansion, child rows, lookup, paging, budgets."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions.text import truncated
from ledgerlake.operators import query as q
from ledgerlake.operators.changes import number_lines
from ledgerlake.plans.registry import query
from ledgerlake.sources.tables import entity, json_body


@query(
    "query_orders",
    """SELECT o_orderkey, o_totalprice, o_orderdate, c_name AS customer, n_name AS nation
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
    WHERE o_totalprice > 1000 AND contains(c_name, '00') ORDER BY o_totalprice DESC, o_orderkey LIMIT 50""",
)
def query_orders(spark: SparkSession, sf: str) -> DataFrame:
    orders = q.expand(entity(spark, sf, "orders"), entity(spark, sf, "customer"), "o_custkey", "c_custkey", "customer", ["c_name", "c_nationkey"])
    orders = q.expand(orders, entity(spark, sf, "nation"), "customer.c_nationkey", "n_nationkey", "nation", ["n_name"])
    hits = orders.where((F.col("o_totalprice") > 1000) & q.substringof("00", F.col("customer.c_name")))
    top = q.page(hits, [F.desc("o_totalprice"), F.col("o_orderkey")])
    return top.select("o_orderkey", "o_totalprice", "o_orderdate", F.col("customer.c_name").alias("customer"), F.col("nation.n_name").alias("nation"))


#: Predicates on orders: (Spark condition, SQL condition).
PREDICATES = {
    "eq": (lambda: F.col("o_orderpriority") == "1-URGENT", "o_orderpriority = '1-URGENT'"),
    "ne": (lambda: F.col("o_orderstatus") != "F", "o_orderstatus <> 'F'"),
    "gt": (lambda: F.col("o_totalprice") > 200000, "o_totalprice > 200000"),
    "ge": (lambda: F.col("o_orderdate") >= F.lit(datetime(2000, 1, 1)), "o_orderdate >= TIMESTAMP '2000-01-01'"),
    "lt": (lambda: F.lit(50000) > F.col("o_totalprice"), "o_totalprice < 50000"),
    "le": (lambda: F.col("o_orderkey") <= 100, "o_orderkey <= 100"),
    "and_or_not": (lambda: ((F.col("o_orderstatus") == "O") | (F.col("o_totalprice") < 9000)) & ~(F.col("o_orderpriority") == "5-LOW"), "(o_orderstatus = 'O' OR o_totalprice < 9000) AND NOT o_orderpriority = '5-LOW'"),
    "arithmetic": (lambda: (F.col("o_orderkey") % 7 == 3) & (F.col("o_custkey") * 2 - 1 > 500), "o_orderkey % 7 = 3 AND o_custkey * 2 - 1 > 500"),
    "substringof": (lambda: q.substringof("MED", F.col("o_orderpriority")), "contains(o_orderpriority, 'MED')"),
    "startswith": (lambda: F.col("o_orderpriority").startswith("2"), "starts_with(o_orderpriority, '2')"),
    "endswith": (lambda: F.col("o_orderpriority").endswith("GENT"), "ends_with(o_orderpriority, 'GENT')"),
    "dateparts": (lambda: (F.year("o_orderdate") == 1998) & (F.month("o_orderdate") == 2) & (F.day("o_orderdate") > 10), "year(o_orderdate) = 1998 AND month(o_orderdate) = 2 AND day(o_orderdate) > 10"),
    "null": (lambda: F.nullif(F.col("o_orderstatus"), F.lit("P")).isNull(), "nullif(o_orderstatus, 'P') IS NULL"),
    "functions": (lambda: (F.length(F.concat("o_orderstatus", F.substring("o_orderpriority", 3, 3))) == 4) & (F.round(F.col("o_totalprice") / 1000) == 100), "length(o_orderstatus || substr(o_orderpriority, 3, 3)) = 4 AND round(o_totalprice / 1000) = 100"),
}


def _predicate(name: str) -> None:
    condition, sql = PREDICATES[name]

    @query(f"filter_{name}", f"SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE {sql}")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return entity(spark, sf, "orders").where(condition()).select("o_orderkey", "o_custkey", "o_totalprice")


for _name in PREDICATES:
    _predicate(_name)


@query("filter_navigation", "SELECT o_orderkey, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 100000")
def filter_navigation(spark: SparkSession, sf: str) -> DataFrame:
    orders = q.expand(entity(spark, sf, "orders").where("o_totalprice > 100000"), entity(spark, sf, "customer"), "o_custkey", "c_custkey", "customer", ["c_mktsegment"])
    return orders.where(F.col("customer.c_mktsegment") == "BUILDING").select("o_orderkey", F.col("customer.c_mktsegment").alias("segment"))


@query("filter_any", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45 AND l_returnflag = 'R')")
def filter_any(spark: SparkSession, sf: str) -> DataFrame:
    lines = entity(spark, sf, "lineitem").where("l_quantity > 45 and l_returnflag = 'R'")
    return entity(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("expand_two_levels", "SELECT s_suppkey, n_name AS nation, r_name AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def expand_two_levels(spark: SparkSession, sf: str) -> DataFrame:
    rows = q.expand(entity(spark, sf, "supplier"), entity(spark, sf, "nation"), "s_nationkey", "n_nationkey", "nation", ["n_name", "n_regionkey"])
    rows = q.expand(rows, entity(spark, sf, "region"), "nation.n_regionkey", "r_regionkey", "region", ["r_name"])
    return rows.select("s_suppkey", F.col("nation.n_name").alias("nation"), F.col("region.r_name").alias("region"))


@query(
    "composite_reference",
    """WITH r AS (SELECT c_custkey AS id, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier UNION ALL SELECT p_partkey, 'unknown' FROM part)
    SELECT id, kind, coalesce(CASE WHEN kind = 'customer' THEN c_name END, CASE WHEN kind = 'supplier' THEN s_name END) AS name
    FROM r LEFT JOIN customer ON id = c_custkey LEFT JOIN supplier ON id = s_suppkey""",
)
def composite_reference(spark: SparkSession, sf: str) -> DataFrame:
    customer, supplier, part = (entity(spark, sf, t) for t in ("customer", "supplier", "part"))
    refs = customer.select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"))
    refs = refs.unionByName(supplier.select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind"))).unionByName(part.select(F.col("p_partkey").alias("id"), F.lit("unknown").alias("kind")))
    return q.expand_composite(refs, "id", "kind", {"customer": (customer, "c_custkey", "c_name"), "supplier": (supplier, "s_suppkey", "s_name")}, "name")


#: How lines are told apart and ordered.
LINES = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


@query(
    "child_rows",
    """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS line FROM lineitem),
    g AS (SELECT l_orderkey, string_agg(line || ':' || l_partkey, ',' ORDER BY line) AS lines, count(*) AS n FROM l GROUP BY l_orderkey)
    SELECT o_orderkey, coalesce(lines, '') AS lines, coalesce(n, 0)::INT AS n_lines FROM orders LEFT JOIN g ON o_orderkey = l_orderkey""",
)
def child_rows(spark: SparkSession, sf: str) -> DataFrame:
    lines = number_lines(entity(spark, sf, "lineitem"), "l_orderkey", LINES)
    rows = q.child_rows(entity(spark, sf, "orders"), lines, "o_orderkey", "l_orderkey", ["line"], ["line", "l_partkey"], "lines")
    shown = F.array_join(F.transform("lines", lambda r: F.concat_ws(":", r["line"].cast("string"), r["l_partkey"].cast("string"))), ",")
    return rows.select("o_orderkey", shown.alias("lines"), F.size("lines").alias("n_lines"))


@query("key_lookup", "SELECT * FROM customer WHERE c_custkey = 42")
def key_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return q.lookup(entity(spark, sf, "customer"), ["c_custkey"], {"c_custkey": 42})


@query(
    "composite_key_lookup",
    """SELECT l_orderkey, line::INT AS line, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS line FROM lineitem)
    WHERE l_orderkey = 7 AND line = 1""",
)
def composite_key_lookup(spark: SparkSession, sf: str) -> DataFrame:
    lines = number_lines(entity(spark, sf, "lineitem"), "l_orderkey", LINES)
    return q.lookup(lines, ["l_orderkey", "line"], {"l_orderkey": 7, "line": 1}).select("l_orderkey", "line", "l_partkey")


@query("page_skip_top", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20 OFFSET 40")
def page_skip_top(spark: SparkSession, sf: str) -> DataFrame:
    return q.page(entity(spark, sf, "orders"), [F.col("o_orderdate"), F.col("o_orderkey")], top=20, skip=40).select("o_orderkey", "o_orderdate")


@query("inline_count", "SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'O'")
def inline_count(spark: SparkSession, sf: str) -> DataFrame:
    return entity(spark, sf, "orders").where("o_orderstatus = 'O'").agg(F.count("*").alias("total"))


@query(
    "result_budget",
    """SELECT o_orderkey, size::BIGINT AS size FROM (SELECT o_orderkey, sum(length('{"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '"}')) OVER (ORDER BY o_orderkey) AS size FROM orders) WHERE size <= 120000""",
)
def result_budget(spark: SparkSession, sf: str) -> DataFrame:
    return q.fits(entity(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderkey"], 120_000).select("o_orderkey", "size")


@query(
    "result_budget_large_row",
    """WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 AND o_orderkey < 20 THEN repeat('x', 6000) ELSE '' END AS t FROM orders),
    s AS (SELECT o_orderkey, length('{"o_orderkey":' || o_orderkey || ',"t":"' || t || '"}') AS n FROM r)
    SELECT o_orderkey, size::BIGINT AS size FROM (SELECT o_orderkey, sum(n) OVER (ORDER BY o_orderkey) AS size FROM s WHERE o_orderkey >= (SELECT min(o_orderkey) FROM s WHERE n <= 5000)) WHERE size <= 5000""",
)
def result_budget_large_row(spark: SparkSession, sf: str) -> DataFrame:
    """A first row over the budget is skipped; a later one ends the run."""
    key = F.col("o_orderkey")
    large = F.when((key % 2 == 1) & (key < 20), F.repeat(F.lit("x"), 6000)).otherwise(F.lit(""))
    return q.fits(entity(spark, sf, "orders").select("o_orderkey", large.alias("t")), ["o_orderkey"], 5000).select("o_orderkey", "size")


@query("truncate_strings", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '…[' || (length(text) - 200) || ']' ELSE text END AS shown FROM documents")
def truncate_strings(spark: SparkSession, sf: str) -> DataFrame:
    return entity(spark, sf, "documents").select("doc_id", truncated(F.col("text"), 200).alias("shown"))


@query("json_in_string", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_in_string(spark: SparkSession, sf: str) -> DataFrame:
    return json_body(entity(spark, sf, "events").select("event_id", "props"), "props", "k:bigint").select("event_id", F.col("item.k").alias("k"))


@query("null_dates", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END AS at FROM events")
def null_dates(spark: SparkSession, sf: str) -> DataFrame:
    """The first day of the calendar stands for no date."""
    first = F.lit(datetime(1, 1, 1)).cast("timestamp_ntz")
    rows = entity(spark, sf, "events").withColumn("given", F.when(F.col("event_id") % 5 == 0, first).otherwise(F.col("ts")))
    return rows.select("event_id", F.nullif("given", first).alias("at"))
