"""Queries over registers: lines as stock movements, events as records, orders as double entries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.operators import registers as r
from ledgerlake.plans.registry import query
from ledgerlake.sources.tables import entity

START, END = datetime(1998, 1, 1), datetime(1999, 1, 1)
#: The movements in SQL: returned lines are expenses, all others receipts.
M = "(SELECT *, l_quantity::DECIMAL(18,2) AS q, l_returnflag <> 'R' AS receipt, CASE WHEN l_returnflag <> 'R' THEN l_quantity::DECIMAL(18,2) ELSE -l_quantity::DECIMAL(18,2) END AS s FROM lineitem)"
INSIDE = "l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1999-01-01'"
SUMS = "sum(s)::DOUBLE AS turnover, sum(CASE WHEN receipt THEN q ELSE 0 END)::DOUBLE AS receipt, sum(CASE WHEN NOT receipt THEN q ELSE 0 END)::DOUBLE AS expense"


def stock(spark: SparkSession, sf: str) -> r.Register:
    return r.Register(entity(spark, sf, "lineitem"), "l_shipdate", ("l_partkey", "l_suppkey"), ("l_quantity",), F.col("l_returnflag") != "R", ("l_orderkey",))


def plain(df: DataFrame, **names: str) -> DataFrame:
    """Decimals as doubles, columns renamed."""
    return df.select(*(F.col(c).cast("double").alias(names.get(c, c)) if t.startswith("decimal") else F.col(c).alias(names.get(c, c)) for c, t in df.dtypes))


TURNOVER = {"l_quantity_turnover": "turnover", "l_quantity_receipt": "receipt", "l_quantity_expense": "expense"}


@query("balance", f"SELECT l_partkey, l_suppkey, sum(s)::DOUBLE AS balance FROM {M} WHERE l_shipdate < TIMESTAMP '1999-01-01' GROUP BY ALL HAVING sum(s) <> 0")
def balance(spark: SparkSession, sf: str) -> DataFrame:
    return plain(r.balance(stock(spark, sf), END), l_quantity_balance="balance")


@query("balance_condition", f"SELECT l_suppkey, sum(s)::DOUBLE AS balance FROM {M} WHERE l_shipdate < TIMESTAMP '1999-01-01' AND l_partkey < 100 GROUP BY ALL HAVING sum(s) <> 0")
def balance_condition(spark: SparkSession, sf: str) -> DataFrame:
    return plain(r.balance(stock(spark, sf), END, ("l_suppkey",), F.col("l_partkey") < 100), l_quantity_balance="balance")


@query("balance_post_filter", f"SELECT l_partkey, sum(s)::DOUBLE AS balance FROM {M} WHERE l_shipdate < TIMESTAMP '1999-01-01' GROUP BY ALL HAVING sum(s) > 100")
def balance_post_filter(spark: SparkSession, sf: str) -> DataFrame:
    return plain(r.balance(stock(spark, sf), END, ("l_partkey",)).where("l_quantity_balance > 100"), l_quantity_balance="balance")


@query("turnovers", f"SELECT l_partkey, l_suppkey, {SUMS} FROM {M} WHERE {INSIDE} GROUP BY ALL")
def turnovers(spark: SparkSession, sf: str) -> DataFrame:
    return plain(r.turnovers(stock(spark, sf), START, END), **TURNOVER)


@query("turnovers_by_recorder", f"SELECT l_suppkey, l_orderkey, {SUMS} FROM {M} WHERE {INSIDE} GROUP BY ALL")
def turnovers_by_recorder(spark: SparkSession, sf: str) -> DataFrame:
    return plain(r.turnovers(stock(spark, sf), START, END, ("l_suppkey",), by_recorder=True), **TURNOVER)


PERIOD_SQL = {
    **{p: f"date_trunc('{p}', l_shipdate)" for p in ("day", "week", "month", "quarter", "year")},
    "ten_days": "make_timestamp(year(l_shipdate), month(l_shipdate), CASE WHEN day(l_shipdate) <= 10 THEN 1 WHEN day(l_shipdate) <= 20 THEN 11 ELSE 21 END, 0, 0, 0)",
    "half_year": "make_timestamp(year(l_shipdate), CASE WHEN month(l_shipdate) <= 6 THEN 1 ELSE 7 END, 1, 0, 0, 0)",
}


def _by_period(period: str) -> None:
    @query(f"turnovers_by_{period}", f"SELECT l_suppkey, ({PERIOD_SQL[period]})::TIMESTAMP AS period, {SUMS} FROM {M} WHERE {INSIDE} GROUP BY ALL")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return plain(r.turnovers(stock(spark, sf), START, END, ("l_suppkey",), by=period), **TURNOVER)


for _period in PERIOD_SQL:
    _by_period(_period)


def _by_clock(period: str) -> None:
    @query(f"turnovers_by_{period}", f"SELECT event_type, date_trunc('{period}', ts) AS period, sum(value::DECIMAL(18,2))::DOUBLE AS turnover FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-04' GROUP BY ALL")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        reg = r.Register(entity(spark, sf, "events"), "ts", ("event_type",), ("value",), F.lit(True))
        return plain(r.turnovers(reg, datetime(2024, 1, 2), datetime(2024, 1, 4), by=period).drop("value_receipt", "value_expense"), value_turnover="turnover")


for _period in ("second", "minute", "hour"):
    _by_clock(_period)


@query(
    "balance_and_turnovers",
    f"""SELECT l_partkey, sum(CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN s ELSE 0 END)::DOUBLE AS opening,
    sum(CASE WHEN l_shipdate >= TIMESTAMP '1998-01-01' AND receipt THEN q ELSE 0 END)::DOUBLE AS receipt,
    sum(CASE WHEN l_shipdate >= TIMESTAMP '1998-01-01' AND NOT receipt THEN q ELSE 0 END)::DOUBLE AS expense, sum(s)::DOUBLE AS closing
    FROM {M} WHERE l_shipdate < TIMESTAMP '1999-01-01' GROUP BY ALL""",
)
def balance_and_turnovers(spark: SparkSession, sf: str) -> DataFrame:
    return plain(r.balance_and_turnovers(stock(spark, sf), START, END, ("l_partkey",)), **{f"l_quantity_{c}": c for c in ("opening", "receipt", "expense", "closing")})


@query(
    "running_balance",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, (c - s)::DOUBLE AS opening, c::DOUBLE AS closing FROM (SELECT *,
    sum(s) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM {M})""",
)
def running_balance(spark: SparkSession, sf: str) -> DataFrame:
    rows = r.running_balance(stock(spark, sf), ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"], ("l_partkey",))
    return plain(rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity_opening", "l_quantity_closing"), l_quantity_opening="opening", l_quantity_closing="closing")


@query("slice_last", "SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY user_id")
def slice_last(spark: SparkSession, sf: str) -> DataFrame:
    return r.slice_last(entity(spark, sf, "events"), "ts", ["user_id"], ["value"], "event_id", datetime(2024, 1, 15))


@query("slice_first", "SELECT user_id, event_type, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(value, (ts, event_id)) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY user_id, event_type")
def slice_first(spark: SparkSession, sf: str) -> DataFrame:
    return r.slice_first(entity(spark, sf, "events"), "ts", ["user_id", "event_type"], ["value"], "event_id", datetime(2024, 1, 15))


#: Double entries in SQL: an order's price is owed by the customer and earned by its status.
ENTRIES = "(SELECT o_orderdate, 'c' || o_custkey AS account, o_totalprice::DECIMAL(18,2) AS debit, 0::DECIMAL(18,2) AS credit FROM orders UNION ALL SELECT o_orderdate, 's' || o_orderstatus, 0, o_totalprice::DECIMAL(18,2) FROM orders)"


def entries(spark: SparkSession, sf: str) -> DataFrame:
    orders = entity(spark, sf, "orders").withColumns({"debit": F.concat(F.lit("c"), "o_custkey"), "credit": F.concat(F.lit("s"), "o_orderstatus")})
    return r.double_entry(orders, "debit", "credit", "o_totalprice", ["o_orderdate"])


@query("debit_credit_turnovers", f"SELECT account, sum(debit)::DOUBLE AS debit, sum(credit)::DOUBLE AS credit FROM {ENTRIES} GROUP BY account")
def debit_credit_turnovers(spark: SparkSession, sf: str) -> DataFrame:
    return plain(entries(spark, sf).groupBy("account").agg(F.sum("debit").alias("debit"), F.sum("credit").alias("credit")))


@query(
    "trial_balance",
    f"""WITH e AS (SELECT account, sum(CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN debit - credit ELSE 0 END) AS o,
    sum(CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN debit ELSE 0 END) AS d, sum(CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN credit ELSE 0 END) AS k, sum(debit - credit) AS c
    FROM {ENTRIES} WHERE o_orderdate < TIMESTAMP '1999-01-01' GROUP BY account)
    SELECT account, greatest(o, 0)::DOUBLE AS opening_dr, greatest(-o, 0)::DOUBLE AS opening_cr, d::DOUBLE AS turnover_dr, k::DOUBLE AS turnover_cr, greatest(c, 0)::DOUBLE AS closing_dr, greatest(-c, 0)::DOUBLE AS closing_cr FROM e""",
)
def trial_balance(spark: SparkSession, sf: str) -> DataFrame:
    return plain(r.trial_balance(entries(spark, sf), "o_orderdate", START, END))


@query(
    "running_balance_of_hot_items",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus, (c - s)::DOUBLE AS opening, c::DOUBLE AS closing FROM (SELECT *,
    sum(s) OVER (PARTITION BY l_linestatus ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM {M})""",
)
def running_balance_of_hot_items(spark: SparkSession, sf: str) -> DataFrame:
    """Two items with half of all movements each, whose sums are dealt out by months."""
    moves = r.Register(entity(spark, sf, "lineitem"), "l_shipdate", ("l_linestatus",), ("l_quantity",), F.col("l_returnflag") != "R")
    rows = r.running_balance(moves, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], hot_rows=1000)
    return plain(rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", "l_quantity_opening", "l_quantity_closing"), l_quantity_opening="opening", l_quantity_closing="closing")


#: Orders as entries from a customer's account to one of two others, with dimensions: the customer on both sides of even ones, the priority on the debit side of
#: every third, a number that is none on every seventh.
_ENTRIES = "(SELECT *, 'c' || o_custkey % 5 AS dr, CASE WHEN o_orderkey % 2 = 0 THEN '90' ELSE '91' END AS cr FROM orders)"


def dimensioned(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    orders = entity(spark, sf, "orders").withColumn("dr", F.concat(F.lit("c"), (F.col("o_custkey") % 5).cast("string"))).withColumn("cr", F.when(key % 2 == 0, "90").otherwise("91"))
    customer = F.when(key % 7 == 0, "none").otherwise(F.col("o_custkey").cast("string"))
    cell = lambda side, kind, value: F.struct(F.lit(side).alias("side"), F.lit(kind).alias("kind"), value.alias("value"))
    cells = F.concat(F.when(key % 2 == 0, F.array(cell("dr", "customer", customer), cell("cr", "customer", customer))).otherwise(F.array()), F.when(key % 3 == 0, F.array(cell("dr", "priority", F.col("o_orderpriority")))).otherwise(F.array()))
    return r.with_dimensions(orders, "o_orderkey", orders.select("o_orderkey", F.inline(cells)), {"customer": "bigint", "priority": "string"})


_DR_C, _DR_P = "CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 7 <> 0 THEN o_custkey END", "CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END"


@query("entry_dimensions", f"SELECT o_orderkey, dr, cr, {_DR_C} AS dr_customer, {_DR_P} AS dr_priority, {_DR_C} AS cr_customer, NULL::VARCHAR AS cr_priority FROM {_ENTRIES}")
def entry_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    """As many dimensions of either side as an entry has, each of its own type."""
    return dimensioned(spark, sf).select("o_orderkey", "dr", "cr", "dr_customer", "dr_priority", "cr_customer", "cr_priority")


@query(
    "dimension_turnovers",
    f"""WITH e AS (SELECT dr, cr, o_totalprice::DECIMAL(18,2) AS a, ({_DR_C})::VARCHAR AS c, {_DR_P} AS p FROM {_ENTRIES} WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'),
    s AS (SELECT dr AS account, 'customer' AS kind, c AS value, a AS d, 0 AS k FROM e WHERE c IS NOT NULL UNION ALL SELECT dr, 'priority', p, a, 0 FROM e WHERE p IS NOT NULL UNION ALL SELECT dr, NULL, NULL, a, 0 FROM e WHERE c IS NULL AND p IS NULL
      UNION ALL SELECT cr, CASE WHEN c IS NOT NULL THEN 'customer' END, c, 0, a FROM e)
    SELECT account, kind, value, sum(d)::DOUBLE AS turnover_dr, sum(k)::DOUBLE AS turnover_cr FROM s GROUP BY account, kind, value""",
)
def dimension_turnovers(spark: SparkSession, sf: str) -> DataFrame:
    """Two kinds of dimensions on one account, each with turnovers of its own."""
    return plain(r.dimension_turnovers(dimensioned(spark, sf), "dr", "cr", "o_totalprice", ["customer", "priority"], "o_orderdate", START, END))
