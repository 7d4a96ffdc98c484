"""The recipe book over the business tables, and queries that run its recipes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.operators import registers as r
from ledgerlake.operators.recipes import Book, Param, Recipe
from ledgerlake.plans.register_plans import ENTRIES, M, entries, plain
from ledgerlake.plans.registry import query
from ledgerlake.sources.tables import entity

AT = Param("at", "datetime", required=True)
SPAN = (Param("start", "datetime", required=True), Param("end", "datetime", required=True))


def _stock(tables: dict[str, DataFrame]) -> r.Register:
    return r.Register(tables["lineitem"], "l_shipdate", ("l_partkey", "l_suppkey"), ("l_quantity",), F.col("l_returnflag") != "R")


def _sales(tables: dict[str, DataFrame], key: str) -> r.Register:
    return r.Register(tables["orders"], "o_orderdate", (key,), ("o_totalprice",), F.lit(True))


def stock(t: dict[str, DataFrame], v: dict, where: Column | None) -> DataFrame:
    return plain(r.balance(_stock(t), v["at"], ("l_partkey",), where), l_quantity_balance="balance")


def payables(t: dict[str, DataFrame], v: dict, where: Column | None) -> DataFrame:
    return plain(r.balance(_stock(t), v["at"], ("l_suppkey",), where), l_quantity_balance="balance")


def debtors(t: dict[str, DataFrame], v: dict, where: Column | None) -> DataFrame:
    return plain(r.balance(_sales(t, "o_custkey"), v["at"], None, where), o_totalprice_balance="balance")


def sales(t: dict[str, DataFrame], v: dict, where: Column | None) -> DataFrame:
    return plain(r.turnovers(_sales(t, "o_custkey"), v["start"], v["end"], None, where, by="month").drop("o_totalprice_receipt", "o_totalprice_expense"), o_totalprice_turnover="turnover")


def purchases(t: dict[str, DataFrame], v: dict, where: Column | None) -> DataFrame:
    return plain(r.turnovers(_stock(t), v["start"], v["end"], ("l_suppkey",), where).select("l_suppkey", "l_quantity_receipt"), l_quantity_receipt="receipt")


def settlements(t: dict[str, DataFrame], v: dict, where: Column | None) -> DataFrame:
    return plain(r.balance_and_turnovers(_stock(t), v["start"], v["end"], ("l_suppkey",), where), **{f"l_quantity_{c}": c for c in ("opening", "receipt", "expense", "closing")})


def staff(t: dict[str, DataFrame], v: dict, where: Column | None) -> DataFrame:
    rows = t["events"] if where is None else t["events"].where(where)
    return r.slice_last(rows, "ts", ["user_id"], ["event_type", "value"], "event_id", v["at"])


def register_documents(t: dict[str, DataFrame], v: dict, where: Column | None) -> DataFrame:
    rows = t["orders"].where((F.col("o_orderdate") >= F.lit(v["start"])) & (F.col("o_orderdate") < F.lit(v["end"])))
    rows = rows if where is None else rows.where(where)
    rows = rows.select("o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice").orderBy("o_orderdate", "o_orderkey")
    return rows if v.get("top") is None else rows.limit(v["top"])


def _money(t: dict[str, DataFrame], kinds: tuple[str, ...] = ()) -> r.Register:
    """Events as payments: errors are expenses, the rest receipts; kinds are the accounts of a recipe."""
    rows = t["events"].where(F.col("event_type").isin(*kinds)) if kinds else t["events"]
    return r.Register(rows, "ts", ("user_id", "event_type"), ("value",), F.col("event_type") != "error")


def money(*kinds: str):  # noqa: ANN201
    def build(t: dict[str, DataFrame], v: dict, where: Column | None) -> DataFrame:
        return plain(r.balance(_money(t, kinds), v["at"], ("user_id",), where), value_balance="balance")

    return build


def accruals(t: dict[str, DataFrame], v: dict, where: Column | None) -> DataFrame:
    return plain(r.turnovers(_money(t), v["start"], v["end"], None, where), value_turnover="turnover", value_receipt="accrued", value_expense="withheld")


def salary_settlements(t: dict[str, DataFrame], v: dict, where: Column | None) -> DataFrame:
    return plain(r.balance_and_turnovers(_money(t), v["start"], v["end"], ("user_id",), where), **{f"value_{c}": c for c in ("opening", "receipt", "expense", "closing")})


def event_documents(kind: str):  # noqa: ANN201
    def build(t: dict[str, DataFrame], v: dict, where: Column | None) -> DataFrame:
        rows = t["events"].where((F.col("event_type") == kind) & (F.col("ts") >= F.lit(v["start"])) & (F.col("ts") < F.lit(v["end"])))
        rows = (rows if where is None else rows.where(where)).select("event_id", "ts", "user_id", "value").orderBy("ts", "event_id")
        return rows if v.get("top") is None else rows.limit(v["top"])

    return build


def trial(t: dict[str, DataFrame], v: dict, where: Column | None) -> DataFrame:
    rows = t["orders"] if where is None else t["orders"].where(where)
    debit, credit = F.concat(F.lit("62."), (F.col("o_custkey") % 10).cast("string")), F.concat(F.lit("90."), "o_orderstatus")
    both = r.double_entry(rows.withColumn("__dr", debit).withColumn("__cr", credit), "__dr", "__cr", "o_totalprice", ["o_orderdate"])
    return plain(r.trial_balance(both, "o_orderdate", v["start"], v["end"]))


USER, BY_USER = Param("employee", "int"), ("employee", lambda x: F.col("user_id") == x)
#: Recipes that list documents of one kind, which events stand for.
DOCUMENTS = {"hires": "signup", "dismissals": "error", "vacations": "view", "sick_leaves": "click", "payroll_documents": "purchase"}
LIBRARY = {
    x.name: x
    for x in (
        Recipe("stock", (AT, Param("supplier", "int")), stock, (("supplier", lambda x: F.col("l_suppkey") == x),), ("lineitem",)),
        Recipe("payables", (AT, Param("part_below", "int")), payables, (("part_below", lambda x: F.col("l_partkey") < x),), ("lineitem",)),
        Recipe("debtors", (AT, Param("customer", "int")), debtors, (("customer", lambda x: F.col("o_custkey") == x),), ("orders",)),
        Recipe("sales", (*SPAN, Param("status", "string")), sales, (("status", lambda x: F.col("o_orderstatus") == x),), ("orders",)),
        Recipe("purchases", SPAN, purchases, (), ("lineitem",)),
        Recipe("settlements", SPAN, settlements, (), ("lineitem",)),
        Recipe("staff", (AT, Param("event", "string")), staff, (("event", lambda x: F.col("event_type") == x),), ("events",)),
        Recipe("money_bank", (AT, USER), money("purchase", "view", "error"), (BY_USER,), ("events",)),
        Recipe("money_cash", (AT, USER), money("signup", "click"), (BY_USER,), ("events",)),
        Recipe("salary_debt", (AT, USER), money(), (BY_USER,), ("events",)),
        Recipe("accruals", (*SPAN, USER, Param("kind", "string")), accruals, (BY_USER, ("kind", lambda x: F.col("event_type") == x)), ("events",)),
        Recipe("salary_settlements", (*SPAN, USER), salary_settlements, (BY_USER,), ("events",)),
        *(Recipe(name, (*SPAN, USER, Param("top", "int")), event_documents(kind), (BY_USER,), ("events",)) for name, kind in DOCUMENTS.items()),
        Recipe("trial_balance", (*SPAN, Param("status", "string")), trial, (("status", lambda x: F.col("o_orderstatus") == x),), ("orders",)),
        Recipe("documents_of", (*SPAN, Param("status", "string"), Param("top", "int")), register_documents, (("status", lambda x: F.col("o_orderstatus") == x),), ("orders",)),
    )
}
BOOK = Book(LIBRARY)


def run(spark: SparkSession, sf: str, name: str, **params: object) -> DataFrame:
    recipe = BOOK.get(name)
    return recipe.run({t: entity(spark, sf, t) for t in recipe.needs}, **params)


def _recipe(name: str, sql: str, **params: object) -> None:
    @query(f"recipe_{name}", sql)
    def go(spark: SparkSession, sf: str) -> DataFrame:
        return run(spark, sf, name, **params)


_AT, _START, _END = datetime(1999, 1, 1), datetime(1998, 1, 1), datetime(1999, 1, 1)
_IN = "o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'"
_recipe("stock", f"SELECT l_partkey, sum(s)::DOUBLE AS balance FROM {M} WHERE l_shipdate < TIMESTAMP '1999-01-01' AND l_suppkey = 3 GROUP BY ALL HAVING sum(s) <> 0", at=_AT, supplier=3)
_recipe("payables", f"SELECT l_suppkey, sum(s)::DOUBLE AS balance FROM {M} WHERE l_shipdate < TIMESTAMP '1999-01-01' GROUP BY ALL HAVING sum(s) <> 0", at=_AT, part_below=None)
_recipe("debtors", "SELECT o_custkey, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS balance FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' GROUP BY ALL HAVING sum(o_totalprice::DECIMAL(18,2)) <> 0", at=_AT)
_recipe("sales", f"SELECT o_custkey, date_trunc('month', o_orderdate)::TIMESTAMP AS period, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS turnover FROM orders WHERE {_IN} AND o_orderstatus = 'F' GROUP BY ALL", start=_START, end=_END, status="F")
_recipe("purchases", f"SELECT l_suppkey, sum(CASE WHEN receipt THEN q ELSE 0 END)::DOUBLE AS receipt FROM {M} WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1999-01-01' GROUP BY ALL", start=_START, end=_END)
_recipe(
    "settlements",
    f"""SELECT l_suppkey, sum(CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN s ELSE 0 END)::DOUBLE AS opening, sum(CASE WHEN l_shipdate >= TIMESTAMP '1998-01-01' AND receipt THEN q ELSE 0 END)::DOUBLE AS receipt,
    sum(CASE WHEN l_shipdate >= TIMESTAMP '1998-01-01' AND NOT receipt THEN q ELSE 0 END)::DOUBLE AS expense, sum(s)::DOUBLE AS closing FROM {M} WHERE l_shipdate < TIMESTAMP '1999-01-01' GROUP BY ALL""",
    start=_START,
    end=_END,
)
_recipe("staff", "SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, 'click' AS event_type, arg_max(value, (ts, event_id)) AS value FROM events WHERE event_type = 'click' AND ts <= TIMESTAMP '2024-01-20' GROUP BY user_id", at=datetime(2024, 1, 20), event="click")
_recipe("documents_of", f"SELECT o_orderkey, o_orderdate, o_orderstatus, o_totalprice FROM orders WHERE {_IN} AND o_orderstatus = 'O' ", start=_START, end=_END, status="O")
_V, _S = "value::DECIMAL(18,2)", "CASE WHEN event_type = 'error' THEN -value::DECIMAL(18,2) ELSE value::DECIMAL(18,2) END"
_DAY, _LAST = datetime(2024, 1, 5), datetime(2024, 1, 20)
_BETWEEN = "ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'"


def _balance_of(where: str) -> str:
    return f"SELECT user_id, sum({_S})::DOUBLE AS balance FROM events WHERE ts < TIMESTAMP '2024-01-20' AND {where} GROUP BY user_id HAVING sum({_S}) <> 0"


_recipe("money_bank", _balance_of("event_type IN ('purchase', 'view', 'error')"), at=_LAST)
_recipe("money_cash", _balance_of("event_type IN ('signup', 'click')"), at=_LAST)
_recipe("salary_debt", _balance_of("user_id = 7"), at=_LAST, employee=7)
_recipe("accruals", f"SELECT user_id, event_type, sum({_S})::DOUBLE AS turnover, sum(CASE WHEN event_type <> 'error' THEN {_V} ELSE 0 END)::DOUBLE AS accrued, sum(CASE WHEN event_type = 'error' THEN {_V} ELSE 0 END)::DOUBLE AS withheld FROM events WHERE {_BETWEEN} GROUP BY ALL", start=_DAY, end=_LAST)
_recipe(
    "salary_settlements",
    f"""SELECT user_id, sum(CASE WHEN ts < TIMESTAMP '2024-01-05' THEN {_S} ELSE 0 END)::DOUBLE AS opening, sum(CASE WHEN ts >= TIMESTAMP '2024-01-05' AND event_type <> 'error' THEN {_V} ELSE 0 END)::DOUBLE AS receipt,
    sum(CASE WHEN ts >= TIMESTAMP '2024-01-05' AND event_type = 'error' THEN {_V} ELSE 0 END)::DOUBLE AS expense, sum({_S})::DOUBLE AS closing FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY user_id""",
    start=_DAY,
    end=_LAST,
)
for _name, _kind in DOCUMENTS.items():
    _recipe(_name, f"SELECT event_id, ts, user_id, value FROM events WHERE event_type = '{_kind}' AND {_BETWEEN}", start=_DAY, end=_LAST)
_recipe(
    "trial_balance",
    """WITH e AS (SELECT o_orderdate AS t, o_totalprice::DECIMAL(18,2) AS a, '62.' || o_custkey % 10 AS dr, '90.' || o_orderstatus AS cr FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1999-01-01'),
    s AS (SELECT dr AS account, t, a AS d, 0 AS c FROM e UNION ALL SELECT cr, t, 0, a FROM e),
    g AS (SELECT account, sum(CASE WHEN t < TIMESTAMP '1998-01-01' THEN d - c ELSE 0 END) AS o, sum(CASE WHEN t >= TIMESTAMP '1998-01-01' THEN d ELSE 0 END)::DOUBLE AS turnover_dr, sum(CASE WHEN t >= TIMESTAMP '1998-01-01' THEN c ELSE 0 END)::DOUBLE AS turnover_cr, sum(d - c) AS z FROM s GROUP BY account)
    SELECT account, greatest(o, 0)::DOUBLE AS opening_dr, greatest(-o, 0)::DOUBLE AS opening_cr, turnover_dr, turnover_cr, greatest(z, 0)::DOUBLE AS closing_dr, greatest(-z, 0)::DOUBLE AS closing_cr FROM g""",
    start=_START,
    end=_END,
    status="F",
)


@query("recipe_account_balance", f"SELECT account, greatest(sum(debit - credit), 0)::DOUBLE AS balance_dr, greatest(-sum(debit - credit), 0)::DOUBLE AS balance_cr FROM {ENTRIES} WHERE o_orderdate < TIMESTAMP '1999-01-01' GROUP BY account")
def account_balance(spark: SparkSession, sf: str) -> DataFrame:
    rows = r.trial_balance(entries(spark, sf), "o_orderdate", _AT, _AT).select("account", "closing_dr", "closing_cr")
    return plain(rows, closing_dr="balance_dr", closing_cr="balance_cr")
