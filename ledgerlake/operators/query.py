"""The query surface over entities: expansion, child rows, lookup, paging and budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.errors import EngineError

DEFAULT_TOP, MOST_TOP = 50, 1000
MIN_ROW = 2  # characters of the shortest row's JSON


def substringof(pattern: str, field: Column) -> Column:
    return F.contains(field, F.lit(pattern))


def expand(df: DataFrame, target: DataFrame, key: str, target_key: str, name: str, fields: list[str]) -> DataFrame:
    """df with the struct `name` of the row that key points at, null where there is none. The target's key is unique."""
    right = target.select(F.col(target_key).alias("__key"), F.struct(*fields).alias(name))
    return df.join(right, F.col(key) == F.col("__key"), "left").drop("__key")


def expand_composite(df: DataFrame, key: str, kind: str, targets: dict[str, tuple[DataFrame, str, str]], name: str) -> DataFrame:
    """df with the text that a reference of several kinds points at: kind names the target, each target
    being (table, key, field). One left join for each kind, none for unknown kinds."""
    found = []
    for k, (target, target_key, field) in targets.items():
        right = target.select(F.col(target_key).alias(f"__key_{k}"), F.col(field).alias(f"__text_{k}"))
        df = df.join(right, (F.col(kind) == k) & (F.col(key) == F.col(f"__key_{k}")), "left")
        found.append(f"__text_{k}")
    return df.withColumn(name, F.coalesce(*found)).drop(*found, *(f"__key_{k}" for k in targets))


def child_rows(parents: DataFrame, children: DataFrame, key: str, child_key: str, order: list[str], fields: list[str], name: str) -> DataFrame:
    """parents with the array `name` of their children's fields in order; without children it is empty."""
    lines = children.groupBy(F.col(child_key).alias("__key")).agg(F.sort_array(F.collect_list(F.struct(*order, *(f for f in fields if f not in order)))).alias("__rows"))
    joined = parents.join(lines, F.col(key) == F.col("__key"), "left")
    kept = F.transform("__rows", lambda r: F.struct(*(r[f].alias(f) for f in fields)))
    return joined.withColumn(name, F.coalesce(kept, F.array())).drop("__key", "__rows")


def lookup(df: DataFrame, key: list[str], values: dict) -> DataFrame:
    """The rows with the key. Missing and surplus parts are refused; the message names them, not their values."""
    if set(values) != set(key):
        raise EngineError("params_invalid", f"the key has the parts {', '.join(key)}", "give each of them once")
    return df.where(reduce(lambda a, b: a & b, (F.col(k) == F.lit(values[k]) for k in key)))


def checked_number(name: str, value: object) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise EngineError("params_invalid", f"{name} is a whole number of 0 or more, not {type(value).__name__}")
    return value


def clamped_top(top: int | None, warnings: list[str] | None = None) -> int:
    """top, 50 unless given; over 1000 it is cut to that, which is told in warnings."""
    asked = DEFAULT_TOP if top is None else checked_number("top", top)
    if asked > MOST_TOP and warnings is not None:
        warnings.append(f"top was cut to {MOST_TOP}")
    return min(asked, MOST_TOP)


def page(df: DataFrame, order: list[Column], top: int | None = None, skip: int = 0, warnings: list[str] | None = None) -> DataFrame:
    """At most `top` rows (see clamped_top) after `skip` rows in the order, which has to be total."""
    return df.orderBy(*order).offset(checked_number("skip", skip)).limit(clamped_top(top, warnings))


def page_info(total: int | None, skip: int, count: int, top: int) -> dict:
    more = skip + count < total if total is not None else count == top
    return {"has_more": more, "next_skip": skip + count if more else None}


def fits(df: DataFrame, order: list[str], budget: int) -> DataFrame:
    """The longest run of rows in a total order whose JSON fits the budget, with their running size in `size`. Leading
    rows that are over the budget by themselves are skipped, so that one large row doesn't hide all others.

    A row has at least MIN_ROW characters, so no more than budget / MIN_ROW rows can fit: a top-k of that many by the
    order, taken in every task before any shuffle, is all that sizes are summed over."""
    sized = df.withColumn("__n", F.length(F.to_json(F.struct(*df.columns))))
    large = F.col("__n") > budget
    start = sized.where(~large).orderBy(*order).limit(1).select(*(F.col(c).alias(f"__{c}") for c in order))
    after = F.struct(*order) >= F.struct(*(F.col(f"__{c}") for c in order))
    few = sized.join(F.broadcast(start), after).select(*sized.columns).orderBy(*order).limit(budget // MIN_ROW + 1)
    running = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return few.withColumn("size", F.sum("__n").over(running)).where(F.col("size") <= budget).drop("__n")


def check_order(order: list[str], protected: set[str]) -> None:
    """Sorting by a protected field would tell its values' order."""
    if bad := [f for f in order if f.split("/")[-1] in protected]:
        raise EngineError("params_invalid", f"{', '.join(bad)} can't be sorted by")
