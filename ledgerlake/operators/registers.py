"""Registers: balances, turnovers and slices over movements.

A movement has a period, dimensions, a sign (receipt or expense) and resources. A balance at a moment
has the movements before it; turnovers of an interval have those from its start on and before its end.
Conditions given as `where` are on dimensions and come before the sums, so they reach the scan; filter
the result for conditions on resources. All results are one aggregation, or one and a window.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.errors import EngineError

MONEY = "decimal(18,2)"


@dataclass(frozen=True)
class Register:
    movements: DataFrame
    period: str
    dimensions: tuple[str, ...]
    resources: tuple[str, ...]
    receipt: Column
    recorder: tuple[str, ...] = ()

    def rows(self, where: Column | None = None) -> DataFrame:
        return self.movements if where is None else self.movements.where(where)

    def dims(self, chosen: tuple[str, ...] | None) -> list[str]:
        if chosen is None:
            return list(self.dimensions)
        if unknown := [d for d in chosen if d not in self.dimensions]:
            raise EngineError("params_invalid", f"no dimensions: {', '.join(unknown)}")
        return list(chosen)

    def receipts(self, r: str) -> Column:
        return F.when(self.receipt, F.col(r).cast(MONEY)).otherwise(F.lit(0).cast(MONEY))

    def expenses(self, r: str) -> Column:
        return F.when(~self.receipt, F.col(r).cast(MONEY)).otherwise(F.lit(0).cast(MONEY))

    def signed(self, r: str) -> Column:
        return F.when(self.receipt, F.col(r).cast(MONEY)).otherwise(-F.col(r).cast(MONEY))


def _required(**params: object) -> None:
    if missing := [k for k, v in params.items() if v is None]:
        raise EngineError("params_invalid", f"needed: {', '.join(missing)}")


def balance(reg: Register, at: datetime, dimensions: tuple[str, ...] | None = None, where: Column | None = None) -> DataFrame:
    """Dimensions and `<resource>_balance`; rows that are zero throughout are left out."""
    _required(at=at)
    sums = reg.rows(where).where(F.col(reg.period) < F.lit(at)).groupBy(*reg.dims(dimensions)).agg(*(F.sum(reg.signed(r)).alias(f"{r}_balance") for r in reg.resources))
    some = F.lit(False)
    for r in reg.resources:
        some = some | (F.col(f"{r}_balance") != 0)
    return sums.where(some)


#: The start of the period that a moment lies in.
PERIODS = {
    **{p: (lambda p: lambda t: F.date_trunc(p, t))(p) for p in ("second", "minute", "hour", "day", "week", "month", "quarter", "year")},
    "ten_days": lambda t: F.make_timestamp_ntz(F.year(t), F.month(t), F.when(F.day(t) <= 10, 1).when(F.day(t) <= 20, 11).otherwise(21), F.lit(0), F.lit(0), F.lit(0)),
    "half_year": lambda t: F.make_timestamp_ntz(F.year(t), F.when(F.month(t) <= 6, 1).otherwise(7), F.lit(1), F.lit(0), F.lit(0), F.lit(0)),
}


def turnovers(reg: Register, start: datetime, end: datetime, dimensions: tuple[str, ...] | None = None, where: Column | None = None, by: str | None = None, by_recorder: bool = False) -> DataFrame:
    """Dimensions and `<resource>_turnover`, `_receipt`, `_expense`; by: a period, whose start is the column `period`."""
    _required(start=start, end=end)
    rows = reg.rows(where).where((F.col(reg.period) >= F.lit(start)) & (F.col(reg.period) < F.lit(end)))
    keys: list[Column] = [F.col(d) for d in reg.dims(dimensions)]
    if by:
        if by not in PERIODS:
            raise EngineError("params_invalid", "by names no period")
        keys.append(PERIODS[by](F.col(reg.period)).cast("timestamp_ntz").alias("period"))
    keys += [F.col(c) for c in reg.recorder] if by_recorder else []
    sums = [f(r) for r in reg.resources for f in (lambda r: F.sum(reg.signed(r)).alias(f"{r}_turnover"), lambda r: F.sum(reg.receipts(r)).alias(f"{r}_receipt"), lambda r: F.sum(reg.expenses(r)).alias(f"{r}_expense"))]
    return rows.groupBy(*keys).agg(*sums)


def balance_and_turnovers(reg: Register, start: datetime, end: datetime, dimensions: tuple[str, ...] | None = None, where: Column | None = None) -> DataFrame:
    """Opening balance, receipts, expenses and closing balance of each resource in one pass."""
    _required(start=start, end=end)
    early, inside = F.col(reg.period) < F.lit(start), F.col(reg.period) >= F.lit(start)
    zero = F.lit(0).cast(MONEY)
    sums = []
    for r in reg.resources:
        sums += [
            F.sum(F.when(early, reg.signed(r)).otherwise(zero)).alias(f"{r}_opening"),
            F.sum(F.when(inside, reg.receipts(r)).otherwise(zero)).alias(f"{r}_receipt"),
            F.sum(F.when(inside, reg.expenses(r)).otherwise(zero)).alias(f"{r}_expense"),
            F.sum(reg.signed(r)).alias(f"{r}_closing"),
        ]
    return reg.rows(where).where(F.col(reg.period) < F.lit(end)).groupBy(*reg.dims(dimensions)).agg(*sums)


#: An item with more rows than HOT_ROWS and one in HOT_SHARE of all has its sums dealt out by blocks of time.
HOT_ROWS, HOT_SHARE = 1_000_000, 200


def _same_items(dims: list[str]) -> Column:
    same = F.lit(True)
    for c in dims:
        same = same & F.col(c).eqNullSafe(F.col(f"__d_{c}"))
    return same


def running_balance(reg: Register, order: list[str], dimensions: tuple[str, ...] | None = None, where: Column | None = None, block: str = "month", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Movements with `<resource>_opening` and `_closing` of their dimensions, in order of period and `order`.

    An item's movements are summed in one task, but for those of hot items, of which there are HOT_SHARE at most: their sums are
    taken within blocks of time (day, month, year) and over the blocks' totals, so they are dealt out to as many tasks as an item has blocks."""
    dims = reg.dims(dimensions)
    rows = reg.rows(where)
    sizes = rows.groupBy(*dims).agg(F.count("*").alias("__n"))
    most, total = sizes.agg(F.max("__n"), F.sum("__n")).first()
    limit = max(hot_rows, (total or 0) // HOT_SHARE)
    if (most or 0) <= limit:
        return _running(reg, rows, dims, order)
    hot = F.broadcast(sizes.where(F.col("__n") > limit).select(*(F.col(c).alias(f"__d_{c}") for c in dims)))
    rest = _running(reg, rows.join(hot, _same_items(dims), "left_anti"), dims, order)
    return rest.unionByName(_running_in_blocks(reg, rows.join(hot, _same_items(dims), "left_semi"), dims, order, block))


def _running(reg: Register, rows: DataFrame, dims: list[str], order: list[str]) -> DataFrame:
    upto = Window.partitionBy(*dims).orderBy(reg.period, *order).rowsBetween(Window.unboundedPreceding, 0)
    for r in reg.resources:
        rows = rows.withColumn(f"{r}_closing", F.sum(reg.signed(r)).over(upto)).withColumn(f"{r}_opening", F.col(f"{r}_closing") - reg.signed(r))
    return rows


def _running_in_blocks(reg: Register, rows: DataFrame, dims: list[str], order: list[str], block: str) -> DataFrame:
    rows = rows.withColumn("__block", F.date_trunc(block, F.col(reg.period)))
    totals = rows.groupBy(*dims, "__block").agg(*(F.sum(reg.signed(r)).alias(f"__t_{r}") for r in reg.resources))
    earlier = Window.partitionBy(*dims).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        *(F.col(c).alias(f"__d_{c}") for c in dims),
        F.col("__block").alias("__b"),
        *(F.coalesce(F.sum(f"__t_{r}").over(earlier), F.lit(0)).alias(f"__before_{r}") for r in reg.resources),
    )
    upto = Window.partitionBy(*dims, "__block").orderBy(reg.period, *order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(before, F.col("__block").eqNullSafe(F.col("__b")) & _same_items(dims))
    for r in reg.resources:
        out = out.withColumn(f"{r}_closing", F.col(f"__before_{r}") + F.sum(reg.signed(r)).over(upto)).withColumn(f"{r}_opening", F.col(f"{r}_closing") - reg.signed(r))
    return out.drop("__block", "__b", *(f"__d_{c}" for c in dims), *(f"__before_{r}" for r in reg.resources))


def slice_last(df: DataFrame, period: str, dimensions: list[str], values: list[str], tie: str, at: datetime | None = None) -> DataFrame:
    """The last record of each combination of dimensions at a moment, itself included. By partial aggregation, so hot keys don't hurt."""
    rows = df if at is None else df.where(F.col(period) <= F.lit(at))
    best = F.max_by(F.struct(period, tie, *values), F.struct(period, tie)).alias("__best")
    return rows.groupBy(*dimensions).agg(best).select(*dimensions, *(F.col(f"__best.{c}").alias(c) for c in (period, tie, *values)))


def slice_first(df: DataFrame, period: str, dimensions: list[str], values: list[str], tie: str, since: datetime | None = None) -> DataFrame:
    rows = df if since is None else df.where(F.col(period) >= F.lit(since))
    best = F.min_by(F.struct(period, tie, *values), F.struct(period, tie)).alias("__best")
    return rows.groupBy(*dimensions).agg(best).select(*dimensions, *(F.col(f"__best.{c}").alias(c) for c in (period, tie, *values)))


def double_entry(df: DataFrame, debit: str, credit: str, amount: str, keep: list[str]) -> DataFrame:
    """Two rows for each entry: (account, debit, credit, *keep)."""
    zero = F.lit(0).cast(MONEY)
    sides = F.array(
        F.struct(F.col(debit).cast("string").alias("account"), F.col(amount).cast(MONEY).alias("debit"), zero.alias("credit")),
        F.struct(F.col(credit).cast("string").alias("account"), zero.alias("debit"), F.col(amount).cast(MONEY).alias("credit")),
    )
    return df.select(*keep, F.inline(sides))


def trial_balance(entries: DataFrame, period: str, start: datetime, end: datetime) -> DataFrame:
    """Opening, turnover and closing of each account, by side, from rows of double_entry."""
    early = F.col(period) < F.lit(start)
    zero = F.lit(0).cast(MONEY)
    net = F.col("debit") - F.col("credit")
    sums = entries.where(F.col(period) < F.lit(end)).groupBy("account").agg(
        F.sum(F.when(early, net).otherwise(zero)).alias("o"),
        F.sum(F.when(early, zero).otherwise(F.col("debit"))).alias("turnover_dr"),
        F.sum(F.when(early, zero).otherwise(F.col("credit"))).alias("turnover_cr"),
        F.sum(net).alias("c"),
    )
    side = lambda c, n: [F.greatest(F.col(c), F.lit(0)).alias(f"{n}_dr"), F.greatest(-F.col(c), F.lit(0)).alias(f"{n}_cr")]
    return sums.select("account", *side("o", "opening"), "turnover_dr", "turnover_cr", *side("c", "closing"))


def with_dimensions(entries: DataFrame, entry: str, values: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """entries with a column for each kind of extended dimension: kinds are kind -> Spark type. values has (entry, side, kind, value), side being `dr` or
    `cr`, a row for each dimension that an entry's account has on that side: as many as it likes, and none is as well. The columns are `<side>_<kind>`, null
    where the account has no such dimension; a value that isn't of its kind's type is null too. Of two values of one kind the smaller counts."""
    cells = [F.min(F.when((F.col("side") == side) & (F.col("kind") == kind), F.col("value"))).alias(f"{side}_{kind}") for side in ("dr", "cr") for kind in kinds]
    wide = values.groupBy(F.col(entry).alias("__entry")).agg(*cells)
    typed = wide.select("__entry", *(F.expr(f"try_cast(`{side}_{kind}` as {dtype})").alias(f"{side}_{kind}") for side in ("dr", "cr") for kind, dtype in kinds.items()))
    return entries.join(typed, F.col(entry) == F.col("__entry"), "left").drop("__entry")


def dimension_turnovers(entries: DataFrame, debit: str, credit: str, amount: str, kinds: list[str], period: str, start: datetime, end: datetime) -> DataFrame:
    """(account, kind, value, turnover_dr, turnover_cr) from rows of with_dimensions(): what went over each account by each value of each kind that it has. An
    entry counts once for each kind of its side; those without a dimension of any kind count under a null kind and value."""
    zero = F.lit(0).cast(MONEY)
    money = F.col(amount).cast(MONEY)

    def side(name: str, account: str) -> Column:
        cell = lambda kind, value: F.struct(F.col(account).cast("string").alias("account"), kind.alias("kind"), value.alias("value"), (money if name == "dr" else zero).alias("dr"), (money if name == "cr" else zero).alias("cr"))
        none = F.lit(None).cast("string")
        held = F.filter(F.array(*(F.when(F.col(f"{name}_{k}").isNotNull(), cell(F.lit(k), F.col(f"{name}_{k}").cast("string"))) for k in kinds)), lambda x: x.isNotNull())
        return F.when(F.size(held) > 0, held).otherwise(F.array(cell(none, none)))

    rows = entries.where((F.col(period) >= F.lit(start)) & (F.col(period) < F.lit(end)))
    cells = rows.select(F.inline(F.concat(side("dr", debit), side("cr", credit))))
    return cells.groupBy("account", "kind", "value").agg(F.sum("dr").alias("turnover_dr"), F.sum("cr").alias("turnover_cr"))
