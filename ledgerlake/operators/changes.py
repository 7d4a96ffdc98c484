"""Changes: differences of row sets, line numbers, fingerprints, verification, the journal, undo, limits and permissions."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ledgerlake.errors import EngineError

WINDOW_SECONDS = 600


def row_diff(before: DataFrame, after: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """(key, change, field, old, new): added and removed rows once each, changed fields of the others once each."""
    b = before.select(*(F.col(k).alias(f"b_{k}") for k in key), F.struct(*(F.col(f).cast("string").alias(f) for f in fields)).alias("__old"))
    a = after.select(*(F.col(k).alias(f"a_{k}") for k in key), F.struct(*(F.col(f).cast("string").alias(f) for f in fields)).alias("__new"))
    same = None
    for k in key:
        one = F.col(f"b_{k}") == F.col(f"a_{k}")
        same = one if same is None else same & one
    both = b.join(a, same, "full_outer").select(*(F.coalesce(f"b_{k}", f"a_{k}").alias(k) for k in key), "__old", "__new")
    none = F.lit(None).cast("string")
    row = lambda change, f, old, new: F.struct(F.lit(change).alias("change"), f.alias("field"), old.alias("old"), new.alias("new"))
    cells = F.filter(F.array(*(F.when(~F.col(f"__old.{f}").eqNullSafe(F.col(f"__new.{f}")), row("changed", F.lit(f), F.col(f"__old.{f}"), F.col(f"__new.{f}"))) for f in fields)), lambda x: x.isNotNull())
    changes = F.when(F.col("__old").isNull(), F.array(row("added", none, none, none))).when(F.col("__new").isNull(), F.array(row("removed", none, none, none))).otherwise(cells)
    return both.select(*key, F.inline(changes))


def number_lines(df: DataFrame, key: str, order: list[str], name: str = "line") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def line_numbers_ok(df: DataFrame, key: str, line: str) -> DataFrame:
    """(key, ok): whether a key's line numbers are exactly 1 to their count."""
    return df.groupBy(key).agg(((F.count(line) == F.count("*")) & (F.min(line) == 1) & (F.max(line) == F.count("*")) & (F.count_distinct(line) == F.count("*"))).alias("ok"))


def fingerprint(fields: list[str]) -> Column:
    """SHA-256 of the fields as JSON with sorted names: what optimistic locking compares."""
    return F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256)


def same_value(a: Column, b: Column, numeric: bool) -> Column:
    """Whether two values mean the same: numbers, where one of the sides is of a numeric type, by value; GUIDs in any case; the rest, codes with digits
    too, as text. Nulls are the same as nulls only."""
    x, y = a.cast("string"), b.cast("string")
    guid = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
    text = F.coalesce(F.when(x.rlike(guid) & y.rlike(guid), F.lower(x) == F.lower(y)), x.eqNullSafe(y))
    if not numeric:
        return text
    number = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
    plain = r"^\s*[+-]?\d{1,20}(\.\d{0,16})?\s*$"
    exact = lambda c: F.trim(c).cast("decimal(38,16)")
    numbers = F.when(x.rlike(plain) & y.rlike(plain), exact(x) == exact(y)).when(x.rlike(number) & y.rlike(number), x.cast("double") == y.cast("double"))
    return F.coalesce(numbers, text)


def mismatches(sent: DataFrame, stored: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """(key, field) of each field that reads back differently, see same_value(); a row that is missing counts with all its fields."""
    left = sent.select(*key, F.struct(*fields).alias("__sent"))
    right = stored.select(*key, F.struct(*fields).alias("__stored"))
    both = left.join(right, key, "left")
    numeric = lambda f: any(isinstance(d.schema[f].dataType, NumericType) for d in (sent, stored))
    bad = F.array(*(F.when(F.col("__stored").isNull() | ~same_value(F.col(f"__sent.{f}"), F.col(f"__stored.{f}"), numeric(f)), F.lit(f)) for f in fields))
    return both.select(*key, F.explode(F.filter(bad, lambda f: f.isNotNull())).alias("field"))


def journal_state(log: DataFrame, commit: str = "commit_id", seq: str = "seq") -> DataFrame:
    """The latest row of each commit in an append-only log."""
    rest = [c for c in log.columns if c not in (commit, seq)]
    last = F.max_by(F.struct(seq, *rest), F.struct(seq, *(F.col(c).cast("string") for c in rest))).alias("__last")
    return log.groupBy(commit).agg(last).select(commit, F.col(f"__last.{seq}").alias(seq), *(F.col(f"__last.{c}").alias(c) for c in rest))


#: What takes an operation back.
INVERSE = {"create": "mark_for_deletion", "update": "update", "mark_for_deletion": "unmark", "unmark": "mark_for_deletion"}


def undo_plan(state: DataFrame) -> DataFrame:
    """(commit_id, inverse, possible) from commits (commit_id, record_id, seq, operation, status): only the latest
    commit of a record that was done can be taken back."""
    newest = state.groupBy(F.col("record_id").alias("__r")).agg(F.max("seq").alias("__newest"))
    inverse = F.create_map(*(F.lit(x) for kv in INVERSE.items() for x in kv))
    joined = state.join(newest, F.col("record_id") == F.col("__r"))
    found = F.try_element_at(inverse, F.col("operation"))
    return joined.select("commit_id", found.alias("inverse"), (found.isNotNull() & (F.col("status") == "done") & (F.col("seq") == F.col("__newest"))).alias("possible"))


def effective(journal: DataFrame) -> DataFrame:
    """(commit_id, state) from an append-only journal (commit_id, seq, event, undoes): `open` and `done` or `failed` rows, of which the last counts, and for what
    takes another commit back that one's id in undoes.

    A commit is `pending` until it closes, `failed`, `done`, or `undone` if the commit that takes it back is done and not undone itself; so one that was
    taken back and restored is done again. Of several that take a commit back the first that is done counts. Chains are followed by doubling, so a chain
    of k takes some log2(k) joins."""
    last = journal.groupBy("commit_id").agg(F.max_by("event", "seq").alias("event"), F.max("undoes").alias("undoes"), F.min("seq").alias("seq"))
    done = last.where("event = 'done' and undoes is not null")
    links = done.groupBy(F.col("undoes").alias("c")).agg(F.min_by("commit_id", "seq").alias("u"))
    # from each commit along the commits that take back: how many are behind it decides
    step = links.select("c", F.col("u").alias("end"), F.lit(1).alias("hops")).persist()
    while True:
        ahead = step.select(F.col("c").alias("end"), F.col("end").alias("__end"), F.col("hops").alias("__hops"))
        joined = step.join(ahead, "end", "left")
        new = joined.select("c", F.coalesce("__end", "end").alias("end"), (F.col("hops") + F.coalesce("__hops", F.lit(0))).alias("hops"), F.col("__end").isNotNull().alias("moved"))
        new = new.checkpoint() if journal.sparkSession.conf.get("spark.checkpoint.dir", None) else new.persist()
        moved = not new.where("moved").isEmpty()
        step = new.drop("moved")
        if not moved:
            break
    state = F.when(F.col("event") == "open", "pending").when(F.col("event") == "failed", "failed").when(F.coalesce("hops", F.lit(0)) % 2 == 1, "undone").otherwise("done")
    return last.join(step, F.col("commit_id") == F.col("c"), "left").select("commit_id", state.alias("state"))


def attempts_in_window(df: DataFrame, session: str, time: str, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """df with `attempts`: those of the session in the window that ends with the row; one that lies a whole window back has left it."""
    window = Window.partitionBy(session).orderBy((F.unix_micros(F.col(time).cast("timestamp"))).asc()).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return df.withColumn("attempts", F.count("*").over(window))


class AdmissionWindow:
    """Times of admitted attempts of one session; a refused one leaves no mark."""

    def __init__(self, limit: int, micros: int, held: list[int] | None = None) -> None:
        self.limit, self.micros, self.held = limit, micros, deque(held or [])

    def admit(self, at: int) -> bool:
        while self.held and self.held[0] <= at - self.micros:
            self.held.popleft()
        if len(self.held) >= self.limit:
            return False
        self.held.append(at)
        return True


def admitted(df: DataFrame, session: str, time: str, tie: str, limit: int, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """(session, time, tie, admitted). Sessions are partitioned and sorted by time, and each row is judged as it
    streams past: a task holds `limit` times of one session, however many rows that has."""

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, window = None, None
        for frame in frames:
            out = []
            for s, t in zip(frame["__s"].tolist(), frame["__t"].tolist()):
                if window is None or s != at:
                    at, window = s, AdmissionWindow(limit, seconds * 1_000_000)
                out.append(window.admit(t))
            yield frame.drop(columns=["__s", "__t"]).assign(admitted=out)

    rows = df.select(F.col(session), F.col(time), F.col(tie), F.col(session).cast("string").alias("__s"), F.unix_micros(F.col(time).cast("timestamp")).alias("__t"))
    dealt = rows.repartition(session).sortWithinPartitions(session, "__t", tie)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return dealt.mapInPandas(judge, f"{session} {kinds[session]}, {time} {kinds[time]}, {tie} {kinds[tie]}, admitted boolean")


def alive(pending: DataFrame, requested: str, now: Column, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Pending operations that have not expired."""
    return pending.where(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(requested).cast("timestamp")) < seconds * 1_000_000)


@dataclass(frozen=True)
class Rights:
    hidden: frozenset[str] = frozenset()
    read_only: bool = False
    virtual: frozenset[str] = frozenset()
    allowed: frozenset[str] | None = None
    denied: frozenset[str] = frozenset()
    denied_fields: frozenset[str] = field(default_factory=frozenset)


def refusal(entity: Column, name: Column, rights: Rights) -> Column:
    """The code of the first rule that forbids writing a field of an entity, in fixed order; null if none does."""
    hit = lambda c, values: c.isin(*sorted(values)) if values else F.lit(False)
    allowed = F.lit(True) if rights.allowed is None else hit(entity, rights.allowed)
    return (
        F.when(hit(entity, rights.hidden), "entity_hidden")
        .when(F.lit(rights.read_only) | hit(entity, rights.virtual) | ~allowed | hit(entity, rights.denied), "permission_denied")
        .when(hit(F.concat_ws(".", entity, name), rights.denied_fields), "field_write_denied")
    )


def check_fresh(expected: str, found: str) -> None:
    if expected != found:
        raise EngineError("pending_stale", "the record has changed since the preview")
