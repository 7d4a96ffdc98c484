"""Pending operations: proposed in a session, confirmed in the same session before they expire, each at most once."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TTL_SECONDS, GRACE_SECONDS = 600, 60
SCHEMA = "pending_id bigint, session string, action string, at timestamp, outcome string"


def outcome(held: tuple[str, int] | None, session: str, action: str, at: int, ttl: int = TTL_SECONDS) -> tuple[str, tuple[str, int] | None]:
    """What comes of an action at `at` (microseconds), and what is held after it: (session, time of proposal).

    A proposal is held unless one is. A confirmation is checked for its session before its time, so another session learns nothing of
    how long an operation has stood; one that is too late ends it, as does one that holds."""
    if action == "propose":
        return ("held", held) if held is not None else ("proposed", (session, at))
    if held is None:
        return "unknown", None
    if held[0] != session:
        return "wrong_session", held
    if at >= held[1] + ttl * 1_000_000:
        return "expired", None
    return ("cancelled" if action == "cancel" else "confirmed"), None


def pending_outcomes(rows: DataFrame, ttl: int = TTL_SECONDS) -> DataFrame:
    """SCHEMA rows of rows (pending_id, session, action, at), those of each operation judged in order of time, then of action. An operation's rows stream
    past in one task, which holds one of them at a time."""

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, None
        for frame in frames:
            out = []
            for pending, session, action, at in zip(frame["pending_id"].tolist(), frame["session"].tolist(), frame["action"].tolist(), frame["micros"].tolist()):
                if pending != key:
                    key, held = pending, None
                what, held = outcome(held, session, action, at, ttl)
                out.append(what)
            yield frame.drop(columns=["micros"]).assign(outcome=out)

    timed = rows.select("pending_id", "session", "action", F.col("at").cast("timestamp").alias("at"), F.unix_micros(F.col("at").cast("timestamp")).alias("micros"))
    return timed.repartition("pending_id").sortWithinPartitions("pending_id", "micros", F.desc("action")).mapInPandas(judge, SCHEMA)


class PendingProcessor(StatefulProcessor):
    """One operation's state: who proposed it and when. A timer ends it when its time and a grace for late rows have passed."""

    def __init__(self, ttl: int = TTL_SECONDS, grace: int = GRACE_SECONDS) -> None:
        self.ttl, self.grace = ttl, grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", "session string, at bigint")

    def _held(self) -> tuple[str, int] | None:
        return tuple(self.state.get()) if self.state.exists() else None

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self._held()
        for r in sorted(rows, key=lambda r: (r.micros, r.action != "propose")):
            before = held
            what, held = outcome(held, r.session, r.action, r.micros, self.ttl)
            if held is not None and held != before:
                self.handle.registerTimer(held[1] // 1000 + (self.ttl + self.grace) * 1000)
            yield Row(pending_id=key[0], session=r.session, action=r.action, at=r.at, outcome=what)
        if held is None:
            self.state.clear()
        else:
            self.state.update(held)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        held = self._held()
        if held is not None and held[1] // 1000 + (self.ttl + self.grace) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
            yield Row(pending_id=key[0], session=held[0], action="timer", at=None, outcome="expired")

    def close(self) -> None:
        pass


def pending_stream(rows: DataFrame, ttl: int = TTL_SECONDS, grace: int = GRACE_SECONDS) -> DataFrame:
    """SCHEMA rows of a stream (pending_id, session, action, at), and one with the action `timer` for each operation that nobody has ended in time.
    Rows later than the grace are judged as they come. Needs a state store with timers, which RocksDB's is."""
    timed = rows.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", f"{grace} seconds").withColumn("micros", F.unix_micros("at"))
    return timed.groupBy("pending_id").transformWithState(PendingProcessor(ttl, grace), SCHEMA, "Append", "EventTime")
