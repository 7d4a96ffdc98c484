"""Streaming forms of the limiter, the guard and the latest record, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerlake.operators.changes import WINDOW_SECONDS, AdmissionWindow
from ledgerlake.operators.masking import guard


def admitted_stream(df: DataFrame, session: str, time: str, limit: int, seconds: int = WINDOW_SECONDS, late: str = "1 minute") -> DataFrame:
    """(session, at, admitted) of a stream of attempts. A session's state is its admitted times within the window,
    `limit` at most, and goes when the watermark has passed them."""

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        window = AdmissionWindow(limit, seconds * 1_000_000, list(state.get[0]) if state.exists else None)
        at = sorted(t for f in frames for t in f["__t"].tolist())
        yield pd.DataFrame({session: [key[0]] * len(at), "at": at, "admitted": [window.admit(t) for t in at]})
        state.update((list(window.held),))
        if window.held:
            state.setTimeoutTimestamp(max(window.held[-1] // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    kind = df.schema[session].dataType.simpleString()
    rows = df.withColumn("__t", F.unix_micros(F.col(time).cast("timestamp"))).withColumn("__w", F.col(time).cast("timestamp")).withWatermark("__w", late)
    return rows.groupBy(session).applyInPandasWithState(judge, f"{session} {kind}, at long, admitted boolean", "held array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def guarded_stream(df: DataFrame, secret: bytes) -> DataFrame:
    """The guard is a projection and so works on a stream as it is."""
    return guard(df, secret)


def turnovers_stream(df: DataFrame, time: str, window: str, keys: list[str], amount: str, late: str = "1 hour") -> DataFrame:
    """Sums of tumbling windows; rows later than the watermark are left out."""
    rows = df.withColumn("__w", F.col(time).cast("timestamp")).withWatermark("__w", late)
    return rows.groupBy(F.window("__w", window), *keys).agg(F.sum(F.col(amount).cast("decimal(18,2)")).alias("turnover"), F.count("*").alias("n"))
