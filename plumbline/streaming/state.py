"""Streaming counterparts: change detection, observation state, rate limits, micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _changes(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    before = rows["fingerprint"].shift(1)
    if last is not None:
        before.iloc[0] = last
    kept = rows[(before.isna()) | (rows["fingerprint"] != before)]
    state.update((rows["fingerprint"].iloc[-1],))
    yield pd.DataFrame({"session": key[0], "event_id": kept["event_id"], "fingerprint": kept["fingerprint"]})


def changed(events: DataFrame) -> DataFrame:
    """Events (session, ts, event_id, fingerprint) that differ from the one before: only the last fingerprint is kept, so A B A emits three."""
    return events.groupBy("session").applyInPandasWithState(_changes, "session string, event_id long, fingerprint string", "last string", "append", GroupStateTimeout.NoTimeout)


def limiter(limit: int = 60, window_s: int = 60) -> Callable:
    """A window anchored at a client's first request; refused requests count too, and the state goes when the window ends."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (None, 0)
        out = []
        for row in pd.concat(list(frames)).sort_values(["ts", "event_id"]).itertuples():
            now = row.ts.timestamp()
            if start is None or now >= start + window_s:
                start, n = now, 0
            n += 1
            out.append((key[0], row.event_id, n <= limit))
        state.update((start, n))
        state.setTimeoutDuration(window_s * 1000)
        yield pd.DataFrame(out, columns=["client", "event_id", "allowed"])

    return run


def rate_limited(requests: DataFrame, limit: int = 60, window_s: int = 60) -> DataFrame:
    """Requests (client, ts, event_id) with whether each is allowed."""
    return requests.groupBy("client").applyInPandasWithState(limiter(limit, window_s), "client string, event_id long, allowed boolean", "start double, n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(events: DataFrame, time: str, key: str, width: str, delay: str) -> DataFrame:
    """(key, start, n): events by key and window; those later than ``delay`` behind the newest are dropped, and a window's state goes when it is sent."""
    return events.withWatermark(time, delay).groupBy(key, F.window(time, width).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def contribute(stream: DataFrame, read_then_write: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False):
    """Start a query whose micro-batches read the corpus version before them and then write the next; with ``available_now`` it ends with what is there."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(read_then_write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
