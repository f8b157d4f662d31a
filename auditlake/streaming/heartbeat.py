"""Runs as a stream: sessions of events that end after a silence, and whether a run still lives."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from .. import config as K

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
CHANGES = "user_id long, at long, state string"


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, started, ended, n) of a stream of events: a session ends when ``gap`` has passed; events later than ``late`` are dropped by the watermark."""
    windows = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return windows.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


@contextmanager
def timers(spark: SparkSession):
    """Streams with timers keep their state in RocksDB, not in the memory of their tasks; the setting counts when a stream is started."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


LIFE = "n long, last long, dead boolean, waiting binary"


def lives(silence_s: int = K.SILENCE_S, start_s: int = K.START_S):
    """The life of one run, in event time, for ``applyInPandasWithState``: the state of many runs comes and goes with their rows.

    Events wait until the watermark has passed them, so that late ones take their place.
    The timer stands at the next thing that can happen: the first waiting event, or the end
    of the silence that a run may keep (``start`` before its first pulse, ``silence`` after).
    Times are microseconds.
    """
    silence, start = silence_s * 1_000_000, start_s * 1_000_000

    def changed(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Everything that happened up to the watermark, in order; then a timer for what comes next."""
        mark = state.getCurrentWatermarkMs() * 1000
        n, last, dead, waiting = state.get if state.exists else (0, 0, True, b"")
        us = [] if state.hasTimedOut else [b["us"].to_numpy(np.int64) for b in rows]
        new = [x[x >= mark] for x in us]  # anything earlier is too late
        times = np.sort(np.concatenate([np.frombuffer(waiting, np.int64), *new]))
        at = int(np.searchsorted(times, mark))
        ready, left = times[:at].tolist(), times[at:]
        if not (n or len(times)):
            return
        out: list[tuple[int, str]] = []

        def silent(until: int) -> None:
            nonlocal dead
            end = last + (silence if n > 1 else start)
            if n and not dead and end <= until:
                out.append((end, "dead"))
                dead = True

        for t in ready:
            silent(t)
            if dead:
                out.append((t, "running"))
            n, last, dead = n + 1, t, False
        silent(mark)
        state.update((n, last, dead, left.tobytes()))
        # In whole milliseconds that the watermark must exceed: an event's own, the last before a silence is over.
        ends = [] if dead or not n else [-(-(last + (silence if n > 1 else start)) // 1000) - 1]
        due = min([*(t // 1000 for t in left[:1].tolist()), *ends], default=None)
        if due is not None:
            state.setTimeoutTimestamp(due)
        if out:
            yield pd.DataFrame({"user_id": key[0], "at": [t for t, _ in out], "state": [s for _, s in out]})

    return changed


def state_changes(events: DataFrame, late: str = "0 seconds", silence_s: int = K.SILENCE_S, start_s: int = K.START_S) -> DataFrame:
    """(user_id, at, state) of a stream of events (user_id, ts): each change of a run between running and dead, once the watermark has passed it.

    Start it within ``timers(spark)``. State is a row a run and its events since the watermark.
    """
    us = events.withWatermark("ts", late).select("user_id", "ts", F.unix_micros("ts").alias("us"))
    return us.groupBy("user_id").applyInPandasWithState(lives(silence_s, start_s), CHANGES, LIFE, "append", "EventTimeTimeout").withColumn("at", F.timestamp_micros("at"))
