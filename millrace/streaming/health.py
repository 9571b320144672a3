"""Health of service instances as keyed streaming state: results that arrive late are ignored, failures cool down, what has
not been heard of for long is forgotten.

State is one small row a key in the RocksDB store, with event-time timers for the end of a cooldown and for forgetting, so
neither a busy key nor a silent one grows. The store's checkpoint makes a restarted query go on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.operators import instances

#: The first cooldown, the longest one and the failures that are counted, in seconds and results.
COOLDOWN, LONGEST, COUNTED = 60, 1800, 10
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_STATE = "ok_at long, failed_at long, failures long, retry_at long, seen long"


def after(state: tuple, started: int, ended: int, ok: bool) -> tuple:
    """The state (ok_at, failed_at, failures, retry_at, seen) after a result; see :func:`instances.after`."""
    return *instances.after(state[:4], started, ended, ok, COOLDOWN, LONGEST, COUNTED), max(state[4], ended)


class _Health(StatefulProcessor):
    def __init__(self, forget: int, kind: str):
        self.forget, self.kind = forget, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("health", _STATE)

    def _row(self, key, event: str, state: tuple) -> pd.DataFrame:
        names = ["ok_at", "failed_at", "failures", "retry_at"]
        return pd.DataFrame({"key": [key[0]], "event": [event], **{n: [int(v)] for n, v in zip(names, state, strict=False)}})

    def _timers(self, state: tuple) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        for t in {state[3], state[4] + self.forget} - {0}:
            self.handle.registerTimer(int(t) * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else (0, 0, 0, 0, 0)
        batch = pd.concat(list(rows)).sort_values(["ended", "started", "ok"])
        for started, ended, ok in zip(batch["started"].tolist(), batch["ended"].tolist(), batch["ok"].tolist(), strict=True):
            state = after(state, started, ended, ok)
        self.state.update(state)
        self._timers(state)
        yield self._row(key, "healthy" if state[0] else "failing", state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        state, at = tuple(self.state.get()), expiredTimerInfo.getExpiryTimeInMs() // 1000
        if at >= state[4] + self.forget:
            self.state.clear()
            yield self._row(key, "forgotten", state)
        elif state[3] and at >= state[3]:
            yield self._row(key, "ready", state)

    def close(self) -> None:
        pass


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """Set the session's state store to the one that :func:`states` needs; call it before any stream is started."""
    spark.conf.set(_PROVIDER, ROCKSDB)


def states(checks: DataFrame, key: str, started: str, ended: str, ok: str, late: str = "10 minutes", forget: int = 30 * 86_400) -> DataFrame:
    """(key, event, ok_at, failed_at, failures, retry_at), a row for each change, in update mode.

    ``healthy`` or ``failing`` after a batch's results of a key, which are taken in the order in which the checks ended; ``ready`` when
    the watermark passes the end of a cooldown; ``forgotten`` when it passes the last result by ``forget`` seconds, and the
    state is dropped. ``started`` and ``ended`` are timestamps (whole seconds count); results later than the watermark allows,
    and those with a null key, time or result, are not taken. Null keys have no instance.
    """
    spark = checks.sparkSession
    if spark.conf.get(_PROVIDER, None) != ROCKSDB:
        raise ValueError("call keep_state_in_rocksdb first: timers need that state store")
    kind = checks.schema[key].dataType.simpleString()
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    rows = checks.select(F.col(key).alias("key"), F.col(ended).cast("timestamp").alias("at"), seconds(started).alias("started"), seconds(ended).alias("ended"), F.col(ok).alias("ok")).dropna()
    out = f"key {kind}, event string, ok_at long, failed_at long, failures long, retry_at long"
    return rows.withWatermark("at", late).groupBy("key").transformWithStateInPandas(_Health(forget, kind), out, "update", "EventTime")
