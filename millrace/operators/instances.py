"""Health of service instances from the results of their checks, their ranking, and jobs that resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def after(state: tuple, started: int, ended: int, ok: bool, base: int = 60, most: int = 1800, cap: int = 10) -> tuple:
    """The state (ok_at, failed_at, failures, retry_at) after a result.

    A result is stale, and ignored, if it failed and the last one ended after the check began, or if it passed and the last one
    was a failure that ended after it began. A pass resets; the n-th failure in a row waits base * 2 ** (n - 1) seconds, ``most`` at
    the longest."""
    ok_at, failed_at, failures, _ = state
    if failed_at > started or (not ok and ok_at > started):
        return state
    if ok:
        return ended, 0, 0, 0
    n = min(failures + 1, cap)
    return 0, ended, n, ended + min(base * 2 ** (n - 1), most)


def health(checks: DataFrame, key: str, started: str, ended: str, ok: str, base: int = 60, most: int = 1800, cap: int = 10) -> DataFrame:
    """(key, ok_at, failed_at, failures, retry_at) after all checks, in the order in which they ended (:func:`after`). Times are
    seconds.

    Each result depends on the one before, so a key's checks pass one task in order; they are sorted by Spark, which spills,
    and only the state is held. As a stream there is ``streaming.health``.
    """
    rows = checks.select(F.col(key).alias("k"), F.col(started).cast("bigint").alias("s"), F.col(ended).cast("bigint").alias("e"), F.col(ok).alias("ok")).dropna(subset=["s", "e", "ok"])
    kind = rows.schema["k"].dataType

    def fold(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        def done(keys: list, states: list):
            return pa.RecordBatch.from_arrays([pa.array(keys, to_arrow_type(kind)), *(pa.array([x[k] for x in states], pa.int64()) for k in range(4))], names=["k", "ok_at", "failed_at", "failures", "retry_at"])

        last, state, seen = None, (0, 0, 0, 0), False
        for b in batches:
            keys, states = [], []
            for k, s, e, good in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if seen and k != last:
                    keys.append(last)
                    states.append(state)
                    state = (0, 0, 0, 0)
                last, seen, state = k, True, after(state, s, e, good, base, most, cap)
            yield done(keys, states)
        if seen:
            yield done([last], [state])

    ordered = rows.repartition("k").sortWithinPartitions("k", "e", "s", "ok")
    return ordered.mapInArrow(fold, f"k {kind.simpleString()}, ok_at long, failed_at long, failures long, retry_at long").withColumnRenamed("k", key)


def candidates(instances: DataFrame, state: DataFrame, key: str, score: str, now: int, last: str | None = None, excluded: list | None = None, ignore_cooldown: bool = False) -> DataFrame:
    """Instances to try, with their place: not excluded and not cooling down; the last good one first, then those that were
    healthy, then by score and key."""
    rows = instances.join(state, key, "left").where(~F.col(key).isin(excluded or []))
    if not ignore_cooldown:
        rows = rows.where(F.coalesce(F.col("retry_at"), F.lit(0)) <= now)
    rank = [(F.col(key) == F.lit(last)).cast("int").alias("is_last"), (F.coalesce(F.col("ok_at"), F.lit(0)) > 0).cast("int").alias("is_ok")]
    ordered = rows.select(key, F.col(score), *rank)
    return ordered.orderBy(F.desc_nulls_last("is_last"), F.desc("is_ok"), F.desc(score), key)


def resumed(jobs: DataFrame, state: str = "state") -> DataFrame:
    """The queue after a restart: what was being fetched waits again."""
    return jobs.withColumn(state, F.when(F.col(state) == "fetching", "queued").otherwise(F.col(state)))


def retried(jobs: DataFrame, codes: list[str], state: str = "state", code: str = "code", protected: str = "drm") -> DataFrame:
    """The queue after a retry of some causes: failed items with such a code go back, protected ones never do."""
    again = (F.col(state) == "failed") & F.col(code).isin(*codes) & ~F.coalesce(F.col(protected), F.lit(False))
    return jobs.withColumn(state, F.when(again, "queued").otherwise(F.col(state)))


def alive(rows: DataFrame, key: str, ts: Column, now: Column, ttl_seconds: int, closed: DataFrame | None = None) -> DataFrame:
    """State rows that are not older than their time to live and whose key has not been closed since."""
    live = rows.where(F.unix_seconds(now) - F.unix_seconds(ts.cast("timestamp")) <= ttl_seconds)
    return live if closed is None else live.join(closed.select(key), key, "left_anti")


def earliest_due(rows: DataFrame, key: str, due: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min(due).alias(due))


def stable_files(listings: DataFrame, path: str, seen: str, size: str, seconds: int = 2) -> DataFrame:
    """(path, size) of files whose size did not change between the last two listings, at least ``seconds`` apart."""
    w = W.partitionBy(path).orderBy(F.desc(seen))
    last = listings.withColumn("_r", F.row_number().over(w)).withColumn("_size", F.lead(size).over(w)).withColumn("_seen", F.lead(seen).over(w)).where("_r = 1")
    return last.where((F.col(size) == F.col("_size")) & (F.col(seen) - F.col("_seen") >= seconds)).select(path, size)
