"""Streams of events: debounce, correlation, idempotent ingest, keyed state. The same code runs on a batch table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of Parquet files that appear in a folder."""
    reader = spark.readStream.schema(schema).format("parquet")
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(folder)


def debounced(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """One row for each run of a key's events with less than the gap between them, once the gap has passed: (key, first,
    due, events). Late events within the watermark still extend their run."""
    t = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    runs = t.groupBy(F.session_window("_t", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("events"))
    return runs.select(key, F.col("w.start").alias("first_ts"), F.col("w.end").alias("due"), "events")


def correlated(events: DataFrame, key: str, ts: str, item: str, cause: Column, effect: Column, within: str, late: str) -> DataFrame:
    """(key, cause, effect): effects that follow a cause of the same key within an interval, as a join of two streams whose
    state is bounded by the watermark. Each pair is emitted; see ``operators.events.first_within`` for the first alone."""
    t = events.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("t"), F.col(item).alias("item"), cause.alias("c"), effect.alias("e"))
    left = t.where("c").select("key", F.col("t").alias("ct"), F.col("item").alias("cause")).withWatermark("ct", late)
    right = t.where("e").select(F.col("key").alias("ekey"), F.col("t").alias("et"), F.col("item").alias("effect")).withWatermark("et", late)
    near = (F.col("key") == F.col("ekey")) & (F.col("et") >= F.col("ct")) & (F.col("et") <= F.col("ct") + F.expr(f"interval {within}"))
    return left.join(right, near).select("key", "cause", "effect")


def once(events: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """The first arrival of each key within the watermark; what comes again is dropped."""
    return events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark(keys).drop("_t")


def without_own_outputs(events: DataFrame, name: str, outputs: list[str]) -> DataFrame:
    """Change events that were not caused by files which the pipeline itself writes."""
    return events.where(~(F.lower(name).rlike(r"\.m3u8?$") | F.lower(name).isin([o.lower() for o in outputs])))


def flags(events: DataFrame, key: str, kind: str, notify_every: int = 25) -> DataFrame:
    """(key, segments, kinds, notify): running state of each key over all its batches. Segments add up and kinds gather;
    a row says to notify on the first event, on a new kind, and whenever the count passes a multiple of ``notify_every``.
    """
    import pandas as pd

    kind_of_key = events.schema[key].dataType.simpleString()

    def step(k, batches, state):
        count, seen = state.get if state.exists else (0, "")
        old, before = count, set(filter(None, seen.split(",")))
        now = set(before)
        for pdf in batches:
            count += len(pdf)
            now |= {str(x) for x in pdf[kind].dropna()}
        state.update((count, ",".join(sorted(now))))
        notify = old == 0 or now != before or count // notify_every > old // notify_every
        yield pd.DataFrame({"key": [k[0]], "segments": [count], "kinds": [",".join(sorted(now))], "notify": [notify]})

    out = f"key {kind_of_key}, segments long, kinds string, notify boolean"
    return events.groupBy(key).applyInPandasWithState(step, out, "count long, seen string", "update", "NoTimeout")


def changed_keys(digests: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Keys whose digest is new or differs from the stored one."""
    old = stored.select(F.col(key).alias("_k"), F.col("digest").alias("_d"))
    return digests.join(old, F.col(key) == F.col("_k"), "left").where(~F.col("digest").eqNullSafe(F.col("_d"))).select(key)


def on_change(digests: DataFrame, stored: DataFrame, key: str, refresh: Callable[[DataFrame], None]) -> None:
    """Hand the table of changed keys to ``refresh``, once a batch: meant for ``foreachBatch``. The keys stay distributed."""
    refresh(changed_keys(digests, stored, key))


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything that is there, to an in-memory table: for tests and small reports."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
