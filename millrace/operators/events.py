"""Event tables: correlation, sessions, evidence, latest state, ledgers and values carried along an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# How far each kind of evidence raises confidence.
WEIGHTS = {"media-type": 40, "probed": 35, "manifest-child": 30, "played": 25, "dom-attached": 20, "mse-appended": 20, "network": 10, "extension": 5, "probe-failed": -30}


def _micros(ts: Column) -> Column:
    """Microseconds since the epoch; times without a zone are read in the session's."""
    return F.unix_micros(ts.cast("timestamp"))


def first_within(events: DataFrame, key: str, ts: str, item: str, cause: Column, effect: Column, seconds: int) -> DataFrame:
    """(key, cause, effect, cause_ts, effect_ts): each effect that follows its key's last cause by at most ``seconds``, the
    first such effect of a cause only. One pass over each key's events in time order; a cause precedes effects of the
    same instant."""
    rows = events.where(cause | effect).select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.col(item).alias("item"), cause.alias("starts"))
    before = W.partitionBy("key").orderBy("ts", F.desc("starts"), "item").rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(F.col("starts"), F.struct("ts", "item")), ignorenulls=True).over(before)
    hits = rows.withColumn("cause", last).where(~F.col("starts") & F.col("cause").isNotNull())
    hits = hits.where(F.col("ts") <= F.col("cause.ts") + F.expr(f"interval {seconds} seconds"))
    return hits.groupBy("key", F.col("cause.item").alias("cause"), F.col("cause.ts").alias("cause_ts")).agg(F.min(F.struct("ts", "item")).alias("hit")).select("key", "cause", F.col("hit.item").alias("effect"), "cause_ts", F.col("hit.ts").alias("effect_ts"))


def gap_sessions(events: DataFrame, key: list[str], ts: str, gap_seconds: int) -> DataFrame:
    """Runs of events of a key with less than the gap between neighbours: number, first, last, events, and when a debounce
    of that length would fire."""
    order = W.partitionBy(*key).orderBy(ts)
    new = F.coalesce((_micros(F.col(ts)) - _micros(F.lag(ts).over(order)) >= gap_seconds * 1_000_000).cast("int"), F.lit(1))
    numbered = events.select(*key, ts, new.alias("_new")).withColumn("run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*key, "run").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("events"), (F.max(ts) + F.expr(f"interval {gap_seconds} seconds")).alias("due"))


def repeated_within(events: DataFrame, key: list[str], signature: str, ts: str, item: str, millis: int) -> DataFrame:
    """Events whose predecessor of the same key has the same signature and is at most ``millis`` older."""
    order = W.partitionBy(*key).orderBy(ts, item)
    prev = F.lag(F.struct(F.col(signature).alias("s"), F.col(ts).alias("t"))).over(order)
    hit = (F.col("_p.s") == F.col(signature)) & (_micros(F.col(ts)) - _micros(F.col("_p.t")) <= millis * 1000)
    return events.withColumn("_p", prev).where(hit).drop("_p")


def confidence(events: DataFrame, key: str, kind: str, weights: dict[str, int] = WEIGHTS) -> DataFrame:
    """(key, kinds, confidence): each kind of evidence counts once, the sum is kept within 0 and 100."""
    table = F.create_map(*(F.lit(x) for p in weights.items() for x in p))
    once = events.select(key, kind).distinct()
    score = F.sum(F.coalesce(F.try_element_at(table, F.col(kind)), F.lit(0)))
    return once.groupBy(key).agg(F.count(F.lit(1)).alias("kinds"), F.least(F.lit(100), F.greatest(F.lit(0), score)).cast("bigint").alias("confidence"))


def latest(events: DataFrame, key: list[str], ts: str, item: str, *values: str) -> DataFrame:
    """The values of each key's last event."""
    return events.groupBy(*key).agg(F.max(F.struct(F.col(ts), F.col(item), *values)).alias("l")).select(*key, *(F.col(f"l.{v}").alias(v) for v in (ts, item, *values)))


def ledger(items: DataFrame, job: str, state: str, size: Column, states: list[str]) -> DataFrame:
    """A row a job: items, how many are in each state, and the bytes."""
    return items.groupBy(job).agg(F.count(F.lit(1)).alias("items"), *(F.count_if(F.col(state) == s).alias(f"n_{s.lower()}") for s in states), F.sum(size).alias("bytes"))


def majority(events: DataFrame, key: str, side: Column, a: str, b: str) -> DataFrame:
    """The side with more votes; null on a tie."""
    n = events.groupBy(key).agg(F.count_if(side == a).alias("n_a"), F.count_if(side == b).alias("n_b"))
    return n.withColumn("majority", F.when(F.col("n_a") > F.col("n_b"), a).when(F.col("n_b") > F.col("n_a"), b))


def running_offsets(rows: DataFrame, group: list[str], order: str, length: str, offset: Column) -> DataFrame:
    """Byte ranges: an explicit offset starts a run, each later length without one begins where the last ended."""
    w = W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    marked = rows.withColumn("_o", offset).withColumn("_run", F.count("_o").over(w))
    inner = W.partitionBy(*group, "_run").orderBy(order)
    start = F.coalesce(F.first("_o").over(inner.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)) + F.sum(length).over(inner.rowsBetween(W.unboundedPreceding, 0)) - F.col(length)
    return marked.withColumn("range_start", start.cast("bigint")).withColumn("range_end", (F.col("range_start") + F.col(length)).cast("bigint")).drop("_o", "_run")


def carried(rows: DataFrame, group: list[str], order: str, value: Column, name: str) -> DataFrame:
    """The last value that is not null at or before each row."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
