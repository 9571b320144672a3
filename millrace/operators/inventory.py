"""Folder roll-ups, leaderboards, histograms and representative samples of file inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.order import exact_median


def roll_up(files: DataFrame, folders: str = "folders", size: str = "size") -> DataFrame:
    """(folder, depth, files, bytes) of every folder with all that lies below it; the root is ``/``.

    A file counts once for each of its folders, so it is one explode and one aggregation whatever the depth. Files are
    first summed by their own folder, which shrinks what is exploded.
    """
    own = files.groupBy(folders).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b"))
    above = F.transform(F.sequence(F.lit(0), F.size(folders)), lambda k: F.struct(F.concat(F.lit("/"), F.array_join(F.slice(F.col(folders), F.lit(1), k), "/")).alias("folder"), k.alias("depth")))
    return own.select(F.explode(above).alias("a"), "n", "b").groupBy(F.col("a.folder").alias("folder"), F.col("a.depth").alias("depth")).agg(F.sum("n").alias("files"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"))


def with_share(rolled: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Adds the percentage of all bytes, and whether a folder's mean file size stands out: red from twice, orange from one
    and a half times the mean of all files. ``totals`` is a row (all_bytes, all_files); without it the root's row is taken,
    for which the roll-up is computed again."""
    if totals is None:
        totals = rolled.where("depth = 0").select(F.col("bytes").alias("all_bytes"), F.col("files").alias("all_files"))
    mean, whole = F.try_divide(F.col("bytes"), F.col("files")), F.try_divide(F.col("all_bytes"), F.col("all_files"))
    flag = F.when((whole > 0) & (mean >= 2 * whole), "red").when((whole > 0) & (mean >= 1.5 * whole), "orange").otherwise("none")
    share = F.coalesce(F.try_divide(F.col("bytes") * 100.0, F.col("all_bytes")), F.lit(0.0))
    return rolled.join(F.broadcast(totals)).select(*rolled.columns, F.round(share, 6).alias("percent"), flag.alias("flag"))


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows with their rank: partial top-k in each task, then one merge of k rows a task."""
    first = df.orderBy(*order).limit(k)
    return first.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def histogram(df: DataFrame, bucket: Column, name: str = "bucket") -> DataFrame:
    return df.groupBy(bucket.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def head_and_tail(df: DataFrame, limit: int, group: list[str], *order: Column) -> DataFrame:
    """Of each group of more than ``limit`` rows the first half (rounded up) and the last half of the limit. Both ends are
    limits on a row number, which Spark applies before it shuffles; the size of a group is never windowed."""
    within = W.partitionBy(*group)
    first = df.withColumn("_at", F.row_number().over(within.orderBy(*order))).where(F.col("_at") <= limit)
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_of"))
    head = first.join(sizes, group).where((F.col("_of") <= limit) | (F.col("_at") <= (limit + 1) // 2)).drop("_at", "_of")
    back = [F.desc(c) if isinstance(c, str) else c.desc() for c in order]
    tail = df.withColumn("_at", F.row_number().over(within.orderBy(*back))).where(F.col("_at") <= max(1, limit // 2))
    tail = tail.join(sizes, group).where((F.col("_of") > limit) & F.lit(limit > 1)).drop("_at", "_of")
    return head.unionByName(tail)


def capped_selection(df: DataFrame, group: list[str], category: str, per_category: int, overall: int, priority: Column, *order: Column) -> DataFrame:
    """At most ``per_category`` rows of each category of a group, then at most ``overall`` of the group, by descending
    priority and then the given order."""
    ranked = df.withColumn("_p", priority)
    ranked = ranked.withColumn("_c", F.row_number().over(W.partitionBy(*group, category).orderBy(F.desc("_p"), *order))).where(F.col("_c") <= per_category)
    return ranked.withColumn("_r", F.row_number().over(W.partitionBy(*group).orderBy(F.desc("_p"), *order))).where(F.col("_r") <= overall).drop("_p", "_c", "_r")


def snapshot_digest(df: DataFrame, group: list[str], *columns: str) -> DataFrame:
    """A digest of a group's rows that is the same for the same rows, however they arrive: 60 bits of each row's SHA-256 add
    up in partial sums, and the sum and the number of rows are hashed. No group is collected or sorted."""
    line = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    part = F.conv(F.substring(F.sha2(line, 256), 1, 15), 16, 10).cast("decimal(20,0)")
    sums = df.groupBy(*group).agg(F.sum(part).alias("s"), F.count(F.lit(1)).alias("n"))
    return sums.select(*group, F.sha2(F.concat_ws("|", F.col("s").cast("string"), F.col("n").cast("string")), 256).alias("digest"), "n")


def fixed_order_counts(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(place, key, n) of the values that occur, in a fixed order; what the order does not name comes after, by name."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    place = F.array_position(F.array(*map(F.lit, order)), F.col(key))
    return n.select(F.when(place > 0, place).otherwise(len(order) + 1).cast("int").alias("place"), key, "n")


def source_counts(df: DataFrame, source: str, prefix: str = "content_") -> DataFrame:
    """(source, n, override): how often each source decided, unknown ones as ``unknown``, and whether it overrides others."""
    named = F.coalesce(F.nullif(F.col(source), F.lit("")), F.lit("unknown"))
    n = df.groupBy(named.alias("source")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("override", F.col("source").startswith(prefix))


def _deviations(df: DataFrame, value: str) -> DataFrame:
    """(_g, mad): the median distance of each group's values from their median, exactly."""
    rows = df.select("_g", F.col(value).cast("double").alias("v"))
    mid = exact_median(rows, "_g", "v").select("_g", F.col("median").alias("m"))
    return exact_median(rows.join(mid, "_g").select("_g", F.abs(F.col("v") - F.col("m")).alias("v")), "_g", "v").select("_g", F.col("median").alias("mad"))


def stability(df: DataFrame, group: list[str], centre: str, size: str) -> DataFrame:
    """Median absolute deviations of two measures in each group, and the score that falls with them. Medians are exact and
    found by position (:func:`order.exact_median`), so no group is held in one task."""
    rows = df.withColumn("_g", F.struct(*group))
    off = _deviations(rows, centre).withColumnRenamed("mad", "centre_mad").join(_deviations(rows, size).withColumnRenamed("mad", "size_mad"), "_g", "full_outer")
    score = 1 - 0.5 * F.col("centre_mad") / 0.07 - 0.5 * F.col("size_mad") / 0.09
    return off.select("_g.*", "centre_mad", "size_mad").withColumn("stability", F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))
