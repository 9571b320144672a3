"""Reports of compared pairs as tables ready for ``write.csv`` and ``write.json``, and publishing that an input change stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.markup import display_safe
from millrace.plans.materialize import drop_path

#: The columns of the report of pairs, in order.
COLUMNS = ["a", "b", "label", "match_kind", "verification", "phash_similarity", "inliers", "coverage_a", "coverage_b", "residual_median_px", "model"]
_DECIMALS = {"phash_similarity", "coverage_a", "coverage_b", "residual_median_px"}


def finite(value: Column) -> Column:
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), value)


def pair_lines(pairs: DataFrame) -> DataFrame:
    """The report's columns as text: four decimals (the exact value rounded, halves to even), empty for what is no number."""
    text = lambda c: F.coalesce(F.replace(F.format_number(finite(F.col(c)), 4), F.lit(","), F.lit("")) if c in _DECIMALS else F.col(c).cast("string"), F.lit(""))
    return pairs.select(*(F.when(finite(F.col(c)).isNull(), "").otherwise(text(c)).alias(c) if c in _DECIMALS else text(c).alias(c) for c in COLUMNS))


def pair_documents(pairs: DataFrame) -> DataFrame:
    """One JSON text a pair, numbers that are not finite as null."""
    metrics = F.struct(*((finite(F.col(c)) if c in _DECIMALS else F.col(c)).alias(c) for c in COLUMNS if c not in ("a", "b", "label", "match_kind")))
    return pairs.select(F.to_json(F.struct("a", "b", "label", "match_kind", metrics.alias("metrics")), {"ignoreNullFields": "false"}).alias("value"))


def html_lines(pairs: DataFrame) -> DataFrame:
    """(place, value): the report as lines of an HTML page, a row a pair in the order of a and b, texts escaped and control
    marks shown. Ready for ``write.text`` after ``sortWithinPartitions``: rows of the table are made where the pairs are."""
    mark = lambda c: F.replace(F.replace(F.replace(F.replace(display_safe(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    cells = F.concat(*(F.concat(F.lit("<td>"), mark(F.col(c)), F.lit("</td>")) for c in COLUMNS))
    body = pair_lines(pairs).select(F.struct(F.lit(1).alias("part"), "a", "b").alias("place"), F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("value"))
    frame = [(0, '<!doctype html><meta charset="utf-8"><title>Pairs</title><table>'), (0, "<tr>" + "".join(f"<th>{c}</th>" for c in COLUMNS) + "</tr>"), (2, "</table>")]
    ends = pairs.sparkSession.createDataFrame([((k, "", chr(97 + i)), v) for i, (k, v) in enumerate(frame)], "place struct<part:int,a:string,b:string>, value string")
    return ends.unionByName(body)


def skipped(rows: DataFrame, path: str, failed: Column) -> DataFrame:
    """(value): the paths of rows that failed, each once, for a log beside the report."""
    return rows.where(failed).select(F.col(path).alias("value")).distinct()


def report_stats(pairs: DataFrame, clusters: int) -> DataFrame:
    """One row of counts."""
    of = lambda name: F.count_if(F.col("label") == name)
    return pairs.agg(F.count(F.lit(1)).alias("pairs_compared"), F.lit(clusters).cast("bigint").alias("clusters"), of("duplicate").alias("duplicates"), of("variant").alias("variants"), of("different").alias("different_sampled"))


def _store(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, before = hadoop.Path(path), hadoop.Path(f"{path.rstrip('/')}.before")
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target, before


def recovered(spark: SparkSession, path: str) -> bool:
    """Whether a publication that broke off between its two renames was undone: the version before is put back."""
    store, target, before = _store(spark, path)
    return bool(not store.exists(target) and store.exists(before) and store.rename(before, target))


def publish(df: DataFrame, path: str, before: DataFrame, now: DataFrame) -> bool:
    """Write ``df`` over ``path`` unless the input has changed: ``before`` and ``now`` are its listing when the work began
    and after staging. True if it was published.

    Work is staged beside the target; the old version is renamed aside, the new one into its place, and only then the old one
    is deleted. Readers never see half of a version; if the work breaks off between the renames, the next call (or
    :func:`recovered`) puts the old version back.
    """
    spark = df.sparkSession
    recovered(spark, path)
    staged = f"{path.rstrip('/')}.staged"
    df.write.mode("overwrite").parquet(staged)
    if before.exceptAll(now).limit(1).count() or now.exceptAll(before).limit(1).count():
        drop_path(spark, staged)
        return False
    store, target, aside = _store(spark, path)
    store.delete(aside, True)
    if store.exists(target) and not store.rename(target, aside):
        return False
    if not store.rename(spark._jvm.org.apache.hadoop.fs.Path(staged), target):
        store.rename(aside, target)
        return False
    store.delete(aside, True)
    return True
