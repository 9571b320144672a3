"""Positions in a total order over a whole table, without a window that holds the table in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.plans.materialize import materialize

_ROW = (1 << 33) - 1


def with_before(rows: DataFrame, keys: list[str], count: str) -> DataFrame:
    """``rows`` with ``before``: the sum of ``count`` over all rows with lesser keys. Keys are distinct. One range-partitioned
    sort, written; running sums go on from the totals of the partitions before, a row a partition."""
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id())
    at = materialize(placed.withColumn("_p", F.shiftright("_m", 33).cast("int")).withColumn("_at", F.col("_m").bitwiseAND(F.lit(_ROW))).drop("_m"), "ordered")
    so_far, firsts = 0, []
    for r in sorted(at.groupBy("_p").agg(F.sum(count).alias("n")).collect(), key=lambda r: r["_p"]):
        firsts.append((r["_p"], so_far))
        so_far += r["n"]
    starts = rows.sparkSession.createDataFrame(firsts, "_p int, _s long")
    run = F.coalesce(F.sum(count).over(W.partitionBy("_p").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = at.withColumn("before", run).join(F.broadcast(starts), "_p").withColumn("before", F.col("before") + F.col("_s")).drop("_p", "_at", "_s")
    out._written_to = at._written_to  # release() of the result deletes the sorted table
    return out


def exact_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median, n) of the values that are not null, exactly: equal values are counted first, then the middle ones are
    found by their positions, so a group of any size is never held in one task."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("k"))
    at = with_before(counts, [group, value], "k")
    groups = at.groupBy(group).agg(F.min("before").alias("first"), F.sum("k").alias("n"))
    low, high = F.col("first") + F.floor((F.col("n") - 1) / 2), F.col("first") + F.floor(F.col("n") / 2)
    inside = lambda place: (F.col("before") <= place) & (place < F.col("before") + F.col("k"))
    middle = at.join(groups, group).where(inside(low) | inside(high))
    return middle.groupBy(group).agg(((F.min(value) + F.max(value)) / 2).alias("median"), F.first("n").alias("n"))
