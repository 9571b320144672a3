"""What was done before, what came of it, and what is left: histories, outcomes, causes, retention and summaries by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def outcomes(rows: DataFrame, key: list[str], good: Column, amount: Column) -> DataFrame:
    """(key, ok, failed, selected): rows that are good and not, and the amount of the good ones. An unknown outcome is a failure; a null amount
    counts nothing."""
    ok = F.coalesce(good, F.lit(False))
    return rows.groupBy(*key).agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.sum(F.when(ok, F.coalesce(amount, F.lit(0))).otherwise(0)).alias("selected"))


def causes(rows: DataFrame, code: str, item: str, shown: int = 3) -> DataFrame:
    """(code, n, samples): how often each failure occurs and its first items, joined by commas. The limit by code applies before
    rows are shuffled."""
    first = rows.select(code, item, F.row_number().over(W.partitionBy(code).orderBy(item)).alias("_r")).where(F.col("_r") <= shown)
    named = first.groupBy(code).agg(F.array_join(F.sort_array(F.collect_list(item)), ",").alias("samples"))
    return rows.groupBy(code).agg(F.count(F.lit(1)).alias("n")).join(named, code)


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the ledger; null keys never are."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def reasons(rows: DataFrame, key: str, *ledgers: tuple[DataFrame, str]) -> DataFrame:
    """(key, reason): each key once, with the reason of the first ledger that holds it, or null."""
    keys, out = rows.select(key).distinct(), F.lit(None).cast("string")
    for k, (ledger, _) in enumerate(ledgers):
        keys = keys.join(ledger.select(key).distinct().withColumn(f"_l{k}", F.lit(True)), key, "left")
    for k, (_, reason) in reversed(list(enumerate(ledgers))):
        out = F.when(F.col(f"_l{k}"), reason).otherwise(out)
    return keys.select(key, out.alias("reason"))


def newest(rows: DataFrame, key: list[str], most: int, *order: Column) -> DataFrame:
    """The first ``most`` rows of each key in an order (newest first). The bound applies before rows are shuffled."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def repeats(rows: DataFrame, identity: str, item: str) -> DataFrame:
    """Rows whose identity a row with a lesser item has too."""
    first = rows.groupBy(identity).agg(F.min(item).alias("_first"))
    return rows.join(first, identity).where(F.col(item) > F.col("_first")).drop("_first")


def kind_counts(rows: DataFrame, key: list[str], item: str, amount: str) -> DataFrame:
    """(key, n, amount, first, last) of each kind."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias(amount), F.min(item).alias("first"), F.max(item).alias("last"))


def main_value(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, rows, main, values): how many rows and different values a key has, and its most frequent value (the greatest of
    equals)."""
    n = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.sum("n").alias("rows"), F.max_by(value, F.struct("n", value)).alias("main"), F.count(F.lit(1)).alias("values"))


def omitted(rows: DataFrame, key: list[str], hidden: Column) -> DataFrame:
    """(key, omitted, n): how many rows of each category are not shown, of how many."""
    return rows.groupBy(*key).agg(F.count_if(hidden).alias("omitted"), F.count(F.lit(1)).alias("n"))


def plan_counts(moves: DataFrame, plan: str, folder: str, moved: Column) -> DataFrame:
    """(plan, files, folders, moved) of plans that move files into folders."""
    return moves.groupBy(plan).agg(F.count(F.lit(1)).alias("files"), F.count_distinct(folder).alias("folders"), F.count_if(moved).alias("moved"))


def preflight(rows: DataFrame, test: Column, sample: int, *order: Column) -> DataFrame:
    """(sampled, html, warn): whether more than half of the first ``sample`` rows fail a test."""
    seen = rows.orderBy(*order).limit(sample).select(test.alias("_t"))
    return seen.agg(F.count(F.lit(1)).alias("sampled"), F.count_if("_t").alias("html")).withColumn("warn", F.col("html") * 2 > F.col("sampled"))


def conversations(turns: DataFrame, key: str, turn: str, role: str, text: str, user: str = "user") -> DataFrame:
    """(key, turns, user_turns, chars, first_turn, last_turn) of each conversation."""
    return turns.groupBy(key).agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col(role) == user).alias("user_turns"), F.sum(F.char_length(text)).alias("chars"), F.min(turn).alias("first_turn"), F.max(turn).alias("last_turn"))


def running_totals(rows: DataFrame, key: list[str], amount: str, *order: str) -> DataFrame:
    """``rows`` with ``running``: the sum of the amount up to each row of its key; the mean of a range is the difference of two over
    its rows (:func:`range_mean`)."""
    return rows.withColumn("running", F.sum(amount).over(W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def range_mean(totals: Column, start: Column, stop: Column) -> Column:
    """The mean of places start .. stop (half open) by an array of prefix sums that begins with 0; 0 for an empty range."""
    return F.when(stop > start, (F.get(totals, stop) - F.get(totals, start)) / (stop - start)).otherwise(0.0)


def set_signature(rows: DataFrame, name: str, *facts: str) -> DataFrame:
    """(signature): a SHA-256 over the few sources that a table comes from, in any order; null names are empty."""
    line = F.concat_ws("|", F.coalesce(F.col(name), F.lit("")), *(F.col(f).cast("string") for f in facts))
    return rows.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("signature"))
