"""A suffix sort of many short strings by the difference cover modulo 3, as Spark jobs.

Strings are rows (id, s) of symbols from 1 on. Each step is a range-partitioned sort or an aggregation of the whole table:

1. Triples at the places that are 1 or 2 modulo 3 are sorted and named by the number of lesser ones.
2. The names of a string, those of places 1 and then, behind a 0, those of places 2, are its string one level up. Levels
   go on until a symbol spans the depth that is asked for; there the names are ranks.
3. On the way down, the suffixes at places 0 are merged with the sampled ones: by (symbol, rank behind it) with those at
   places 1, and by (two symbols, rank behind them) with those at places 2. A suffix's rank is the number of suffixes that
   are less, taken from running sums over the sorted distinct keys.

A 0 stands for the end of a string and for what lies behind it; it has rank 0 and is never counted. Suffixes that differ
within the depth are in order; those that agree on it stand together. Frequent keys are aggregated
before they are sorted, and what the driver sees is a number or an edge of each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.plans.materialize import materialize, release

_ROW = (1 << 33) - 1


def _sorted(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows in the order of the keys, with the range partition ``pid`` and the place in it, ``at``; written."""
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("m", F.monotonically_increasing_id())
    return materialize(placed.select(*df.columns, F.shiftright("m", 33).cast("int").alias("pid"), F.col("m").bitwiseAND(F.lit(_ROW)).alias("at")), "sorted")


def _before(totals: DataFrame, columns: list[str]) -> DataFrame:
    """(pid, b_<column>...): what the partitions before each one sum to; a row a partition."""
    rows, so_far, out = sorted(totals.collect(), key=lambda r: r["pid"]), [0] * len(columns), []
    for r in rows:
        out.append((r["pid"], *so_far))
        so_far = [x + r[c] for x, c in zip(so_far, columns, strict=True)]
    return totals.sparkSession.createDataFrame(out, "pid int, " + ", ".join(f"b_{c} long" for c in columns))


def less(keyed: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """Of distinct keys with counts, the sums of the counts of all lesser keys, in place of the counts."""
    at = _sorted(keyed, keys)
    before = _before(at.groupBy("pid").agg(*(F.sum(c).alias(c) for c in counts)), counts)
    run = W.partitionBy("pid").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    sums = [(F.coalesce(F.sum(c).over(run), F.lit(0)) + F.col(f"b_{c}")).alias(c) for c in counts]
    return at.join(F.broadcast(before), "pid").select(*keys, *sums)


def _symbol(s: str, i: Column) -> Column:
    """The number at a place, 0 behind the end."""
    return F.coalesce(F.get(s, i), F.lit(0).cast("long"))


def _places(df: DataFrame, at) -> DataFrame:
    """A row (id, i, ...) for each place of each string, with the columns that ``at`` makes of the place."""
    each = F.transform(F.sequence(F.lit(0), F.size("s") - 1), lambda i: F.struct(i.alias("i"), *at(i)))
    return df.select("id", F.explode(each).alias("x")).select("id", "x.*")


def _upper(strings: DataFrame) -> DataFrame:
    """The strings one level up: (id, s). A triple's name is one more than the number of triples that are less."""
    at = _places(strings, lambda i: [_symbol("s", i + k).alias(n) for k, n in enumerate("abc")]).where("i % 3 <> 0")
    at = materialize(at, "triples")
    names = less(at.where("a > 0").groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("n")), ["a", "b", "c"], ["n"])
    named = at.join(names, ["a", "b", "c"]).select("id", "i", (F.col("n") + 1).alias("name")).unionByName(at.where("a = 0").select("id", "i", F.col("a").alias("name")))
    named = named.select("id", F.struct((F.col("i") % 3).alias("k"), "i", "name").alias("x"))
    whole = named.groupBy("id").agg(F.sort_array(F.collect_list("x")).alias("x"))  # at most a string's own length
    side = lambda k: F.transform(F.filter("x", lambda x: x["k"] == k), lambda x: x["name"])
    out = materialize(whole.select("id", F.concat(side(1), F.array(F.lit(0).cast("long")), side(2)).alias("s")), "level")
    release(at)
    return out


def _down(strings: DataFrame, ranks: DataFrame) -> DataFrame:
    """(id, r): the ranks of all suffixes of ``strings`` from those of the strings one level up."""
    ones = F.floor((F.size("s") + 1) / 3).cast("int")
    rank = lambda i: F.when(i % 3 == 1, _symbol("r", F.floor(i / 3).cast("int"))).when(i % 3 == 2, _symbol("r", ones + 1 + F.floor(i / 3).cast("int")))
    inside = lambda i: F.when(i < F.size("s"), rank(i)).otherwise(F.lit(0).cast("long"))
    both = strings.join(ranks, "id", "left")
    at = _places(both, lambda i: [_symbol("s", i).alias("a"), _symbol("s", i + 1).alias("b"), rank(i).alias("own"), inside(i + 1).alias("r1"), inside(i + 2).alias("r2")])
    every = materialize(at.withColumn("k", F.col("i") % 3), "places")
    at = every.where("a > 0")
    zero = F.count_if(F.col("k") == 0)
    one = less(at.where("k < 2").groupBy("a", "r1").agg(zero.alias("z1"), F.count_if(F.col("k") == 1).alias("n1")), ["a", "r1"], ["z1", "n1"])
    two = less(at.where("k <> 1").groupBy("a", "b", "r2").agg(zero.alias("z2"), F.count_if(F.col("k") == 2).alias("n2")), ["a", "b", "r2"], ["z2", "n2"])
    one, two = materialize(one, "less"), materialize(two, "less")
    zeros = at.where("k = 0").join(one, ["a", "r1"]).join(two, ["a", "b", "r2"]).select("id", "i", (F.col("z1") + F.col("n1") + F.col("n2") + 1).alias("r"))
    first = at.where("k = 1").join(one, ["a", "r1"]).select("id", "i", (F.col("own") + F.col("z1")).alias("r"))
    second = at.where("k = 2").join(two, ["a", "b", "r2"]).select("id", "i", (F.col("own") + F.col("z2")).alias("r"))
    ends = every.where("a = 0").select("id", "i", F.col("a").alias("r"))
    ranked = zeros.unionByName(first).unionByName(second).unionByName(ends).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("i", "r"))).alias("x"))
    out = materialize(ranked.select("id", F.transform("x", lambda x: x["r"]).alias("r")), "ranks")
    release(every, one, two)
    return out


def suffix_ranks(strings: DataFrame, depth: int, span: int = 1) -> DataFrame:
    """(id, r): for each string the ranks of its suffixes, such that suffixes that differ within ``depth`` characters are
    in order. ``strings`` (id, s array<long>) is a written table with distinct ids; a symbol spans ``span`` characters."""
    if span >= depth:
        return strings.select("id", F.col("s").alias("r"))
    upper = _upper(strings)
    ranks = suffix_ranks(upper, depth, 3 * span)
    out = _down(strings, ranks)
    release(upper, ranks)
    return out


def repeated_prefixes(windows: DataFrame) -> DataFrame:
    """(id, i) of the rows (id, i, r, p) that stand beside a row with the same prefix p in the order of the ranks r."""
    at = _sorted(windows, ["r", "p", "id", "i"])
    ends = at.groupBy("pid").agg(F.min_by("p", "at").alias("first"), F.max_by("p", "at").alias("last")).collect()  # a row a partition
    ends = sorted(ends, key=lambda r: r["pid"])
    edges = [(b["pid"], a["last"], c["first"]) for a, b, c in zip([{"last": None}, *ends], ends, [*ends[1:], {"first": None}], strict=False)]
    edges = windows.sparkSession.createDataFrame(edges, "pid int, up binary, down binary")
    w = W.partitionBy("pid").orderBy("at")
    same = lambda f, edge: F.coalesce(F.coalesce(f("p").over(w), F.col(edge)) == F.col("p"), F.lit(False))
    return at.join(F.broadcast(edges), "pid").withColumn("hit", same(F.lag, "up") | same(F.lead, "down")).where("hit").select("id", "i")
