"""Unions, upserts and differences of keyed rows, and summaries of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.order import with_before

#: Rows of a page of sorted values.
PAGE = 8_192


def first_seen(parts: list[DataFrame], key: Column, *order: str) -> DataFrame:
    """One row a key over several tables with the same columns: of the earlier table, then the first in order."""
    every = parts[0].withColumn("_part", F.lit(0))
    for k, p in enumerate(parts[1:], 1):
        every = every.unionByName(p.withColumn("_part", F.lit(k)))
    best = every.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*parts[0].columns), F.struct("_part", *order)).alias("_r"))
    return best.select("_r.*")


def without_changed(pairs: DataFrame, changed: DataFrame, item: str) -> DataFrame:
    """Pairs (a, b) neither of whose items has changed."""
    gone = changed.select(F.col(item).alias("_x")).distinct()
    return pairs.join(gone, F.col("a") == F.col("_x"), "left_anti").join(gone, F.col("b") == F.col("_x"), "left_anti")


def inverted(view: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """The selection after inverting it over a view: what is selected outside of it, and what in it was not."""
    inside, chosen = view.select(key).distinct(), selected.select(key).distinct()
    return chosen.join(inside, key, "left_anti").unionByName(inside.join(chosen, key, "left_anti"))


def merged_records(old: DataFrame, new: DataFrame, keys: list[str], facts: list[str], state: str, ranks: list[str]) -> DataFrame:
    """Records by key: a fact of the old row stays, the new one fills what is missing; the further state wins."""
    n = new.select(*keys, *(F.col(c).alias(f"_{c}") for c in (*facts, state)))
    rank = lambda c: F.coalesce(F.array_position(F.array(*map(F.lit, ranks)), c), F.lit(0))
    best = F.when(rank(F.col(f"_{state}")) > rank(F.col(state)), F.col(f"_{state}")).otherwise(F.col(state))
    return old.join(n, keys, "full_outer").select(*keys, *(F.coalesce(c, f"_{c}").alias(c) for c in facts), best.alias(state))


def primaries(rows: DataFrame, group: str, item: str, *best: Column) -> DataFrame:
    """(group, primary, members): the item that ranks first by ``best`` (larger is better), and how many there are."""
    return rows.groupBy(group).agg(F.max(F.struct(*best, F.col(item).alias("_i"))).alias("b"), F.count(F.lit(1)).alias("members")).select(group, F.col("b._i").alias("primary"), "members")


def cluster_summary(pairs: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """(component, members, n_duplicate, n_variant, kinds) of pairs (a, b, kind) by the component of their ends."""
    inner = pairs.join(nodes.withColumnRenamed("node", "a"), "a")
    counts = inner.groupBy("component").agg(F.count_if(F.col(kind) == "duplicate").alias("n_duplicate"), F.count_if(F.col(kind) == "variant").alias("n_variant"), F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("kinds"))
    return counts.join(nodes.groupBy("component").agg(F.count(F.lit(1)).alias("members")), "component")


def membership(nodes: DataFrame, pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """(component, node, link): representative, direct (a pair joins it to the representative) or indirect."""
    # only pairs with a representative matter, and these are few
    chosen = heads.select(F.col("representative").alias("b")).distinct()
    ends = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(chosen, "b", "left_semi").distinct().withColumn("_d", F.lit(True))
    rows = nodes.join(heads.select("component", "representative"), "component")
    link = rows.join(ends, (F.col("node") == F.col("a")) & (F.col("representative") == F.col("b")), "left")
    how = F.when(F.col("node") == F.col("representative"), "representative").when(F.col("_d"), "direct").otherwise("indirect")
    return link.select("component", "node", how.alias("link"))


def have_common(a: DataFrame, b: DataFrame, key: Column) -> bool:
    """Whether two tables share a key; the search ends with the first one."""
    return bool(a.select(key.alias("_k")).join(b.select(key.alias("_k")), "_k", "left_semi").limit(1).count())


def reconciled(selected: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """What is selected and still known."""
    return selected.join(known.select(key), key, "left_semi")


def mutual_nearest(a: DataFrame, b: DataFrame, distance: Column, ratio: float, *on: str) -> DataFrame:
    """(on, a, b, distance) of descriptors (id, ...) that are each other's nearest within the same block ``on``, with the second
    nearest at least 1 / ratio as far. Blocks bound what is compared: pairs are formed within one only, and of each
    descriptor's pairs but two are kept before anything is shuffled for their sake."""
    pairs = a.select(*on, F.struct(*a.columns).alias("x")).join(b.select(*on, F.struct(*b.columns).alias("y")), list(on)).select(*on, F.col("x.id").alias("a"), F.col("y.id").alias("b"), distance.alias("d"))

    def clear(own: str, other: str) -> DataFrame:
        nearest = W.partitionBy(*on, own).orderBy("d", other)
        two = pairs.withColumn("_r", F.row_number().over(nearest)).where("_r <= 2")
        best = two.groupBy(*on, own).agg(F.min_by(other, "_r").alias(other), F.min("d").alias("distance"), F.max(F.when(F.col("_r") == 2, F.col("d"))).alias("_next"))
        return best.where(F.col("_next").isNull() | (F.col("distance") < ratio * F.col("_next"))).drop("_next")

    return clear("a", "b").join(clear("b", "a").drop("distance"), [*on, "a", "b"])


def mutual_nearest_by_value(a: DataFrame, b: DataFrame, value: str, ratio: float, *on: str) -> DataFrame:
    """:func:`mutual_nearest` of descriptors that are numbers, for a ratio of at most 1, with no pair formed that is not a result's.

    Of equal distances none is nearest by the ratio, so two descriptors that are each other's are neighbours in the order of values: equal
    and alone, or next to each other and alone. Their second nearest are the next values of the other side below and above. Values are
    counted first and sorted once by range; from page to page only the last values are carried, so a block may be of any size.
    Descriptors whose value or block is null or whose value is NaN have no distance and are left out."""
    if not 0 < ratio <= 1:
        raise ValueError("values are told apart for a ratio above 0 and up to 1")
    v, sides = F.col("v"), (("a", a), ("b", b))
    rows = [d.select(*on, F.col(value).alias("v"), *((F.col("id") if s == name else F.lit(None).cast(d.schema["id"].dataType)).alias(s) for s in "ab")) for name, d in sides]
    whole = rows[0].unionByName(rows[1]).dropna(subset=[*on, "v"]).where(~F.isnan(v.cast("double")))
    values = whole.groupBy(*on, "v").agg(*(f(s).alias(n + s) for s in "ab" for n, f in (("n", F.count), ("i", F.min)))).withColumn("_one", F.lit(1))
    paged = with_before(values, [*on, "v"], "_one").withColumn("page", F.floor(F.col("before") / PAGE))
    for s in "ab":
        paged = paged.withColumn(f"v{s}", F.when(F.col(f"n{s}") > 0, v))
    pages = paged.groupBy(*on, "page").agg(*(f(f"v{s}").alias(f"{n}{s}") for s in "ab" for n, f in (("most", F.max), ("least", F.min))))

    def running(c: str, keys: list[str], order: str, names: tuple[str, str], most: str, least: str) -> list[Column]:
        """The largest value before and the least after; both frames grow, which takes a pass (a shrinking one is made anew each row)."""
        over = lambda o: W.partitionBy(*on, *keys).orderBy(o).rowsBetween(W.unboundedPreceding, -1)
        return [F.max(f"{most}{c}").over(over(F.asc(order))).alias(f"{names[0]}{c}"), F.min(f"{least}{c}").over(over(F.desc(order))).alias(f"{names[1]}{c}")]

    carried = pages.select(*on, "page", *(c for s in "ab" for c in running(s, [], "page", ("from", "to"), "most", "least")))
    near = paged.select("*", *(c for s in "ab" for c in running(s, ["page"], "before", ("_below", "_above"), "v", "v"))).join(carried, [*on, "page"])
    near = near.select(*on, "before", "v", "na", "nb", "ia", "ib", *(c for s in "ab" for c in (F.coalesce(f"_below{s}", f"from{s}").alias(f"below{s}"), F.coalesce(f"_above{s}", f"to{s}").alias(f"above{s}"))))

    def clear(low: Column, high: Column, below: Column, above: Column, own: Column) -> Column:
        """Whether the second nearest of a descriptor at ``own`` is far enough away."""
        second = F.least(own - below, above - own)
        return second.isNull() | (high - low < ratio * second)

    same = near.where((F.col("na") == 1) & (F.col("nb") == 1)).where(clear(v, v, F.col("belowb"), F.col("aboveb"), v) & clear(v, v, F.col("belowa"), F.col("abovea"), v))
    found = same.select(*on, F.col("ia").alias("a"), F.col("ib").alias("b"), (v - v).alias("distance"))
    for low, high in ("ab", "ba"):
        alone = lambda s, o: near.where((F.col(f"n{s}") == 1) & (F.col(f"n{o}") == 0))
        x, y = alone(low, high).alias("x").withColumn("_next", F.col("before") + 1), alone(high, low).alias("y")
        both = x.alias("x").join(y, (F.col("x._next") == F.col("y.before")) & F.expr(" AND ".join(["true", *(f"x.{c} = y.{c}" for c in on)])))
        p, q = F.col("x.v"), F.col("y.v")
        good = both.where(clear(p, q, F.col(f"x.below{high}"), F.col(f"y.above{high}"), p) & clear(p, q, F.col(f"x.below{low}"), F.col(f"y.above{low}"), q))
        found = found.unionByName(good.select(*(F.col(f"x.{c}").alias(c) for c in on), *(F.col(f"{'x' if s == low else 'y'}.i{s}").alias(s) for s in "ab"), (q - p).alias("distance")))
    return found
