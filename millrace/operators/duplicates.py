"""Exact and near duplicates of records: groups, survivors, band joins, Hamming joins, components, representatives."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.graph import connected_components, hop_sums
from millrace.operators import hamming
from millrace.operators.hamming import item_pairs, links
from millrace.operators.order import with_before
from millrace.plans.materialize import materialize, release


def exact_groups(df: DataFrame, key: Column, item: str) -> DataFrame:
    """Each item of a group of two or more with equal keys: key, item, the group's size and its first item."""
    keyed = df.select(F.col(item), key.alias("identity"))
    groups = keyed.groupBy("identity").agg(F.count(F.lit(1)).alias("n"), F.min(item).alias("first")).where("n > 1")
    return keyed.join(groups, "identity")


def survivors(groups: DataFrame, item: str) -> DataFrame:
    """Adds whether the item stays: the first of each group does."""
    return groups.withColumn("survives", F.col(item) == F.col("first"))


#: Rows of a page of sorted rows; pages overlap by the neighbours that are looked at.
PAGE = 8_192


def band_pairs(df: DataFrame, value: str, item: str, group: list[str], floor: float = 0.35, share: float = 0.015, neighbours: int | None = 60) -> DataFrame:
    """(group, a, va, b, vb): each row with those of its next ``neighbours`` by value (then item) that are within
    max(floor, share of the lower value). Values that are null or not positive are left out.

    Rows are sorted once by range partitions; from its place in that order a row goes to its page and, if it is among the
    first of one, to the page before. So work is rows x neighbours, however dense the values or large a group. With no bound
    on neighbours values are cut into bins on a log scale instead, at least as wide as the tolerance, and joined with their own
    and the next bin: then work follows the pairs.
    """
    v = F.col(value)
    if neighbours is None:
        return _binned_pairs(df, value, item, group, floor, share)
    if neighbours > PAGE:
        raise ValueError(f"at most {PAGE} neighbours fit a page")
    rows = df.where(v > 0).select(*group, F.col(item).alias("b"), v.alias("vb"), F.lit(1).alias("_one"))
    placed = with_before(rows, [*group, "vb", "b"], "_one")
    page, inside = F.floor(F.col("before") / PAGE), F.pmod("before", F.lit(PAGE))
    paged = placed.select("*", F.explode(F.when(inside < neighbours, F.array(page, page - 1)).otherwise(F.array(page))).alias("_page")).withColumn("_own", F.col("_page") == page)
    after = W.partitionBy("_page").orderBy("before").rowsBetween(1, neighbours)
    seen = paged.select(*group, F.col("b").alias("a"), F.col("vb").alias("va"), "_own", F.collect_list(F.struct(*group, "b", "vb")).over(after).alias("_next")).where("_own")
    pairs = seen.select(*(F.col(g).alias(f"_g{k}") for k, g in enumerate(group)), "a", "va", F.inline("_next"))
    for k, g in enumerate(group):
        pairs = pairs.where(F.col(f"_g{k}").eqNullSafe(F.col(g)))
    return pairs.where(F.col("vb") - F.col("va") <= F.greatest(F.lit(floor), F.col("va") * share)).select(*group, "a", "va", "b", "vb")


def _binned_pairs(df: DataFrame, value: str, item: str, group: list[str], floor: float, share: float) -> DataFrame:
    v, turn = F.col(value), floor / share
    linear, logs = F.floor(v / floor), F.floor(F.log(F.greatest(v, F.lit(turn)) / turn) / F.log1p(F.lit(share))) + F.floor(F.lit(turn / floor))
    rows = df.where(v > 0).withColumn("_bin", F.when(v < turn, linear).otherwise(logs).cast("bigint"))
    left = rows.select(*group, F.col(item).alias("a"), v.alias("va"), F.explode(F.array(F.col("_bin"), F.col("_bin") + 1)).alias("_bin"))
    right = rows.select(*group, F.col(item).alias("b"), v.alias("vb"), "_bin")
    after = (F.col("vb") > F.col("va")) | ((F.col("vb") == F.col("va")) & (F.col("b") > F.col("a")))
    return left.join(right, [*group, "_bin"]).where(after & (F.col("vb") - F.col("va") <= F.greatest(F.lit(floor), F.col("va") * share))).drop("_bin")


def hamming_pairs(df: DataFrame, item: str, bits: str, radius: int) -> DataFrame:
    """(a, b, distance) of all pairs within the radius."""
    return item_pairs(df, item, bits, radius)


def group_order(label: Column, members: Column, first: Column) -> list[Column]:
    """Sort columns of groups of duplicates: identical ones first, then the larger, then by their first member."""
    return [(label != "identical").cast("int").asc(), members.desc(), F.lower(first).asc(), first.asc()]


def cluster_order(first: Column, item: Column) -> list[Column]:
    """Sort columns of clusters: by the path of their first member in any case, then by their id."""
    return [F.lower(first).asc(), item.asc()]


def merge_edges(*kinds: tuple[DataFrame, str, int]) -> DataFrame:
    """One edge for each unordered pair of the tables (a, b), with the kind of the highest priority."""
    parts = [e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(k).alias("kind"), F.lit(p).alias("p")) for e, k, p in kinds]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("a", "b").agg(F.max_by("kind", "p").alias("kind"))


def components(pairs: DataFrame) -> DataFrame:
    """(node, component) of the pairs (a, b)."""
    return connected_components(pairs, "a", "b")


def representatives(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(component, representative, size, degree): the member with the most neighbours, the smallest of equals."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    ranked = nodes.join(ends, "node")
    return ranked.groupBy("component").agg(F.min(F.struct(-F.col("degree"), "node")).alias("best"), F.count(F.lit(1)).alias("size")).select("component", F.col("best.node").alias("representative"), "size", (-F.col("best.col1")).alias("degree"))


def closeness_representatives(pairs: DataFrame, nodes: DataFrame, weight: str | None = None) -> DataFrame:
    """(component, representative, hops): the member with the least sum of hop distances to the others, then the most
    neighbours, then the largest sum of its pairs' ``weight``, then the smallest. Distances come from a breadth-first search from all members
    at once (:func:`graph.hop_sums`): its work is the square of a component's size, dealt over all tasks; for very large components use
    :func:`representatives`."""
    both = pairs.select("a", "b", (F.col(weight) if weight else F.lit(0)).alias("w")).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), (F.col(weight) if weight else F.lit(0)).alias("w")))
    own = both.groupBy("a", "b").agg(F.max("w").alias("w")).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("weight"))
    sums = hop_sums(pairs, "a", "b")
    ranked = nodes.join(own, "node").join(sums, "node")
    best = F.min(F.struct("hops", (-F.col("degree")).alias("d"), (-F.col("weight")).alias("w"), "node")).alias("m")
    return ranked.groupBy("component").agg(best).select("component", F.col("m.node").alias("representative"), F.col("m.hops").alias("hops"))


#: Items of a group that a round tells apart one by one, in a task; near ones an item has on average from which on clusters are
#: made in rounds; items that this is estimated from.
HEAD, CROWD, SAMPLE = 4096, 32, 4096


def _crowded(firsts: DataFrame, threshold: int, n: int) -> bool:
    """Whether items have many near ones, by a sample; only the way to the result depends on it."""
    share = max(1, ceil(n / SAMPLE))
    some = materialize(firsts.where(F.pmod(F.xxhash64("g", "bits"), F.lit(share)) == 0).select("g", F.col("bits").alias("x")), "sample")
    near = some.join(some.withColumnRenamed("x", "y"), "g").where((F.col("x") != F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= threshold)).count()
    size = some.count()
    release(some)
    return near * share > CROWD * size


def _serial(threshold: int):
    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a group's items those that lead, each in its turn (``n``)."""
        t = pa.Table.from_batches(batches).combine_chunks().sort_by("n")
        bits, free, leads = t["bits"].to_numpy().view(np.uint64), np.ones(len(t), bool), []
        for i in range(len(t)):
            if free[i]:
                leads.append(i)
                free[i:] &= np.bitwise_count(bits[i:] ^ bits[i]) > threshold
        yield from t.select(["g", "first", "bits"]).rename_columns(["g", "leader", "lead_bits"]).take(pa.array(leads, pa.int64())).to_batches()

    return leading


def _led_by_rounds(firsts: DataFrame, threshold: int) -> DataFrame:
    """(first, leader), self included: a round finds the leaders among the first HEAD free items of each group, and every item
    near one of them is free no more. No pairs are written, only what is led."""
    free, led = materialize(firsts, "free-items"), []
    while True:
        turn = F.row_number().over(W.partitionBy("g").orderBy("first"))
        heads = free.withColumn("n", turn).where(F.col("n") <= HEAD).select("g", "first", "bits", "n")
        kinds = {f.name: f.dataType.simpleString() for f in free.schema}
        leads = materialize(heads.groupBy("g").applyInArrow(_serial(threshold), f"g {kinds['g']}, leader {kinds['first']}, lead_bits bigint"), "leads")
        near = free.join(leads, "g").where(F.bit_count(F.col("bits").bitwiseXOR(F.col("lead_bits"))) <= threshold)
        found = materialize(near.groupBy("g", "bits", "first").agg(F.min("leader").alias("leader")), "led-items")
        led.append(found.select("first", "leader"))
        last, free = free, materialize(free.join(found.select("g", "bits"), ["g", "bits"], "left_anti"), "free-items")
        release(last, leads)
        if not free.limit(1).count():
            release(free)
            break
    every = led[0]
    for part in led[1:]:
        every = every.unionByName(part)
    return every


def leaders(df: DataFrame, item: str, bits: str, group: list[str], threshold: int = 8) -> DataFrame:
    """(group, item, leader): greedy clusters in item order, the first unused item leads all unused ones within the threshold.
    Items without a hash lead themselves.

    The serial order is kept, in parallel: of near pairs (by the Hamming index, classes of equal hashes at once) the earlier item
    stands in the later one's way. In a round every item that nothing stands in the way of leads, what is near it is led,
    and pairs of led items go; the pairs that are left are written. An item's leader is the first near it. Rounds are few where order and
    likeness have nothing to do with each other; a chain in item order, each near the next only, needs half its length.

    Where an item has many near ones the pairs would be a good part of all: there few lead, and the leaders are found from the front
    of each group, HEAD items a round, with no pairs written (:func:`_led_by_rounds`).
    """
    if hamming.dense(hamming.plan(threshold, n := hamming.distinct_hashes(df, bits))):
        firsts, members = hamming.classes(df, item, bits, tuple(group))
        if _crowded(firsts, threshold, n):
            leads = members.join(_led_by_rounds(firsts, threshold), "first").select(F.col("item").alias("_item"), F.col("leader").alias("_leader"))
            return df.join(leads, F.col(item) == F.col("_item"), "left").select(*group, item, F.coalesce("_leader", item).alias("leader"))
    near, members = links(df, item, bits, threshold, tuple(group))
    written = materialize(near.select("a", "b"), "near-items")
    still, led = written, []
    while still.limit(1).count():
        heads = still.select("a").distinct().join(still.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        gone = materialize(still.join(heads, "a", "left_semi").select(F.col("b").alias("x")).distinct(), "led-items")
        left = still.join(gone, F.col("a") == F.col("x"), "left_anti").join(gone, F.col("b") == F.col("x"), "left_anti")
        last, still = still, materialize(left, "near-items")
        led.append(gone)
        if last is not written:
            release(last)
    release(*([still] if still is not written else []))
    every = written.limit(0).select(F.col("b").alias("x"))
    for part in led:
        every = every.unionByName(part)
    first = written.join(every, F.col("a") == F.col("x"), "left_anti").join(every, F.col("b") == F.col("x"), "left_semi").groupBy(F.col("b").alias("first")).agg(F.min("a").alias("leader"))
    leads = members.join(first, "first", "left").select(F.col("item").alias("_item"), F.coalesce("leader", "first").alias("_leader"))
    return df.join(leads, F.col(item) == F.col("_item"), "left").select(*group, item, F.coalesce("_leader", item).alias("leader"))
