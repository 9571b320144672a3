"""Connected components over an edge table, by alternating large-star and small-star rewrites.

Every step is a join or an aggregation with partial combine, so a hub with a third of all edges is neither collected
nor windowed; adaptive execution splits its partition. Each round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.materialize import materialize, release

#: Edges in one direction each, of a graph that is broadcast (32 MB): beyond that rings are joined. Sources that are searched from
#: at a time, at most and at least, and bytes of their distances; rows of a batch; edges from which a partition's are folded first.
SMALL, SOURCES, LEAST, SPACE, BATCH, MANY = 1 << 21, 512, 64, 1 << 25, 1 << 18, 1 << 20
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of the nodes 0 .. n - 1 is connected with."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return root


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of a forest that spans a partition's edges: of them no more are held than nodes and a batch."""
    kept, schema = None, None
    for batch in batches:
        schema = batch.schema
        ends = np.stack([batch.column(k).to_numpy() for k in (0, 1)])
        ends = ends if kept is None else np.concatenate([kept, ends], axis=1)
        nodes, places = np.unique(ends, return_inverse=True)
        root = _roots(*places.reshape(2, -1), len(nodes))
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        kept = np.stack([nodes[moved], nodes[root[moved]]])
    if kept is not None and kept.shape[1]:
        yield pa.RecordBatch.from_arrays([pa.array(k) for k in kept], schema=schema)


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node that has an edge to another node; component is the smallest node reachable.

    Nodes may be of any type that Spark can order and hash. Edges with a null end and loops are ignored; repeated and
    reversed edges count once; an empty edge table gives an empty result.
    """
    e = (
        edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
        .select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .distinct()
    )
    e = materialize(e, "edges")
    seen = _signature(e)
    while seen[0] > MANY and e.schema["u"].dataType.simpleString() in _WHOLE:
        # dense graphs have far more edges than nodes: tasks fold theirs first, as long as that halves them
        folded = materialize(e.mapInArrow(_forest, e.schema), "edges")
        now = _signature(folded)
        if 2 * now[0] > seen[0]:
            release(folded)
            break
        release(e)
        e, seen = materialize(folded.repartition(max(1, folded.rdd.getNumPartitions() // 4), "v"), "edges"), now
        release(folded)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        last, e = e, materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        release(last, large)
        now = _signature(e)
        if now == seen:
            break
        seen = now
    ends = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return ends.unionByName(roots)


def _both_ways(edges: DataFrame, src: str, dst: str) -> DataFrame:
    one = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).select(F.col(src).alias("u"), F.col(dst).alias("v"))
    return materialize(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "hops")


def _rings(both: DataFrame) -> DataFrame:
    """Distances by a join a hop: the last ring is joined with the edges, and what the last two rings hold is dropped (in an undirected
    graph a neighbour of ring k lies in ring k - 1, k or k + 1). Rings are written."""
    start = both.select(F.col("u").alias("source"), F.col("u").alias("node")).distinct()
    rings = [materialize(start, "hops"), materialize(both.select(F.col("u").alias("source"), F.col("v").alias("node")), "hops")]
    while True:
        reached = rings[-1].join(both.withColumnRenamed("u", "node"), "node").select("source", F.col("v").alias("node")).distinct()
        ring = materialize(reached.join(rings[-1], ["source", "node"], "left_anti").join(rings[-2], ["source", "node"], "left_anti"), "hops")
        if not ring.limit(1).count():
            break
        rings.append(ring)
    release(both, ring)
    out = rings[0].withColumn("hops", F.lit(0))
    for k, r in enumerate(rings[1:], 1):
        out = out.unionByName(r.withColumn("hops", F.lit(k)))
    return out


class _Graph:
    """Edges in both directions as arrays, nodes numbered by component, so that a search stays within a range of them."""

    def __init__(self, u: np.ndarray, v: np.ndarray):
        nodes, places = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = places.reshape(2, -1)
        root = _roots(a, b, len(nodes))
        order = np.argsort(root, kind="stable")
        number = np.empty_like(order)
        number[order] = np.arange(len(order))
        self.nodes, root = nodes[order], root[order]
        self.first, self.end = np.searchsorted(root, root, "left"), np.searchsorted(root, root, "right")
        by = np.lexsort((number[a], number[b]))
        self.u, self.starts = number[a][by], np.searchsorted(number[b][by], np.arange(len(nodes) + 1))

    def search(self, begin: int, stop: int) -> tuple[int, Iterator[tuple[int, np.ndarray, np.ndarray]]]:
        """The first node in reach of the sources begin .. stop - 1, and for each ring its number, the nodes (from there on) that
        are new to a source, and for which ones, as bits."""
        low, high = self.first[begin], self.end[stop - 1]
        u, starts = self.u[self.starts[low] : self.starts[high]] - low, self.starts[low:high] - self.starts[low]

        def rings():
            width = -(-(stop - begin) // 64)
            front = np.zeros((high - low, width), np.uint64)
            at = np.arange(stop - begin)
            front[begin - low + at, at // 64] = np.uint64(1) << (at % 64).astype(np.uint64)
            reached, k = front.copy(), 0
            while True:
                new = np.flatnonzero(front.any(axis=1))
                if not len(new):
                    return
                yield k, new, front[new]
                front, k = np.bitwise_or.reduceat(front[u], starts, axis=0) & ~reached, k + 1
                reached |= front

        return low, rings()


def _unpacked(bits: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(bits.view(np.uint8), axis=1, count=n, bitorder="little")


def _distances(graph: _Graph, begin: int, stop: int) -> Iterator[list[np.ndarray]]:
    low, rings = graph.search(begin, stop)
    hops = np.full((stop - begin, graph.end[stop - 1] - low), -1, np.int32)
    for k, new, bits in rings:
        s, n = np.nonzero(_unpacked(bits, stop - begin).T)
        hops[s, new[n]] = k
    step = max(1, BATCH // hops.shape[1])
    for at in range(0, stop - begin, step):
        s, n = np.nonzero(hops[at : at + step] >= 0)
        yield [graph.nodes[begin + at + s], graph.nodes[low + n], hops[at + s, n]]


def _sums(graph: _Graph, begin: int, stop: int) -> Iterator[list[np.ndarray]]:
    total = np.zeros(stop - begin, np.int64)
    for k, _, bits in graph.search(begin, stop)[1]:
        # up to 255 rows are added as bytes
        for at in range(0, len(bits), 255 * 64):
            some = _unpacked(bits[at : at + 255 * 64], stop - begin)
            whole = len(some) // 255 * 255
            total += k * some[:whole].reshape(-1, 255, stop - begin).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
            total += k * some[whole:].sum(0, dtype=np.int64)
    yield [graph.nodes[begin:stop], total]


def _searched(both: DataFrame, n: int, each: Callable, schema: str, wide: bool) -> DataFrame:
    """What ``each`` gives of a small graph's sources, a few at a time: the graph is broadcast, sources are dealt out."""
    spark, kind = both.sparkSession, both.schema["u"].dataType
    sources = max(LEAST, min(SOURCES, SPACE // (4 * n) // 64 * 64)) if wide else SOURCES
    parts = min(ceil(n / sources), 4 * spark.sparkContext.defaultParallelism)
    chunks = ceil(n / 16_384)
    packed = both.groupBy(F.pmod(F.hash("u"), F.lit(chunks)).alias("c")).agg(F.collect_list(F.struct("u", "v")).alias("e")).select(F.col("e.u").alias("us"), F.col("e.v").alias("vs"))
    whole = packed.withColumn("edges", F.lit(both.count()))
    dealt = spark.range(0, parts, 1, parts).join(F.broadcast(whole))
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                one = {name: batch.column(k)[row] for k, name in enumerate(batch.schema.names)}
                part, edges = one["id"].as_py(), one["edges"].as_py()
                held.setdefault(part, []).append((one["us"].values.to_numpy(), one["vs"].values.to_numpy()))
                if sum(len(u) for u, _ in held[part]) < edges:
                    continue
                graph = _Graph(*map(np.concatenate, zip(*held.pop(part), strict=True)))
                for begin in range(part * sources, len(graph.nodes), parts * sources):
                    for columns in each(graph, begin, min(begin + sources, len(graph.nodes))):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return dealt.mapInArrow(run, schema.replace("NODE", kind.simpleString()))


def _is_small(both: DataFrame) -> int:
    """How many nodes a small graph has; 0 for others."""
    if both.schema["u"].dataType.simpleString() not in _WHOLE:
        return 0
    edges, nodes = both.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
    return nodes if edges <= SMALL else 0


def hop_distances(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(source, node, hops) for all nodes that are connected, each with itself at 0.

    A breadth-first search from all nodes at once. A graph of up to SMALL edges is broadcast, and tasks search from some hundred
    sources at a time, a bit each; of a larger one, or with nodes that are no whole numbers, a ring at a time is joined with the
    edges. The rows are the square of a component's size. Edges with a null end and loops are ignored; repeated and reversed
    edges count once.
    """
    both = _both_ways(edges, src, dst)
    n = _is_small(both)
    return _searched(both, n, _distances, "source NODE, node NODE, hops int", True) if n else _rings(both)


def hop_sums(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, hops): the sum of a node's distances to all that it is connected with, as :func:`hop_distances` has them; of a
    small graph no distance leaves a task."""
    both = _both_ways(edges, src, dst)
    n = _is_small(both)
    return _searched(both, n, _sums, "node NODE, hops bigint", False) if n else _rings(both).groupBy(F.col("source").alias("node")).agg(F.sum("hops").alias("hops"))
