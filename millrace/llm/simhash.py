"""SimHash near-duplicates, found by a vantage-point tree over Hamming distance.

1. Every text gets a 64-bit SimHash of its word shingles (one scan, no shuffle of texts).
2. Distinct fingerprints only go on; copies collapse in a partial aggregation.
3. A shallow vantage-point tree with four rings a node is built on the driver from a bounded, hash-ordered sample of
   fingerprints. It only says where to cut: every fingerprint is homed in exactly one leaf (shard) and is also sent to
   each later leaf that its ball of the link radius reaches, by the triangle inequality.
4. A shard holds its own fingerprints, streams the visiting ones past them, prunes by a deeper tree of the same kind
   and folds pairs into a forest at once, so a dense group never yields its pairs.
5. The forests' edges are joined to components by the distributed algorithm of ``operators.graph``.

The pairs that count are exactly those at the radius or closer; nothing is approximate after the fingerprints.

The pipeline's stage (:func:`one_of_each`) asks for a similarity of texts, not of fingerprints: it verifies on the texts what
trees over several SimHashes link, and completes what lies beyond their radius, see there.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.text import give_back, map_texts, shingle_pieces, small_batches
from millrace.operators.graph import connected_components
from millrace.plans.materialize import materialize, release

WIDTH, RADIUS, SEED = 3, 3, 42
#: Fingerprints that a shard is planned for, shards of a signature at least, and twice as many as at most (2 * 10**9 distinct
#: fingerprints; beyond that shards grow, and nothing is lost); sampled fingerprints a shard, and in all, about (32 MB).
SHARD, LEAST, SHARDS, SAMPLE, SAMPLED = 65_536, 16, 1 << 16, 64, 1 << 22
#: Fingerprints in a node of a shard's own tree that are compared one by one, and pairs that are compared at a time.
FLAT, BLOCK = 96, 1 << 20
#: The pipeline's stage: words of a shingle, the Jaccard similarity that links (a fraction), bands, minimum hashes a band.
STAGE_WIDTH, TOP, BOTTOM, BANDS, ROWS = 5, 4, 5, 20, 5
#: Its SimHashes, their radius, and fingerprints of a signature and size that a shard is planned for.
SIGNATURES, STAGE_RADIUS, STAGE_SHARD = 8, 5, SHARD
#: Logarithm of the widest ratio of sizes that can link, and a little more; size classes at most.
_CLASS, _CLASSES = math.log(1.01 * BOTTOM / TOP), 128
SIMILARITY = TOP / BOTTOM
#: Sets of a band that are paired by a join at most; sets, and hashes in them, of a block of a larger band; columns at a time.
FEW, MANY, WEIGHT, COLUMNS = 16, 512, 1 << 21, 8_192

_MIX = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def _add_bits(ones: np.ndarray, h: np.ndarray) -> None:
    """Count the bits of hashes for each signature: the first takes them as they are, each further one a fixed mix."""
    for at in range(0, len(h), BLOCK >> 4):
        part = h[at : at + (BLOCK >> 4)]
        for k in range(len(ones)):
            ones[k] += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            part = (part ^ (part >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
            part ^= part >> np.uint64(29)


def _majority(ones: np.ndarray, n: int) -> np.ndarray:
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view(np.uint64)[:, 0] if n else np.zeros(len(ones), np.uint64)


def simhashes(text: bytes | None, width: int = WIDTH, signatures: int = 1) -> np.ndarray:
    """64-bit SimHashes of the text's word shingles, A-Z lower-cased: a bit is 1 if set in over half of the shingles'
    hashes. The first signature takes XXH64 (seed 42), each further one a fixed mix of that. A null text and one without
    words give 0. Memory is bounded by a piece of the text."""
    ones, n = np.zeros((signatures, 64), np.int64), 0
    digest = xxhash.xxh64_intdigest
    for shingles in shingle_pieces((text or b"").lower(), width):
        h = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(shingles))
        _add_bits(ones, h)
        n += len(h)
    return _majority(ones, n)


def simhash(text: bytes | None, width: int = WIDTH) -> int:
    """The first signature as an integer."""
    return int(simhashes(text, width)[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = WIDTH, signatures: int = 1, name: str = "fps") -> DataFrame:
    """``docs`` without the text column, with the signatures as array<long> in column ``name``, in place of one of that name."""

    def make(texts):
        flat = np.concatenate([simhashes(t.as_py(), width, signatures) for t in texts]).view(np.int64)
        return [pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, signatures, dtype=np.int32)), pa.array(flat))]

    return map_texts(docs, text, make, {name: "array<long>"}, drop=(text,), binary=True)


def _distances(x: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(x ^ point).astype(np.int16)


def _rings(sample: np.ndarray, tries: int = 4) -> tuple[np.uint64, np.ndarray] | None:
    """A vantage point of the sample with the widest spread of distances, and the outer radii of its inner rings."""
    best = None
    for point in sample[np.linspace(0, len(sample) - 1, min(tries, len(sample))).astype(int)]:
        d = _distances(sample, point)
        if best is None or d.std() > best[0]:
            best = (d.std(), point, d)
    cuts = np.unique(np.quantile(best[2], (0.25, 0.5, 0.75), method="lower")).astype(np.int16)
    cuts = cuts[cuts < best[2].max()]
    return (best[1], cuts) if len(cuts) else None


def build_tree(sample: np.ndarray, leaves: int) -> list:
    """A tree of nested lists [point, radii, children] whose leaves are numbers from 0; about ``leaves`` of them."""
    cap, counter = max(4, len(sample) // max(1, leaves)), [0]

    def node(part: np.ndarray):
        split = _rings(part) if len(part) > cap else None
        if split is None:
            counter[0] += 1
            return counter[0] - 1
        side = np.searchsorted(split[1], _distances(part, split[0]))
        return [split[0], split[1], [node(part[side == k]) for k in range(len(split[1]) + 1)]]

    return node(sample) if len(sample) else 0


def _reach(d: np.ndarray, cuts: np.ndarray, k: int, radius: int) -> np.ndarray:
    """Which of the distances have a ball that meets ring k: (cuts[k - 1], cuts[k]]."""
    inner = d + radius > cuts[k - 1] if k else True
    return (d - radius <= cuts[k] if k < len(cuts) else True) & inner


def route(tree, x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, leaf, home): the home leaf of each fingerprint, and the leaves after it that its ball reaches."""
    found = []

    def go(node, idx, home):
        if isinstance(node, int):
            found.append((idx, np.full(len(idx), node), home))
            return
        d = _distances(x[idx], node[0])
        ring = np.searchsorted(node[1], d)
        for k, child in enumerate(node[2]):
            hit = _reach(d, node[1], k, radius)
            if hit.any():
                go(child, idx[hit], (home & (ring == k))[hit])

    go(tree, np.arange(len(x)), np.ones(len(x), bool))
    idx, leaf, home = (np.concatenate(c) for c in zip(*found, strict=True))
    own = np.zeros(len(x), np.int64)
    own[idx[home]] = leaf[home]
    keep = home | (leaf > own[idx])
    return idx[keep], leaf[keep], home[keep]


def close_pairs(points: np.ndarray, queries: np.ndarray, radius: int):
    """Index arrays (query, point) of all pairs within the radius, in blocks; rings that a ball cannot reach are pruned."""

    def flat(qi, pi):
        step = max(1, BLOCK // max(1, len(pi)))
        for at in range(0, len(qi), step):
            q = qi[at : at + step]
            a, b = np.nonzero(np.bitwise_count(queries[q][:, None] ^ points[pi][None, :]) <= radius)
            if len(a):
                yield q[a], pi[b]

    def go(qi, pi):
        split = _rings(points[pi], 2) if len(pi) > FLAT and len(qi) else None
        if split is None:
            yield from flat(qi, pi)
            return
        dp, dq = _distances(points[pi], split[0]), _distances(queries[qi], split[0])
        ring = np.searchsorted(split[1], dp)
        for k in range(len(split[1]) + 1):
            yield from go(qi[_reach(dq, split[1], k, radius)], pi[ring == k])

    yield from go(np.arange(len(queries)), np.arange(len(points)))


class Forest:
    """Labels under union; blocks of pairs are folded in without a loop over pairs."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            la, lb = self.label[a], self.label[b]
            open_ = la != lb
            if not open_.any():
                return
            a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
            low = np.minimum(la, lb)
            np.minimum.at(self.label, la, low)
            np.minimum.at(self.label, lb, low)
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


def _shard_edges(radius: int):
    """Of rows (leaf, visitor, fp), sorted so that a leaf's own fingerprints come before its visitors, the edges of a
    forest that spans the links within the leaf and those between its own fingerprints and visitors."""

    def run(batches):
        leaf, own, points, root = None, [], None, None

        def edges(src, dst):
            number = pa.array(np.full(len(src), leaf // SHARDS, np.int32))
            return pa.RecordBatch.from_arrays([number, pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], names=["j", "src", "dst"])

        def settle():
            nonlocal points, root
            points = np.concatenate(own)
            forest = Forest(len(points))
            for a, b in close_pairs(points, points, radius):
                forest.add(a, b)
            root = forest.label
            off = np.flatnonzero(root != np.arange(len(points)))
            return edges(points[off], points[root[off]])

        for b in batches:
            leaves, visitor = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            fps = b.column(2).to_numpy().view(np.uint64)
            bounds = np.flatnonzero(np.r_[True, (leaves[1:] != leaves[:-1]) | (visitor[1:] != visitor[:-1])])
            for s, e in zip(bounds, [*bounds[1:], len(fps)], strict=True):
                if leaves[s] != leaf:
                    if leaf is not None and points is None and own:
                        yield settle()
                    leaf, own, points = leaves[s], [], None
                if not visitor[s]:
                    own.append(fps[s:e])
                    continue
                if not own:
                    continue
                if points is None:
                    yield settle()
                visitors = fps[s:e]
                for q, p in close_pairs(points, visitors, radius):
                    pair = np.unique(np.stack([q, root[p]]), axis=1)
                    yield edges(visitors[pair[0]], points[pair[1]])
        if leaf is not None and points is None and own:
            yield settle()
        give_back()

    return run


def links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD, least: int = LEAST) -> DataFrame:
    """Edges (j, src, dst) that join distinct fingerprints of each signature j into the same groups as all pairs of that
    signature within the radius do; shards are planned for ``shard`` fingerprints, and ``least`` at least. ``fps`` (j, fp) should be a written table: it is counted, sampled and read again."""
    spark = fps.sparkSession
    counts = {r["j"]: r["count"] for r in fps.groupBy("j").count().collect()}
    leaves = {j: max(least, min(SHARDS // 2, -(-n // shard))) for j, n in counts.items()}
    most = min(SAMPLED, SAMPLE * sum(leaves.values()))
    small_batches(spark)
    # rows below a bound of their hash: about as many as asked for, without a sort and whatever the number of tasks
    share = most / max(1, sum(counts.values()))
    bound = min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))
    some = fps.select("j", "fp").where(F.xxhash64("j", "fp") <= bound).toArrow()
    number, points = some.column("j").to_numpy(), some.column("fp").to_numpy().view(np.uint64)
    order = np.lexsort((points, number))
    number, points = number[order], points[order]
    trees = spark.sparkContext.broadcast({j: build_tree(points[number == j], leaves[j]) for j in counts})

    def deal(batches):
        for b in batches:
            number, x = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            for j in np.unique(number):
                own = x[number == j]
                idx, leaf, home = route(trees.value[j], own, radius)
                yield pa.RecordBatch.from_arrays([pa.array(int(j) * SHARDS + leaf.astype(np.int64)), pa.array(~home), pa.array(own[idx].view(np.int64))], names=["leaf", "visitor", "fp"])

    dealt = fps.select("j", "fp").mapInArrow(deal, "leaf long, visitor boolean, fp long")
    shards = dealt.repartition("leaf").sortWithinPartitions("leaf", "visitor")
    return shards.mapInArrow(_shard_edges(radius), "j int, src long, dst long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """(key, fp, component): each row's fingerprint and the smallest key of its group, itself included.

    Null texts and texts without words have fingerprint 0 and are linked like any other. Null keys are never the
    smallest of a group that has another key. Repeated rows give repeated results; an empty table gives none. Other
    columns of ``docs`` are not read.
    """
    rows = fingerprints(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), "t", width)
    rows = materialize(rows.select("k", F.col("fps")[0].alias("fp")), "fingerprints")
    least = materialize(rows.groupBy("fp").agg(F.min("k").alias("low")), "distinct-fingerprints")
    groups = connected_components(links(least.select(F.lit(0).alias("j"), "fp"), radius)).withColumnRenamed("node", "fp")
    placed = least.join(groups, "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    roots = placed.groupBy("root").agg(F.min("low").alias("component"))
    named = placed.join(roots, "root").select("fp", "component")
    return rows.join(named, "fp").select(F.col("k").alias(key), "fp", "component")


def shingle_hashes(text: bytes | None, width: int = STAGE_WIDTH) -> np.ndarray:
    """The sorted distinct XXH64 hashes (seed 42) of the text's word shingles, A-Z lower-cased; of no words, none."""
    digest = xxhash.xxh64_intdigest
    parts = [np.unique(np.fromiter((digest(s, SEED) for s in x), np.uint64, len(x))) for x in shingle_pieces((text or b"").lower(), width)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def set_simhashes(hashes: np.ndarray, signatures: int = SIGNATURES) -> np.ndarray:
    """The SimHashes of a set of shingle hashes."""
    ones = np.zeros((signatures, 64), np.int64)
    _add_bits(ones, hashes)
    return _majority(ones, len(hashes))


def tree_pairs(sets: DataFrame, radius: int = STAGE_RADIUS) -> DataFrame:
    """Pairs (src, dst), src > dst, of the ids of ``sets`` (id, n, fps) that span what vantage-point trees link: a tree for
    each signature and size. A set lies in two neighbouring classes of sizes, so sets that can be similar share one."""
    size = F.least(F.floor(F.log(F.greatest("n", F.lit(1))) / _CLASS), F.lit(_CLASSES - 2)).cast("int")
    at = sets.select("id", size.alias("size"), F.posexplode("fps").alias("s", "fp"))
    at = at.select("id", "fp", F.explode(F.array(*(F.col("s") * _CLASSES + F.col("size") + k for k in (0, 1)))).alias("j"))
    own = materialize(at.groupBy("j", "fp").agg(F.min("id").alias("low"), F.max("id").alias("high")), "set-fingerprints")
    same = at.join(own.where("low < high").select("j", "fp", "low"), ["j", "fp"]).select("id", "low")
    a, b = (own.select("j", F.col("fp").alias(c), F.col("low").alias(name)) for c, name in (("src", "id"), ("dst", "low")))
    found = links(own.select("j", "fp"), radius, STAGE_SHARD, 1).join(a, ["j", "src"]).join(b, ["j", "dst"]).select("id", "low")
    found = found.unionByName(same).where("id != low").select(F.greatest("id", "low").alias("src"), F.least("id", "low").alias("dst"))
    out = materialize(found.distinct(), "tree-pairs")
    release(own)
    return out


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A 64-bit key for each of BANDS bands of ROWS minimum hashes; two sets of Jaccard similarity s agree on a band with
    probability s ** ROWS."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), BLOCK >> 7):
        x = hashes[None, at : at + (BLOCK >> 7)] * _FACTORS[:, None]
        x ^= x >> np.uint64(32)
        x *= _MIX
        low = np.minimum(low, x.min(1))
    out = np.arange(BANDS, dtype=np.uint64)
    for x in low.reshape(BANDS, ROWS).T:
        out = (out ^ x) * _MIX
        out ^= out >> np.uint64(29)
    return out


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """Of ``docs`` (k, node, t): k, node, the 64-bit digest ``id`` of the set of shingles, its size n, its SimHashes ``fps``
    and its band keys."""

    def make(texts):
        sets = [shingle_hashes(t.as_py(), width) for t in texts]
        ids = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        lists = []
        for each, of in ((SIGNATURES, set_simhashes), (BANDS, band_keys)):
            flat, ends = np.concatenate([of(s) for s in sets]).view(np.int64), np.arange(0, each * len(sets) + 1, each, dtype=np.int32)
            lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
        return [pa.array(ids), pa.array([len(s) for s in sets], pa.int64()), *lists]

    return map_texts(docs.select("k", "node", "t"), "t", make, {"id": "long", "n": "long", "fps": "array<long>", "bands": "array<long>"}, drop=("t",), binary=True)


def _hashed(texts: DataFrame, width: int) -> DataFrame:
    """(id, hashes) of ``texts`` (id, t)."""

    def run(batches):
        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                # a row a batch: the sets of a batch of long texts are not held together
                h = shingle_hashes(t.as_py(), width).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(h)], pa.int32()), pa.array(h))], names=["id", "hashes"])

    small_batches(texts.sparkSession)
    return texts.select("id", F.col("t").cast("binary").alias("t")).mapInArrow(run, "id long, hashes array<long>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (src, dst) with whether the Jaccard similarity of their sets is SIMILARITY or more, as ``ok``."""
    a, b = (sets.select(F.col("id").alias(c), F.col("hashes").alias(h)) for c, h in (("src", "a"), ("dst", "b")))
    both = F.size(F.array_intersect("a", "b"))
    # TOP / BOTTOM is the similarity: no rounding
    enough = (TOP + BOTTOM) * both >= TOP * (F.size("a") + F.size("b"))
    return pairs.join(a, "src").join(b, "dst").select("src", "dst", enough.alias("ok"))


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two of the sets have in common."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = count[column] > 1
    _, column = np.unique(column[keep], return_inverse=True)
    owner, out = owner[keep], np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        own = (column >= at) & (column < at + COLUMNS)
        x = np.zeros((len(sets), COLUMNS), np.float32)
        x[owner[own], column[own] - at] = 1
        out += x @ x.T
    return out


def _linked(table: pa.Table) -> pa.Table:
    """Edges of a forest that spans the similar pairs of the sets in two blocks of a band (one, where i is j)."""
    ids, labels, block, i, j = (table.column(c).to_numpy() for c in ("id", "label", "block", "i", "j"))
    sets = [np.asarray(h.values) for h in table.column("hashes")]
    n = np.array([len(x) for x in sets])
    # TOP / BOTTOM is the similarity: no rounding; pairs of one label are joined already
    ok = (TOP + BOTTOM) * shared(sets) >= TOP * (n[:, None] + n[None, :])
    ok &= labels[:, None] != labels[None, :]
    if i[0] != j[0]:
        ok &= block[:, None] != block[None, :]
    forest = Forest(len(ids))
    names = np.unique(labels, return_inverse=True)[1]
    first = np.full(names.max() + 1, len(ids))
    np.minimum.at(first, names, np.arange(len(ids)))
    forest.label = first[names]
    before = forest.label.copy()
    a, b = np.nonzero(np.triu(ok))
    forest.add(before[a], before[b])
    moved = np.flatnonzero((forest.label[before] != before) & (before == np.arange(len(ids))))
    return pa.table({"src": ids[moved], "dst": ids[forest.label[moved]]})


def similar(rows: DataFrame, texts, width: int = STAGE_WIDTH) -> DataFrame:
    """(node, component) of the sets of ``rows`` (id, n, fps, bands) that are linked by pairs which the trees find or which
    share a band, and have a Jaccard similarity of SIMILARITY or more. ``texts`` gives (id, t) for a table of ids.

    What the trees link is verified first. For pairs beyond their radius every set is compared with the least of each of
    its bands, so a dense group does not yield its pairs. Sets of a band that this leaves in different groups are then all compared with each other, so no link is lost by the order: those
    of a small band by a join, those of a larger one inside tasks, block by block, which return no pairs but edges that join
    groups.
    """
    one = materialize(rows.select("id", "n", "fps", "bands").dropDuplicates(["id"]), "distinct-sets")
    near = tree_pairs(one)
    at = one.select("id", "n", F.explode("bands").alias("band"))
    crowd = at.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("id", "n")).alias("rep")).where("m > 1").select("band", "rep")
    at = materialize(at.join(crowd, "band"), "bands")
    fit = lambda a, b: (BOTTOM * a >= TOP * b) & (BOTTOM * b >= TOP * a)
    stars = at.where((F.col("id") != F.col("rep.id")) & fit(F.col("n"), F.col("rep.n")))
    stars = stars.select(F.col("id").alias("src"), F.col("rep.id").alias("dst")).distinct()
    stars = materialize(stars.join(near, ["src", "dst"], "left_anti"), "stars")
    ids = at.select("id").unionByName(near.select(F.explode(F.array("src", "dst")).alias("id"))).distinct()
    sets = materialize(_hashed(texts(ids), width).dropDuplicates(["id"]), "sets")
    first = materialize(_verified(near.unionByName(stars), sets), "verified")
    linked = first.where("ok").select("src", "dst")
    groups = materialize(connected_components(linked), "groups")
    named = at.join(groups.withColumnRenamed("node", "id"), "id", "left").select("band", "id", "n", F.coalesce("component", "id").alias("label"))
    named = materialize(named, "labels")
    mixed = named.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("weight")).where("x < y")
    blocks = F.greatest(F.ceil(F.col("m") / MANY), F.ceil(F.col("weight") / WEIGHT)).cast("int")
    some = materialize(named.join(mixed.select("band", "m", blocks.alias("blocks")), "band"), "mixed-bands")
    a, b = (some.where(F.col("m") <= FEW).select("band", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "label"))) for s in "ab")
    cross = a.join(b, "band").where((F.col("id_a") > F.col("id_b")) & (F.col("label_a") != F.col("label_b")) & fit(F.col("n_a"), F.col("n_b")))
    cross = cross.select(F.col("id_a").alias("src"), F.col("id_b").alias("dst")).distinct().join(first, ["src", "dst"], "left_anti")
    few = _verified(cross, sets).where("ok").select("src", "dst")
    large = some.where(F.col("m") > FEW).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks").cast("bigint")).cast("int"))
    dealt = large.select("band", "id", "label", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    dealt = dealt.select("band", "id", "label", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j")).join(sets, "id")
    many = dealt.groupBy("band", "i", "j").applyInArrow(_linked, "src long, dst long")
    more = materialize(few.unionByName(many), "cross-links")
    release(one, near, at, stars, sets, named, some)
    if not more.limit(1).count():
        return groups
    out = materialize(connected_components(linked.unionByName(more)), "groups")
    release(first, groups, more)
    return out


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = STAGE_WIDTH) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that with the smallest key (null keys last), then the
    smallest text digest.

    Texts are linked if the sets of their word shingles have a Jaccard similarity of SIMILARITY or more, compared exactly
    on 64-bit hashes. Candidates are what vantage-point trees over SIGNATURES SimHashes link at STAGE_RADIUS bits. A SimHash
    of 64 bits is some 10 bits off at the similarity itself, where no tree prunes, so the rest of the candidates come from
    bands of minimum hashes: a pair at the similarity is one with probability 1 - (1 - SIMILARITY ** ROWS) **
    BANDS = 0.9996, and the more similar the surer. Null and empty texts are one group. Of rows with equal key and text
    the one with the least other columns stays (columns of a type without an order, maps, are not taken).
    """
    digest = F.unhex(F.md5(F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))))
    own = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), digest.alias("node"))
    rows = materialize(_sets(own, width), "signatures")

    def texts(ids: DataFrame) -> DataFrame:
        one = rows.join(ids, "id", "left_semi").groupBy("id").agg(F.min(F.struct(F.col("k").isNull().alias("none"), "k", "node")).alias("one"))
        one = one.select("id", F.col("one.k").alias("lk"), F.col("one.node").alias("lnode"))
        return own.join(one, F.col("k").eqNullSafe(F.col("lk")) & (F.col("node") == F.col("lnode"))).select("id", "t")

    groups = similar(rows, texts, width).withColumnRenamed("node", "id")
    # rows of one set of shingles, or of sets of one group, are candidates for the same place
    placed = rows.select("k", "node", "id").join(groups, "id", "left").select("k", "node", F.coalesce("component", "id").alias("root"))
    rank = F.struct(F.col("k").isNull().alias("none"), F.col("k"), F.col("node"))
    best = placed.groupBy("root").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1").select("root", "best")
    losers = placed.join(best, "root").where(~(F.col("best.k").eqNullSafe(F.col("k")) & (F.col("best.node") == F.col("node"))))
    losers = losers.select(F.col("k").alias("lk"), F.col("node").alias("lnode")).distinct()
    full = docs.select(F.struct("*").alias("row"), F.col(key).alias("k"), digest.alias("node"))
    kept = full.join(losers, F.col("k").eqNullSafe(F.col("lk")) & (F.col("node") == F.col("lnode")), "left_anti")
    if rows.groupBy("k", "node").count().where("count > 1").limit(1).count():
        kept = kept.groupBy("k", "node").agg(F.min("row").alias("row"))
    return kept.select("row.*")
