"""Benchmark decontamination: which documents hold a benchmark item, by size-partitioned MinHash containment search.

Both sides are sketched by one hash of word shingles, and items are partitioned by size: class c holds those of up to 2**c
shingles. An item of n shingles that is contained to the threshold t misses at most floor((1 - t) n) of them, so of its
shingles with the least hashes (bottom-k MinHash) one more than that are its sketch: at least one of them is in the document. The largest hash of
a class's sketches is the class's bound. A document's sketch for a class is its shingles with hashes up to that bound; a
document that is too small for the class's least item has none. The search therefore loses no item, and what meets is
only what both sides keep. Hits are verified by the exact share of the item's shingles that are in the document.

Where the items fit in one block of bounded size their index is broadcast: one scan of the documents, and no text is
shuffled. Beyond that the sketches of both sides are joined on the hash, and candidates are verified by a join of their
shingles' digests: one scan of the documents again, however large the benchmark.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from millrace.llm.text import map_texts, shingle_pieces
from millrace.plans.materialize import materialize

WIDTH, THRESHOLD, SEED = 5, 0.8, 42
#: Bytes of item texts that are broadcast as an index; a larger benchmark is joined.
BLOCK_BYTES = 32 << 20


def shingles(text: bytes | None, width: int = WIDTH) -> set[bytes]:
    """Distinct word shingles of the text, A-Z lower-cased; of a text of fewer words, all its words; of none, none."""
    return set(chain.from_iterable(shingle_pieces((text or b"").lower(), width)))


def size_class(n: int) -> int:
    return (n - 1).bit_length()


def sketch_size(n: int, threshold: float = THRESHOLD) -> int:
    """Shingles in the sketch of an item of ``n``: one more than it may miss."""
    return int((1 - threshold) * n + 1e-9) + 1


def _hash(shingle: bytes) -> int:
    return xxhash.xxh64_intdigest(shingle, SEED)


class Partition:
    """The sketches of one size class: sorted hashes, the items that hold each, the bound and the least size."""

    def __init__(self):
        self.held: dict[int, list[int]] = {}
        self.least = 0

    def add(self, item: int, n: int, sketch: list[int]) -> None:
        self.least = min(n, self.least or n)
        for h in sketch:
            self.held.setdefault(h, []).append(item)

    def close(self) -> None:
        self.hashes = np.array(sorted(self.held), np.uint64)
        self.items = [self.held[int(h)] for h in self.hashes]
        self.bound = self.hashes[-1]
        self.held = {}


class Index:
    """Items in partitions by size class."""

    def __init__(self, items: list[tuple], width: int = WIDTH, threshold: float = THRESHOLD):
        self.width, self.threshold = width, threshold
        self.names, self.sets = [], []
        self.partitions: dict[int, Partition] = {}
        for name, text in items:
            s = shingles(text, width)
            if s:
                self.partitions.setdefault(size_class(len(s)), Partition()).add(len(self.sets), len(s), sorted(map(_hash, s))[: sketch_size(len(s), threshold)])
                self.names.append(name)
                self.sets.append(s)
        for p in self.partitions.values():
            p.close()

    def search(self, text: bytes | None) -> list[tuple]:
        """(item, its shingles, those in the text) for each item that the text contains to the threshold."""
        if not self.partitions:
            return []
        low, hit, n = (text or b"").lower(), set(), 0
        bound = max(p.bound for p in self.partitions.values())
        for part in shingle_pieces(low, self.width):
            n += len(part)
            h = np.fromiter(map(_hash, part), np.uint64, len(part))
            sketch = np.unique(h[h <= bound])
            for p in self.partitions.values():
                own = sketch[: np.searchsorted(sketch, p.bound, "right")]
                at = np.searchsorted(p.hashes, own)
                for i in at[p.hashes[at] == own]:
                    hit.update(p.items[i])
        hit = [k for k in hit if n >= self.threshold * len(self.sets[k])]
        if not hit:
            return []
        want = set().union(*(self.sets[k] for k in hit))
        have = {s for part in shingle_pieces(low, self.width) for s in part if s in want}
        out = [(self.names[k], len(self.sets[k]), len(self.sets[k] & have)) for k in hit]
        return sorted((x for x in out if x[2] >= self.threshold * x[1] - 1e-9), key=lambda x: (x[0] is None, x[0]))


def _digest(shingle: bytes) -> bytes:
    return hashlib.md5(shingle, usedforsecurity=False).digest()


def _lists(values: list[list], kind: pa.DataType) -> pa.Array:
    return pa.array(values, pa.list_(kind))


def _raw(text: str) -> Column:
    return F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))


def _node(text: str) -> Column:
    return F.unhex(F.md5(_raw(text)))


def _of_text(df: DataFrame, text: str) -> DataFrame:
    """(node, t): texts of a table with their digests."""
    return df.select(_node(text).alias("node"), _raw(text).alias("t"))


def _joined(docs: DataFrame, benchmark: DataFrame, text: str, item_text: str, width: int, threshold: float) -> DataFrame:
    """(d, i, n_shingles, n_found) by digests of texts, for a benchmark of any size."""

    def item(texts):
        sets = [shingles(t.as_py(), width) for t in texts]
        sketches = [np.array(sorted(map(_hash, s))[: sketch_size(len(s), threshold)], np.uint64).view(np.int64) if s else [] for s in sets]
        return [pa.array([size_class(len(s)) for s in sets], pa.int32()), pa.array([len(s) for s in sets], pa.int64()), _lists(sketches, pa.int64()), _lists([sorted(map(_digest, s)) for s in sets], pa.binary())]

    items = map_texts(_of_text(benchmark, item_text).dropDuplicates(["node"]), "t", item, {"class": "int", "n_shingles": "long", "sketch": "array<long>", "parts": "array<binary>"}, drop=("t",), binary=True)
    items = materialize(items.where("n_shingles > 0"), "items")
    sketched = items.select(F.col("node").alias("i"), "class", "n_shingles", F.explode("sketch").alias("h"))
    # unsigned order: the sign bit turned
    bounds = sketched.groupBy("class").agg(F.max(F.col("h").bitwiseXOR(F.lit(-(1 << 63)))).alias("b"), F.min("n_shingles").alias("least"))
    by_class = [((r["b"] ^ -(1 << 63)) & (1 << 64) - 1, r["least"]) for r in bounds.collect()]  # a row a class: 64 at most

    def doc(texts):
        out = []
        for t in texts:
            low, n, kept = t.as_py().lower(), 0, [np.empty(0, np.uint64)]
            top = np.uint64(max((b for b, _ in by_class), default=0))
            for part in shingle_pieces(low, width):
                n += len(part)
                h = np.fromiter(map(_hash, part), np.uint64, len(part))
                kept.append(np.unique(h[h <= top]))
            own = max((b for b, least in by_class if n >= threshold * least), default=-1)
            kept = np.unique(np.concatenate(kept))
            out.append(kept[: np.searchsorted(kept, np.uint64(own), "right")].view(np.int64) if own >= 0 else [])
        return [_lists(out, pa.int64())]

    def parts(texts):
        return [_lists([sorted(map(_digest, shingles(t.as_py(), width))) for t in texts], pa.binary())]

    texts = _of_text(docs, text)
    held = map_texts(texts, "t", doc, {"sketch": "array<long>"}, drop=("t",), binary=True).select(F.col("node").alias("d"), F.explode("sketch").alias("h")).distinct()
    found = materialize(held.join(sketched.select("h", "i"), "h").select("d", "i").distinct(), "candidates")
    some = texts.join(found.select(F.col("d").alias("node")).distinct(), "node", "left_semi").dropDuplicates(["node"])
    theirs = map_texts(some, "t", parts, {"parts": "array<binary>"}, drop=("t",), binary=True).select(F.col("node").alias("d"), F.explode("parts").alias("p"))
    wanted = found.join(items.select(F.col("node").alias("i"), "n_shingles", "parts"), "i").select("d", "i", "n_shingles", F.explode("parts").alias("p"))
    counted = wanted.join(theirs, ["d", "p"]).groupBy("d", "i", "n_shingles").agg(F.count(F.lit(1)).alias("n_found"))
    return materialize(counted.where(F.col("n_found") >= threshold * F.col("n_shingles") - 1e-9), "contained")


def _items(benchmark: DataFrame, item_key: str, item_text: str) -> list[tuple] | None:
    """The items on the driver if their texts have at most BLOCK_BYTES, else None."""
    some = benchmark.select(F.col(item_key).alias("k"), F.col(item_text).cast("binary").alias("t"))
    row = some.agg(F.sum(F.coalesce(F.octet_length("t"), F.lit(0)) + 64).alias("b")).first()
    return None if (row["b"] or 0) > BLOCK_BYTES else [(r["k"], bytes(r["t"] or b"")) for r in some.collect()]


def contained_items(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """(key, item key, n_shingles, n_found, containment) for each document and item that it contains to the threshold.

    Null and empty texts contain nothing and are contained nowhere; an item of fewer words than a shingle is found in
    documents of just these words. Repeated documents and items give repeated rows; without documents or items there
    is none. Other columns are not read.
    """
    name = item_key if item_key != key else f"item_{item_key}"
    narrow = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    items = _items(benchmark, item_key, item_text)
    if items is None:
        found = _joined(docs, benchmark, text, item_text, width, threshold)
        keyed = benchmark.select(_node(item_text).alias("i"), F.col(item_key).alias("item"))
        mine = narrow.select("k", _node("t").alias("d"))
        out = mine.join(found, "d").join(keyed, "i").select("k", F.col("item").alias("i"), "n_shingles", "n_found")
    else:
        kind = benchmark.schema[item_key].dataType
        index = docs.sparkSession.sparkContext.broadcast(Index(items, width, threshold))
        arrow = pa.list_(pa.struct([("i", to_arrow_type(kind)), ("n_shingles", pa.int64()), ("n_found", pa.int64())]))

        def search(texts):
            return [pa.array([[dict(zip(("i", "n_shingles", "n_found"), x, strict=True)) for x in index.value.search(t.as_py())] for t in texts], arrow)]

        found = map_texts(narrow, "t", search, {"f": f"array<struct<i:{kind.simpleString()},n_shingles:bigint,n_found:bigint>>"}, drop=("t",), binary=True)
        out = found.select("k", F.explode("f").alias("f")).select("k", "f.*")
    return out.select(F.col("k").alias(key), F.col("i").alias(name), "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment"))


def without_contained(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that contain an item to the threshold; all columns stay as they are, whatever their
    names. Null and empty texts stay; repeated rows stay or go together; an empty table gives an empty one, and without
    items every row stays."""
    items = _items(benchmark, item_key, item_text)
    if items is None:
        found = _joined(docs, benchmark, text, item_text, width, threshold).select("d").distinct()
        names = [f"c{k}" for k in range(len(docs.columns))]
        return docs.toDF(*names).withColumn("d", _node(names[docs.columns.index(text)])).join(found, "d", "left_anti").drop("d").toDF(*docs.columns)
    index = docs.sparkSession.sparkContext.broadcast(Index(items, width, threshold))
    return map_texts(docs, text, lambda texts: pa.array([not index.value.search(t.as_py()) for t in texts], pa.bool_()), keep=True, binary=True)
