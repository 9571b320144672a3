"""Repeated byte strings, found with suffix arrays that are built by the difference-cover algorithm.

A window (a string of ``length`` bytes) is repeated if it starts at another place too, in the same text or in another.
Sorting every suffix of a corpus would move many times its size, so a lossless cut comes first:

1. Each window picks an anchor: the leftmost of its 64-byte grams with the least hash. Equal windows pick equal anchors,
   so a window whose anchor's hash occurs once is not repeated. One scan counts anchor hashes; those that occur twice
   or more go into a bitmap of bounded size (when it fills up, more rows pass it and the later steps drop them).
2. A second scan writes, for anchors in the bitmap, their place and their context: the bytes of all windows that picked
   them. Equal contexts are one from here on, with the number of places they stand for.
3. Contexts meet by anchor, so equal windows do, and their suffixes are sorted by the difference cover modulo 3: sampled
   triples are sorted and named, names recurse until they span a window, the remaining suffixes are merged in, and
   adjacent suffixes are compared over a window. A window is repeated if a neighbour has it too, or if its context stands
   for several places. Anchors are dealt to buckets by hash, each sorted in one task's arrays; the contexts of anchors
   that have too many for a bucket are sorted together as distributed tables (``suffixsort``).
4. The repeated windows go back to their texts as byte spans.

Texts cross the network only where they hold a repeated anchor; hot passages collapse in partial aggregations.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.suffixsort import repeated_prefixes, suffix_ranks
from millrace.llm.text import give_back, small_batches
from millrace.plans.materialize import drop_path, materialize, release

LENGTH, GRAM = 200, 64
#: Texts that go into a batch of contexts; window starts that are scanned at a time; bits of the bitmap (a broadcast of an
#: eighth as many bytes, whatever the input); bytes planned for a bucket; contexts of one anchor that a bucket takes.
PART, STEP, BITS, BUCKET, CROWD = 512, 1 << 19, 1 << 27, 1 << 20, 4096

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(n, b, _U)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


class Anchors:
    """Finds the anchors of texts; holds tables of powers for the rolling hash of a gram."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram = length, min(gram, length)
        self.width = length - self.gram + 1
        self.up, self.down = _powers(STEP + length)

    def _hashes(self, t: np.ndarray) -> np.ndarray:
        total = np.zeros(len(t) + 1, _U)
        np.cumsum(t * self.up[: len(t)], out=total[1:])
        h = (total[self.gram :] - total[: -self.gram]) * self.down[: len(t) - self.gram + 1]
        h ^= h >> _U(32)
        h *= _U(0xD6E8FEB86659FD93)
        h ^= h >> _U(29)
        return h

    def find(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first, last) of each anchor of the bytes ``t``: its hash, and the first and last window that pick it.
        Every window of the text is in exactly one such range; long texts are scanned by steps."""
        found = [self._step(t[at : at + STEP + self.length - 1], at) for at in range(0, max(0, len(t) - self.length + 1), STEP)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, _U), *[np.empty(0, np.int64)] * 2)

    def _step(self, t: np.ndarray, at: int):
        h, w = self._hashes(t.astype(_U)), self.width
        n = len(h) - w + 1
        blocks = -(-len(h) // w)
        x = np.full(blocks * w, _U(0xFFFFFFFFFFFFFFFF))
        x[: len(h)] = h
        x = x.reshape(blocks, w)
        low = np.minimum(np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()[:n], np.minimum.accumulate(x, 1).ravel()[w - 1 : w - 1 + n])
        # A window's anchor is the first place at or after its start that holds its least hash. Runs of windows with one
        # least hash end where it changes; within a run, each place that holds the hash ends the windows that pick it.
        starts = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        ends = np.r_[starts[1:], n] - 1
        value = low[starts]
        run_of = np.repeat(np.arange(len(starts)), ends - starts + 1)
        inner = np.flatnonzero(h[:n] == low)
        inner = inner[inner < ends[run_of[inner]]]
        if len(inner):
            first = np.sort(np.r_[starts, inner + 1])
            value, ends = low[first], np.r_[first[1:], n] - 1
            starts = first
        return value, starts + at, ends + at


def suffix_order(s: np.ndarray, depth: int, span: int = 1) -> np.ndarray:
    """Suffixes of ``s`` (small integers of at least 1) in an order in which suffixes that agree on their first
    ``depth`` characters stand together; each item of ``s`` spans ``span`` characters. Difference cover modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    z = np.zeros(n + 3, np.int64)
    z[:n] = s
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    cover = np.concatenate([one, two])
    names, unique = _names(z[cover], z[cover + 1], z[cover + 2])
    if not unique and 3 * span < depth:
        order = suffix_order(names, depth, 3 * span)
        names = np.empty(len(cover), np.int64)
        names[order] = np.arange(1, len(cover) + 1)
    else:
        order = np.argsort(names, kind="stable")
    rank = np.zeros(n + 3, np.int64)
    rank[cover] = names
    cover = cover[order]
    cover = cover[cover < n]
    rest = np.arange(0, n, 3)
    width = _U(int(rank.max()) + 1)
    pair = z[rest].astype(_U) * width + rank[rest + 1].astype(_U)
    rest = rest[np.argsort(pair, kind="stable")]
    ones, twos = cover[cover % 3 == 1], cover[cover % 3 == 2]
    # Ranks stop at the depth, so keys may fall back among suffixes that agree on it; a running maximum keeps those together.
    behind = sum(np.searchsorted(*(np.maximum.accumulate(_key(z, rank, i, k)) for i in (part, rest))) for k, part in ((1, ones), (2, twos)))
    out = np.empty(n, np.int64)
    place = behind + np.arange(len(rest))
    free = np.ones(n, bool)
    free[place] = False
    out[place] = rest
    out[free] = cover
    return out


def _key(z: np.ndarray, rank: np.ndarray, i: np.ndarray, ahead: int) -> np.ndarray:
    """One number for (the first ``ahead`` items, the rank behind them) of suffixes i."""
    width = int(rank.max()) + 1
    items = int(z.max()) + 1
    key = z[i].astype(object) if items**ahead * width >= 1 << 64 else z[i].astype(_U)
    if ahead == 2:
        key = key * (items if key.dtype == object else _U(items)) + z[i + 1].astype(key.dtype)
    return key * (width if key.dtype == object else _U(width)) + rank[i + ahead].astype(key.dtype)


def _names(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, bool]:
    """Dense names from 1 of the triples, in their order, and whether all differ."""
    wide = int(max(a.max(), b.max(), c.max())) + 1
    if wide**3 < 1 << 64:
        key = (a.astype(_U) * _U(wide) + b.astype(_U)) * _U(wide) + c.astype(_U)
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.r_[True, k[1:] != k[:-1]]
    else:
        order = np.lexsort((c, b, a))
        new = np.r_[True, np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in (a, b, c)])]
    names = np.empty(len(a), np.int64)
    names[order] = np.cumsum(new)
    return names, bool(new.all())


def repeated_windows(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each text, which of its windows occur at another place of these texts too (a boolean for each start)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    at = np.r_[0, np.cumsum(sizes + 1)]
    joined = np.frombuffer(b"\0".join(texts) + b"\0" * (length + 9), np.uint8)
    s = joined[: at[-1]].astype(np.int64) + 2
    s[at[1:] - 1] = 1
    window = np.zeros(len(s) + 1, np.int32)
    counts = np.maximum(sizes - length + 1, 0)
    np.add.at(window, at[:-1], (counts > 0).astype(np.int32))
    np.add.at(window, at[:-1] + counts, -(counts > 0).astype(np.int32))
    window = np.cumsum(window)[:-1] > 0
    order = suffix_order(s, length)
    order = order[window[order]]
    a, b = order[:-1], order[1:]
    words = np.lib.stride_tricks.as_strided(joined.view(), (len(joined) - 7, 8), (1, 1))
    live = np.arange(len(a))
    for off in [*range(0, length - 7, 8), max(0, length - 8)]:
        if length < 8:
            break
        x = np.ascontiguousarray(words[a[live] + off]).view(_U).ravel() == np.ascontiguousarray(words[b[live] + off]).view(_U).ravel()
        live = live[x]
    for off in range(length if length < 8 else 0):
        live = live[joined[a[live] + off] == joined[b[live] + off]]
    hit = np.zeros(len(s), bool)
    hit[a[live]] = hit[b[live]] = True
    return [hit[i : i + c] for i, c in zip(at[:-1], counts, strict=True)]


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and last places of the runs of true flags."""
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return edge[::2], edge[1::2] - 1


def _bytes_of(column) -> list[np.ndarray]:
    return [np.frombuffer(t.as_py() or b"", np.uint8) for t in column]


def _count_anchors(length: int, gram: int):
    def run(batches):
        finder = Anchors(length, gram)
        for b in batches:
            hashes = [finder.find(t)[0] for t in _bytes_of(b.column(0))]
            h, n = np.unique(np.concatenate(hashes), return_counts=True) if hashes else (np.empty(0, _U), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])
        give_back()

    return run


_FOUND = ["kind", "rid", "h", "c1", "c2", "first", "windows", "context", "some", "row"]


def _write_contexts(length: int, gram: int, bitmap, text_at: int):
    """Of rows (a struct with the text at place ``text_at``): kind 0, the row with its number and whether its text holds
    an anchor in the bitmap; kind 1, for each such anchor its hash, the digest of its context, the first window and how
    many; kind 2, a context with its hash and digest, once a task unless it has met very many."""

    def run(batches):
        from pyspark import TaskContext

        finder, bits = Anchors(length, gram), np.frombuffer(bitmap.value, np.uint8)
        number, sent = TaskContext.get().partitionId() << 33, set()
        signed = lambda x: pa.array(np.array(x, _U).view(np.int64))
        for b in (b.slice(at, PART) for b in batches for at in range(0, b.num_rows, PART)):
            places, contexts = [[] for _ in range(6)], [[] for _ in range(4)]
            some = np.zeros(b.num_rows, bool)
            for k, t in enumerate(_bytes_of(b.column(0).field(text_at).cast(pa.binary()))):
                h, first, last = finder.find(t)
                slot = h & _U(BITS - 1)
                keep = np.flatnonzero(bits[slot >> _U(3)] >> (slot & _U(7)).astype(np.uint8) & 1)
                some[k] = len(keep) > 0
                raw = t.tobytes() if len(keep) else b""
                for i in keep:
                    s, e = int(first[i]), int(last[i])
                    context = raw[s : e + length]
                    digest = xxhash.xxh3_128_intdigest(context)
                    key = h[i], digest >> 64, digest & 0xFFFFFFFFFFFFFFFF
                    for column, value in zip(places, (number + k, *key, s, e - s + 1), strict=True):
                        column.append(value)
                    if digest not in sent:
                        for column, value in zip(contexts, (*key, context), strict=True):
                            column.append(value)
                        if len(sent) < 1 << 18:
                            sent.add(digest)
            n, m, kinds = len(places[0]), len(contexts[0]), dict(zip(_FOUND, [pa.int32(), *[pa.int64()] * 6, pa.binary(), pa.bool_(), b.column(0).type], strict=True))

            def batch(rows: int, kind: int, **given):
                columns = [given.get(c, pa.nulls(rows, t)) for c, t in kinds.items()]
                columns[0] = pa.array(np.full(rows, kind, np.int32))
                return pa.RecordBatch.from_arrays(columns, names=_FOUND)  # noqa: B023

            yield batch(b.num_rows, 0, rid=pa.array(np.arange(number, number + b.num_rows)), some=pa.array(some), row=b.column(0))
            number += b.num_rows
            if n:
                yield batch(n, 1, rid=pa.array(np.array(places[0], np.int64)), h=signed(places[1]), c1=signed(places[2]), c2=signed(places[3]), first=pa.array(places[4], pa.int64()), windows=pa.array(places[5], pa.int64()))
            if m:
                yield batch(m, 2, h=signed(contexts[0]), c1=signed(contexts[1]), c2=signed(contexts[2]), context=pa.array(contexts[3], pa.binary()))
        give_back()

    return run


_LIVE = ["bucket", "h", "c1", "c2", "n", "context"]


def _bucket_windows(length: int):
    """Of rows (bucket, h, c1, c2, n, context) in the order of these the runs lo..hi of windows that are repeated. A live
    context has a row with its number of places and no bytes, then rows with its bytes, as many as tasks that met it; bytes
    without such a row are dead. Copies go by one at a time: what is held is a bucket's distinct live contexts."""

    def settle(keys: list[tuple], texts: list[bytes], many: list[bool]):
        runs = [_ranges(flags | m) for flags, m in zip(repeated_windows(texts, length), many, strict=True)] if texts else []
        which = np.repeat(np.arange(len(runs)), [len(s) for s, _ in runs])
        names = np.array(keys, np.int64).reshape(-1, 3)[which]
        lo, hi = (np.concatenate([np.empty(0, np.int64), *(r[k] for r in runs)]).astype(np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([*(pa.array(names[:, k]) for k in range(3)), pa.array(lo), pa.array(hi)], names=["h", "c1", "c2", "lo", "hi"])

    def run(batches):
        bucket, wanted, places = None, None, 0
        keys, texts, many = [], [], []
        for b in batches:
            numbers = zip(*(b.column(k).to_pylist() for k in range(5)), strict=True)
            there = b.column(5).is_valid().to_pylist()
            for k, (own, h, c1, c2, n) in enumerate(numbers):
                if own != bucket:
                    if texts:
                        yield settle(keys, texts, many)
                    bucket, wanted, keys, texts, many = own, None, [], [], []
                if not there[k]:
                    wanted, places = (h, c1, c2), n
                elif wanted == (h, c1, c2):
                    keys.append(wanted)
                    texts.append(b.column(5)[k].as_py())
                    many.append(places > 1)
                    wanted = None
        if texts:
            yield settle(keys, texts, many)
        give_back()

    return run


def _crowd_windows(contexts: DataFrame, length: int) -> DataFrame:
    """The same for any number of contexts of an anchor, by a distributed suffix sort."""
    numbered = materialize(contexts.withColumn("id", F.monotonically_increasing_id()), "crowd")
    letters = F.decode("context", "ISO-8859-1")
    symbols = F.transform(F.sequence(F.lit(1), F.octet_length("context")), lambda i: (F.ascii(F.substring(letters, i, F.lit(1))) + 1).cast("long"))
    strings = materialize(numbered.select("id", symbols.alias("s")), "symbols")
    ranks = suffix_ranks(strings, length)
    starts = F.sequence(F.lit(0), F.octet_length("context") - length)
    each = numbered.join(ranks, "id").select("id", F.explode(F.transform(starts, lambda i: F.struct(i.alias("i"), F.get("r", i).alias("r"), F.unhex(F.md5(F.substring("context", i + 1, F.lit(length)))).alias("p")))).alias("x"))
    found = repeated_prefixes(each.select("id", "x.*")).unionByName(numbered.where("n > 1").select("id", F.explode(starts).alias("i"))).distinct()
    # runs of windows: what stays the same along a run is the place less its number
    run = F.col("i") - F.row_number().over(W.partitionBy("id").orderBy("i"))
    runs = found.select("id", "i", run.alias("g")).groupBy("id", "g").agg(F.min("i").cast("long").alias("lo"), F.max("i").cast("long").alias("hi"))
    return numbered.select("id", "h", "c1", "c2").join(runs, "id").select("h", "c1", "c2", "lo", "hi")


def _bitmap(repeated: DataFrame) -> bytes:
    """Of hashes h, a bitmap of BITS bits by the hashes' low bits, put together from at most BITS / 32 rows."""
    words = repeated.groupBy(F.expr(f"cast(shiftright(h & {BITS - 1}L, 5) as int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 31 as int)))").alias("b"))
    got = words.toArrow()
    out = np.zeros(BITS // 32, np.uint32)
    out[got.column("w").to_numpy()] = got.column("b").to_numpy().astype(np.uint32)
    return out.tobytes()


def repeat_spans(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(row, spans): each row of ``docs`` as a struct, and the byte spans array<struct<s, e>> of its text that are covered
    by repeated windows (null if none). Spans may overlap; e is the byte behind the last.

    Null and empty texts and texts shorter than a window have no span. Repeated rows are copies of each other and so
    repeat each other's windows. An empty table gives an empty one. The columns of ``docs`` may have any names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(text).cast("binary").alias("t"))
    counts = texts.mapInArrow(_count_anchors(length, gram), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    bitmap = spark.sparkContext.broadcast(_bitmap(counts.where("n > 1").select("h")))
    rows = docs.select(F.struct("*").alias("row"))
    row_type = rows.schema["row"].dataType.simpleString()
    schema = f"kind int, rid long, h long, c1 long, c2 long, first long, windows long, context binary, some boolean, row {row_type}"
    both = materialize(rows.mapInArrow(_write_contexts(length, gram, bitmap, docs.columns.index(text)), schema), "contexts", "kind")
    places, key = both.where("kind = 1").select("rid", "h", "c1", "c2", "first", "windows"), ["h", "c1", "c2"]
    # counted before anything is joined: an anchor with many places is a row a context from here on
    distinct = materialize(places.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("windows").alias("windows")), "distinct")
    anchors = distinct.groupBy("h").agg(F.sum("n").alias("places"), F.count(F.lit(1)).alias("k")).where("places > 1").select("h", (F.col("k") > CROWD).alias("crowd"))
    anchors = materialize(anchors, "anchors")
    live = materialize(distinct.join(anchors, "h"), "live")
    size = live.agg(F.coalesce(F.sum(F.when(~F.col("crowd"), F.col("windows") + length - 1)), F.lit(0)).alias("b"), F.coalesce(F.max("crowd"), F.lit(False)).alias("crowd")).first()
    contexts, bucket = both.where("kind = 2").select(*key, "context"), F.pmod("h", F.lit(max(1, size["b"] // BUCKET))).alias("bucket")
    quiet, crowd = contexts, live.where("crowd")
    if size["crowd"]:
        quiet = contexts.join(crowd.select("h").distinct(), "h", "left_anti")
    named = live.where("not crowd").select(bucket, *key, "n", F.lit(None).cast("binary").alias("context"))
    dealt = named.unionByName(quiet.select(bucket, *key, F.lit(None).cast("long").alias("n"), "context")).select(*_LIVE)
    # sorted, so that copies of a context follow each other and a task holds one
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", *key, F.col("context").isNotNull())
    found = dealt.mapInArrow(_bucket_windows(length), "h long, c1 long, c2 long, lo long, hi long")
    if size["crowd"]:
        found = found.unionByName(_crowd_windows(contexts.join(crowd.select(*key, "n"), key).dropDuplicates(key), length))
    marks = materialize(found.groupBy(*key).agg(F.collect_list(F.struct("lo", "hi")).alias("parts")), "marks")
    release(distinct, anchors, live)
    drop_path(spark, f"{both._written_to}/kind=2")  # contexts are not read any more
    spans = places.select("rid", *key, "first").join(marks, key).select("rid", "first", F.explode("parts").alias("p"))
    spans = spans.select("rid", F.struct((F.col("first") + F.col("p.lo")).alias("s"), (F.col("first") + F.col("p.hi") + length).alias("e")).alias("x"))
    spans = spans.groupBy("rid").agg(F.sort_array(F.collect_list("x")).alias("spans"))
    kept = both.where("kind = 0")
    clean = kept.where("not some").select("row", F.lit(None).cast("array<struct<s:bigint,e:bigint>>").alias("spans"))
    return clean.unionByName(kept.where("some").select("rid", "row").join(spans, "rid", "left").select("row", "spans"))


def merge_spans(spans) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes; spans that touch are one run."""
    out: list[list[int]] = []
    for p in sorted((p["s"], p["e"]) for p in spans or ()):
        if out and p[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], p[1])
        else:
            out.append(list(p))
    return [tuple(p) for p in out]


def cut(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The bytes outside the runs."""
    ends = [0, *(e for _, e in runs)]
    return b"".join(text[a:b] for a, b in zip(ends, [*(s for s, _ in runs), len(text)], strict=True))


def whole_characters(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without characters of UTF-8 that they cover in part."""
    out = []
    for s, e in runs:
        while s < len(text) and text[s] & 0xC0 == 0x80:
            s += 1
        while 0 < e < len(text) and text[e] & 0xC0 == 0x80:
            e -= 1
        if s < e:
            out.append((s, e))
    return out


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of each row after its repeated bytes are removed.

    Null texts are empty ones and texts shorter than a window stay whole. Repeated rows are copies of each other; null keys
    are rows like any other; an empty table gives an empty one; other columns are not read."""
    found = repeat_spans(docs.select(key, text), text, length)

    def run(batches):
        for b in batches:
            out = [[], [], [], []]
            for t, spans in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                raw = t.as_py() or b""
                runs = merge_spans(spans)
                for o, v in zip(out, (len(raw), sum(e - s for s, e in runs), len(runs), hashlib.sha256(cut(raw, runs)).hexdigest()), strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(o, pa.int64()) for o in out[:3]), pa.array(out[3], pa.string())], names=["k", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    flat = found.select(F.col("row")[key].alias("k"), F.col("row")[text].cast("binary").alias("t"), "spans")
    kind = docs.schema[key].dataType.simpleString()
    return flat.mapInArrow(run, f"k {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("k", key)


def without_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, chars: str | None = None) -> DataFrame:
    """``docs`` with the repeated bytes cut out of the text; a character that is covered in part stays whole. ``chars``
    names a column to set to the new number of characters. Every row stays, also where nothing of its text does; null and
    empty texts and those without repeated bytes stay as they are; repeated rows lose all that is a window long. An empty
    table gives an empty one."""
    found = repeat_spans(docs, text, length)
    text_at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            out = []
            for t, spans in zip(b.column(1).field(text_at).cast(pa.binary()), b.column(0).to_pylist(), strict=True):
                raw = t.as_py() or b""
                out.append(cut(raw, whole_characters(raw, merge_spans(spans))))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), b.column(1)], names=["t", "row"])
        give_back()

    hit = found.where(F.col("spans").isNotNull()).select("spans", "row")
    new = hit.mapInArrow(run, f"t binary, row {hit.schema['row'].dataType.simpleString()}")
    changed = {text: F.col("t").cast(docs.schema[text].dataType)}
    if chars:
        changed[chars] = F.char_length(F.col("t").cast("string")).cast(docs.schema[chars].dataType)
    new = new.select(*(changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
    return found.where(F.col("spans").isNull()).select("row.*").unionByName(new)
