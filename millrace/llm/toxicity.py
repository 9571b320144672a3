"""Toxicity by a linear classifier on character n-grams that are scaled by naive Bayes log-count ratios.

The n-grams of a lower-cased text are hashed to columns and count once a text. The ratio of a column is the log of its
smoothed share of toxic texts over its share of other texts; a text's vector of ratios is scaled to length 1, so long
texts weigh no more than short ones. A support vector machine with squared hinge loss is trained on these vectors by dual
coordinate descent, and a sigmoid, fitted on margins of rows that were left out in turn, maps its margin to 0..1.

Training reads a bounded sample of labelled rows (``SAMPLE``, in the order of a hash of the key), whose columns come to
the driver; scoring is one scan without a shuffle. The settings below were chosen by cross-validation within the rows
that labels are learnt from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.text import map_texts

ORDERS, BITS = (3, 4, 5), 20
#: Labelled rows that are fitted on at most; smoothing of the ratios (as rows of each class's prior); cost of the support
#: vector machine; passes; parts that are left out in turn for the sigmoid.
SAMPLE, ALPHA, COST, PASSES, FOLDS = 4_000, 1.0, 1.0, 12, 2
THRESHOLD = 0.7
#: Characters that are hashed at a time.
PIECE = 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)


def columns_of(text: str | None, stamp: np.ndarray) -> np.ndarray:
    """The distinct hashed n-grams of the whole text. ``stamp`` is scratch of 2**BITS integers."""
    raw = (text or "").lower().encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(raw, np.uint32)
    parts = []
    for at in range(0, len(points), PIECE):
        x = points[at : at + PIECE + max(ORDERS) - 1].astype(np.uint64)
        h = np.zeros(len(x), np.uint64)
        for k in range(1, max(ORDERS) + 1):
            if len(x) < k:
                break
            h = (h[: len(x) - k + 1] + x[k - 1 :] + np.uint64(1)) * _MIX
            h ^= h >> np.uint64(31)
            if k in ORDERS:
                parts.append(((h[:PIECE] * _MIX) >> np.uint64(64 - BITS)).astype(np.int64))
    if not parts:
        return np.empty(0, np.int32)
    i = np.concatenate(parts)
    n = np.arange(len(i), dtype=stamp.dtype)
    stamp[i] = n
    return i[stamp[i] == n].astype(np.int32)


def ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The log of each column's smoothed share of the rows with y > 0 over that of the others. A column gets ALPHA rows
    more, of which each class holds its own part, so one that no row has is at 0."""
    sides = []
    for up in (True, False):
        n = np.zeros(1 << BITS, np.float32)
        for i in np.flatnonzero((y > 0) == up):
            n[rows[i]] += 1
        total = ((y > 0) == up).sum()
        sides.append((n + ALPHA * total / len(y)) / (total + ALPHA * total / len(y)))
    return np.log(sides[0] / sides[1])


def _scale(ratio: np.ndarray, row: np.ndarray) -> float:
    v = ratio[row]
    return float(1 / np.sqrt(v @ v + 1e-9))


def fit(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights (of unscaled ratios) and bias of the squared-hinge machine, by dual coordinate descent over rows in a fixed
    shuffled order."""
    w, bias, a = np.zeros(1 << BITS, np.float32), 0.0, np.zeros(len(rows))
    # the rarer class weighs as much as the other
    share = np.where(y > 0, 0.5 / max(1e-9, (y > 0).mean()), 0.5 / max(1e-9, (y < 0).mean()))
    ridge = 1 / (2 * COST * share)
    scale = np.array([_scale(ratio, i) for i in rows])
    turn = np.random.default_rng(0)
    idle = np.zeros(len(rows), bool)
    for k in range(PASSES):
        most, whole = 0.0, k % 4 == 0
        # rows beyond the margin are looked at in every fourth pass only
        for i in turn.permutation(len(rows) if whole else np.flatnonzero(~idle)):
            value = ratio[rows[i]]
            g = y[i] * (float(w[rows[i]] @ value) * scale[i] + bias) - 1 + ridge[i] * a[i]
            new = max(0.0, a[i] - g / (2 + ridge[i]))
            if new != a[i]:
                step = (new - a[i]) * y[i]
                w[rows[i]] += np.float32(step * scale[i]) * value
                bias += step
                most = max(most, abs(g))
                a[i] = new
            idle[i] = not a[i]
        if most < 1e-3 and whole:
            break
    return w, bias


def _sigmoid(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, with smoothed targets, by Newton steps."""
    up = (y > 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (len(y) - up + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        e, s = p - t, np.maximum(p * (1 - p), 1e-9)
        g = np.array([e @ margin, e.sum()])
        h = np.array([[s @ margin**2 + 1e-6, s @ margin], [s @ margin, s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return max(a, 1e-6), b


class Model:
    """Weights and ratios of columns, bias, and the sigmoid; without rows of both labels it scores every text 0."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray):
        self.ratio = self.weights = np.zeros(1 << BITS, np.float32)
        self.bias, self.slope, self.offset = 0.0, 0.0, -30.0
        y = np.where(labels > 0, 1, -1)
        if len(set(y.tolist())) < 2:
            return
        part, margins = np.empty(len(y), int), []
        for up in (1, -1):  # each class is dealt out evenly
            part[y == up] = np.arange((y == up).sum()) % FOLDS
        for k in range(FOLDS):
            seen, unseen = np.flatnonzero(part != k), np.flatnonzero(part == k)
            if len(set(y[seen].tolist())) == 2:
                self._train([rows[i] for i in seen], y[seen])
                margins.append((np.array([self.margin(rows[i]) for i in unseen]), y[unseen]))
        self._train(rows, y)
        if not margins:
            margins.append((np.array([self.margin(r) for r in rows]), y))
        self.slope, self.offset = _sigmoid(*map(np.concatenate, zip(*margins, strict=True)))

    def _train(self, rows: list[np.ndarray], y: np.ndarray) -> None:
        self.ratio = ratios(rows, y)
        w, self.bias = fit(rows, y, self.ratio)
        self.weights = w * self.ratio

    def margin(self, row: np.ndarray) -> float:
        return float(self.weights[row].sum()) * _scale(self.ratio, row) + self.bias

    def score(self, text: str | None, stamp: np.ndarray) -> float:
        m = self.margin(columns_of(text, stamp))
        return float(1 / (1 + np.exp(-np.clip(self.slope * m + self.offset, -30, 30))))


def _views(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The binaries of the column as integers, without a copy: they stay in the column's own buffers."""
    out = []
    for c in column.chunks:
        _, offsets, data = c.buffers()
        ends = np.frombuffer(offsets, np.int32)[c.offset : c.offset + len(c) + 1]
        if data is None:
            out += [np.empty(0, np.int32)] * len(c)
        else:
            out += [np.frombuffer(data, np.int32, (e - s) // 4, s) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return out


def held_out(key: str = "doc_id"):
    """True for rows whose labels are never learnt from; a null key counts as held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled keys that are not held out. A key with several labels takes the highest;
    null labels are none. The sample is in the order of a hash of the key, so it does not depend on partitioning."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("k")).agg(F.max(label).alias("y"))
    known = known.orderBy(F.xxhash64("k"), "k").limit(sample)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(known), "k").select("k", "y", "t")

    def run(batches):
        stamp = np.zeros(1 << BITS, np.int32)
        for b in batches:
            got = [columns_of(t.as_py(), stamp).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary()), b.column(2)], names=["y", "i", "o"])

    kind = rows.schema["y"].dataType.simpleString()
    # one row a key: of texts that repeat a key the first by hash, so the sample is bounded and no key weighs more
    got = rows.select("y", "t", F.xxhash64("k").alias("o")).mapInArrow(run, f"y {kind}, i binary, o long")
    got = got.groupBy("o").agg(F.max("y").alias("y"), F.min("i").alias("i")).orderBy("o").toArrow()
    return Model(_views(got.column("i")), got.column("y").to_numpy())


def with_score(docs: DataFrame, model: Model, text: str = "text", name: str = "score", keep_below: float | None = None) -> DataFrame:
    """``docs`` with a score of each whole text in column ``name``, in place of a column of that name; with
    ``keep_below`` only the rows that score less than that, without the score.

    Null and empty texts are scored by the bias alone. Repeated rows and equal texts score alike; an empty table gives an
    empty one; the other columns may have any names, the same ones too.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts):
        stamp = np.zeros(1 << BITS, np.int32)
        s = np.array([shared.value.score(t.as_py(), stamp) for t in texts], float)
        return [pa.array(s)] if keep_below is None else pa.array(s < keep_below)

    if keep_below is not None:
        return map_texts(docs, text, score, keep=True)
    return map_texts(docs, text, score, {name: "double"})
