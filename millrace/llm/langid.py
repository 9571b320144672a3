"""Language identification by multinomial naive Bayes over hashed character n-grams.

Learning: keys of labelled rows are counted by language, without their texts; of each language about ``SAMPLE`` keys, chosen by a
hash of the key, give a text each; tasks count n-grams in arrays and send non-zero cells, whose sums (at most LANGUAGES x
2**BITS cells, whatever the input) make the matrix of smoothed log probabilities.

Prediction: the matrix is broadcast, and each slice of texts is scored at once: hashed n-grams of all its texts are rows of a
sparse matrix, held by positions, whose product with the log probabilities is gathered and summed by text. One scan, no
shuffle.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.text import map_texts, small_batches

ORDERS, BITS = (1, 2, 3, 4), 16
#: Keys of a language that are learnt from, about; languages that are learnt at most (the most frequent); what is added to
#: each cell; n-grams that are scored at a time; what is predicted for texts without a letter.
SAMPLE, LANGUAGES, ALPHA, PIECE, UNKNOWN = 3_000, 128, 0.5, 1 << 16, "und"

_MIX = np.uint64(0x9E3779B97F4A7C15)
_NO_LETTERS = re.compile(r"[\W\d_]+")


def plain(text: str | None) -> str:
    """Lower-cased letters; whatever is between them is one blank."""
    return _NO_LETTERS.sub(" ", (text or "").lower())


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def grams(text: str) -> np.ndarray:
    """The hashed n-grams of a text of :func:`plain`, repeats included."""
    x = np.frombuffer(f" {text.strip()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h, parts = np.zeros(len(x), np.uint64), []
    for k in range(1, max(ORDERS) + 1):
        if len(x) < k:
            break
        h = (h[: len(x) - k + 1] + x[k - 1 :] + np.uint64(1)) * _MIX
        h ^= h >> np.uint64(31)
        if k in ORDERS:
            parts.append(((h * _MIX) >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(parts)


def gram_pieces(text: str | None, size: int = PIECE):
    """The n-grams of a text, for about ``size`` characters at a time."""
    x = plain(text)
    at = 0
    while at < len(x):
        end = len(x) if len(x) <= at + size else x.find(" ", at + size)
        end = min(len(x) if end < 0 else end, at + 2 * size)
        yield grams(x[at:end])
        at = end


class Model:
    """Languages in order of their names, and the log probability of each n-gram in each, with the languages' priors."""

    def __init__(self, languages: list[str], counts: np.ndarray, rows: np.ndarray):
        self.languages = languages
        smooth = counts.astype(np.float64) + ALPHA
        self.log = np.ascontiguousarray(np.log(smooth / smooth.sum(1, keepdims=True)).T, np.float32) if languages else np.empty((0, 0), np.float32)
        self.prior = np.log(rows / rows.sum()) if languages else np.empty(0)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The log of each language's prior times the texts' likelihood, up to a constant: a row a text."""
        out = np.tile(self.prior, (len(texts), 1))
        held, owner, size = [], [], 0

        def flush():
            nonlocal held, owner, size
            if held:
                starts = np.cumsum([0, *map(len, held[:-1])])
                got = np.add.reduceat(self.log[np.concatenate(held)], starts, axis=0, dtype=np.float64)
                np.add.at(out, owner, got)
            held, owner, size = [], [], 0

        for k, t in enumerate(texts):
            for g in gram_pieces(t):
                held.append(g)
                owner.append(k)
                size += len(g)
                if size >= PIECE:
                    flush()
        flush()
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """A language and its posterior probability for each text; ``UNKNOWN`` and 0 for texts without a letter."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        s = self.scores(texts)
        s = np.exp(s - s.max(1, keepdims=True))
        best = s.argmax(1)
        letters = np.array([has_letter(t) for t in texts], bool)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters, strict=True)]
        return names, np.where(letters, s.max(1) / s.sum(1), 0.0)


def held_out(key: str = "doc_id") -> Column:
    """True for rows that are never learnt from; a null key counts as held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Learn from rows that are not held out and have a language.

    Of each of the ``LANGUAGES`` most frequent languages (ties by name) about ``sample`` keys are taken, those with the
    smallest hashes: where it has fewer keys, all. A key with several rows gives one, the smallest language and text, so no
    key weighs more than another. Priors are the estimated numbers of keys in the whole table. Texts without a letter teach
    nothing; without labelled rows the model knows no language."""
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.where(~held_out(key) & F.col(lang).isNotNull()).select(F.xxhash64(F.col(key)).alias("k"), F.col(lang).cast("string").alias("l"), F.col(text).alias("t"))
    # a sketch counts keys without moving them
    keys = known.groupBy("l").agg(F.approx_count_distinct("k").alias("n"))
    found = sorted(keys.orderBy(F.desc("n"), "l").limit(LANGUAGES).collect(), key=lambda r: r["l"])
    if not found:
        return Model([], np.empty((0, 0)), np.empty(0))
    names, rows = [r["l"] for r in found], np.array([r["n"] for r in found], float)
    # hashes are even over 64 bits, so the share below a bound is known
    share = {r["l"]: min(1.0, sample / r["n"]) for r in found}
    bound = F.create_map(*(F.lit(x) for n in names for x in (n, min((1 << 63) - 1, int(share[n] * (1 << 64)) - (1 << 63)))))
    chosen = known.where(F.col("k") <= bound[F.col("l")])
    chosen = chosen.groupBy("k").agg(F.min(F.struct("l", "t")).alias("x")).select("x.l", "x.t")

    def count(batches):
        at, cells = {n: k for k, n in enumerate(names)}, {}
        for b in batches:
            for language, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for g in gram_pieces(t.as_py()):
                    cells.setdefault(at[language], np.zeros(1 << BITS, np.int64))[:] += np.bincount(g, minlength=1 << BITS)
        for k, n in cells.items():
            i = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k, np.int32)), pa.array(i.astype(np.int32)), pa.array(n[i])], names=["l", "g", "n"])

    got = chosen.mapInArrow(count, "l int, g int, n long").groupBy("l", "g").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(names), 1 << BITS), np.int64)
    counts[got.column("l").to_numpy(), got.column("g").to_numpy()] = got.column("n").to_numpy()
    return Model(names, counts, rows)


def with_language(docs: DataFrame, model: Model, text: str = "text", name: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the language of each whole text and its posterior probability, in place of columns of these names.

    Texts that are null or have no letter get ``UNKNOWN`` and 0, as do all where the model knows no language. Equal texts
    get equal results; an empty table gives an empty one; other columns stay, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(texts):
        names, p = shared.value.predict([t.as_py() for t in texts])
        return [pa.array(names, pa.string()), pa.array(p)]

    return map_texts(docs, text, make, {name: "string", score: "double"})
