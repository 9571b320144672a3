"""Periodic runs of words: stretches that repeat themselves at a fixed distance, found exactly in n log n pairs.

A run of smallest period q and at least 2q words holds two neighbouring points of the grid 0, q, 2q, ... So for each period
p up to half of a text the grid points (k p, (k + 1) p) are looked at, n / p of them and n log n in all (a harmonic sum).
All (period, grid point) pairs of a slice of texts are handled at once in NumPy: pairs of unequal words go, then pairs whose
surroundings can't make up the least length; for the others the longest common extensions to both sides are found by
binary search on prefix hashes, for all pairs simultaneously. Stretches that several pairs or multiples of a period give
are made one, and each is verified on the words themselves; should a hash ever have lied, the slice is done again with
other bases, so results are exact.

Texts are not shuffled: one scan. Memory is a slice of texts (or one text) and blocks of PAIRS pairs.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.text import map_texts, word_pieces

#: Words that a run has at least, and pairs that are held at a time (a period's pairs stay together).
LEAST, PAIRS = 12, 1 << 19
#: Moduli of the two prefix hashes: their products fit 64 bits, and sums of up to 2**32 residues too.
PRIMES = (2_147_483_647, 2_147_483_629)

_RUNS = "array<struct<start:long,length:long,period:long>>"


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class PrefixHashes:
    """Two polynomial prefix hashes of a sequence of word numbers."""

    def __init__(self, ids: np.ndarray, attempt: int):
        self.parts = []
        rng = np.random.default_rng(attempt)
        for prime in PRIMES:
            base, salt = (int(x) for x in rng.integers(1 << 20, prime - 1, 2))
            powers = np.ones(len(ids) + 1, np.int64)
            done, step = 1, base
            while done < len(powers):  # twice as many each time
                powers[done : 2 * done] = powers[: min(done, len(powers) - done)] * step % prime
                done, step = 2 * done, step * step % prime
            terms = ((ids + 1) * np.int64(salt) % prime) * powers[:-1] % prime
            self.parts.append((prime, powers, np.concatenate([[0], np.cumsum(terms) % prime])))

    def equal(self, a: np.ndarray, p: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the words at a .. a + size hash as those p further on."""
        same = np.ones(len(a), bool)
        for prime, powers, sums in self.parts:
            same &= ((sums[a + size] - sums[a]) % prime * powers[p] - (sums[a + p + size] - sums[a + p])) % prime == 0
        return same


def _longest(most: np.ndarray, holds) -> np.ndarray:
    """The largest value up to ``most`` of each pair that ``holds``, by binary search in all pairs at once."""
    low, high = np.zeros_like(most), most.copy()
    while (low < high).any():
        mid = (low + high + 1) // 2
        ok = holds(mid)
        low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
    return low


def _pairs(ids: np.ndarray, starts: np.ndarray, least: int):
    """Blocks of (position, period, text) of grid points with equal words a period apart."""
    sizes = np.diff(starts)
    half = np.where(sizes >= least, sizes // 2, 0)
    text = np.repeat(np.arange(len(sizes)), half)  # a row for each text and period
    period = np.arange(len(text)) - np.repeat(np.cumsum(half) - half, half) + 1
    points = (sizes[text] - 1) // np.maximum(period, 1)
    before = np.cumsum(points) - points
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(before, before[at] + PAIRS, "right")) - 1) if before[-1] > before[at] + PAIRS else len(text)
        row = np.repeat(np.arange(at, to), points[at:to])
        p = period[row]
        i = starts[text[row]] + (np.arange(len(row)) - (before[row] - before[at])) * p
        same = ids[i] == ids[i + p]
        yield i[same], p[same], text[row[same]]
        at = to


def _found(ids: np.ndarray, starts: np.ndarray, least: int, attempt: int) -> np.ndarray:
    """(start, end, period) of each stretch, once, with its smallest period; not verified yet."""
    hashes, out = PrefixHashes(ids, attempt), [np.empty((0, 3), np.int64)]
    for i, p, text in _pairs(ids, starts, least):
        first, end = starts[text], starts[text + 1]
        need = np.maximum(least - p, p)  # words to both sides that must recur, so half of them to one side
        part = (need + 1) // 2
        ahead, back = i + p + part <= end, i - part >= first
        ahead[ahead] = hashes.equal(i[ahead], p[ahead], part[ahead])
        back[back] = hashes.equal((i - part)[back], p[back], part[back])
        keep = ahead | back
        i, p, first, end, need = i[keep], p[keep], first[keep], end[keep], need[keep]
        after = _longest(end - i - p, lambda n, i=i, p=p: hashes.equal(i, p, n))
        ahead_of = _longest(i - first, lambda n, i=i, p=p: hashes.equal(i - n, p, n))
        long = after + ahead_of >= need
        out.append(_smallest(np.stack([(i - ahead_of)[long], (i + p + after)[long], p[long]], 1)))
        if len(out) > 64 or sum(map(len, out[1:])) > PAIRS:
            out = [_smallest(np.concatenate(out))]
    return _smallest(np.concatenate(out))


def _smallest(rows: np.ndarray) -> np.ndarray:
    """Of rows with equal start and end that with the smallest period."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    return rows[new]


def find(ids: np.ndarray, starts: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, end, period) of every run in texts of word numbers, ``starts[k] : starts[k + 1]`` each, by start and period.

    A run has at least ``least`` words and twice its smallest period, and no neighbouring word of its text extends it."""
    for attempt in itertools.count():
        rows = _found(ids, starts, least, attempt)
        if all(np.array_equal(ids[s : e - p], ids[s + p : e]) for s, e, p in rows.tolist()):
            return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word numbers of all texts, where each text starts (and the end), and the words by number."""
    table, parts, sizes = _Numbers(), [np.empty(0, np.int64)], []
    for t in texts:
        n = 0
        for words in word_pieces(t):
            parts.append(np.fromiter(map(table.__getitem__, words), np.int64, len(words)))
            n += len(words)
        sizes.append(n)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64), list(table)


def _joined(ids: np.ndarray, words: list[bytes]) -> bytes:
    return b" ".join(b" ".join(map(words.__getitem__, ids[k : k + (1 << 16)].tolist())) for k in range(0, len(ids), 1 << 16))


def with_runs(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with n_words, runs (start, length and period in words, by start and period) and collapsed (the words that
    no run contains after its first period, joined by one space) of each whole text, in place of columns of these names.

    Words are maximal stretches of characters other than 0x20 and 0x09 to 0x0D. Null, empty and blank texts have no words,
    no runs and an empty collapsed text. Overlapping and nested runs are all returned; a stretch is returned once, with its
    smallest period. Equal texts get equal results; an empty table gives an empty one; other columns stay."""

    def make(column):
        ids, starts, words = _numbered([t.as_py() or b"" for t in column])
        rows = find(ids, starts, least)
        cover = np.zeros(len(ids) + 1, np.int64)
        np.add.at(cover, rows[:, 0] + rows[:, 2], 1)
        np.add.at(cover, rows[:, 1], -1)
        kept = np.cumsum(cover[:-1]) == 0
        collapsed = [_joined(ids[a:b][kept[a:b]], words) for a, b in itertools.pairwise(starts.tolist())]
        ends = np.searchsorted(rows[:, 0], starts).astype(np.int32)
        own = np.repeat(starts[:-1], np.diff(ends))
        fields = [pa.array(x) for x in (rows[:, 0] - own, rows[:, 1] - rows[:, 0], rows[:, 2])]
        found = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
        return [pa.array(np.diff(starts)), found, pa.array(collapsed, pa.binary()).cast(pa.string())]

    return map_texts(docs, text, make, {"n_words": "long", "runs": _RUNS, "collapsed": "string"}, binary=True)
