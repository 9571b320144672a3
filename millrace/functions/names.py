"""Similarity of names by longest matching blocks, in Arrow batches: no built-in function gives the same ratio."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Fixed value: from this length of the second text on, characters that make up more than a hundredth of it begin no block.
FREQUENT_FROM = 200


def _runs(a: np.ndarray, b: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """How far back both texts agree up to each pair of places (with a border of zeros), over characters of b that may begin
    a block."""
    equal = (a[:, None] == b[None, :]) & anchors[None, :]
    out = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a)):
        out[i + 1, 1:] = np.where(equal[i], out[i, :-1] + 1, 0)
    return out


def matched(a: str, b: str) -> int:
    """Characters in matching blocks: the longest block (of equals the first in a, then in b), then the same to its left and
    right."""
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    anchors = np.ones(len(y), bool)
    if len(y) >= FREQUENT_FROM:
        kinds, which, n = np.unique(y, return_inverse=True, return_counts=True)
        anchors = (n <= len(y) // 100 + 1)[which]
    back, total, open_ = _runs(x, y, anchors), 0, [(0, len(x), 0, len(y))]
    while open_:
        i0, i1, j0, j1 = open_.pop()
        if i0 == i1 or j0 == j1:
            continue
        inside = np.minimum(back[i0 + 1 : i1 + 1, j0 + 1 : j1 + 1], np.minimum.outer(np.arange(1, i1 - i0 + 1), np.arange(1, j1 - j0 + 1)))
        size = int(inside.max())
        # of blocks of the longest size the first end has the first start
        i, j = (int(k) for k in np.unravel_index(int(inside.argmax()), inside.shape)) if size else (-1, -1)
        i, j = i0 + i + 1 - size, j0 + j + 1 - size
        end_i, end_j = i + size, j + size
        while i > i0 and j > j0 and x[i - 1] == y[j - 1]:  # characters that begin no block may belong to one
            i, j = i - 1, j - 1
        while end_i < i1 and end_j < j1 and x[end_i] == y[end_j]:
            end_i, end_j = end_i + 1, end_j + 1
        if end_i > i:
            total += end_i - i
            open_ += [(i0, i, j0, j), (end_i, i1, end_j, j1)]
    return total


def ratio(a: str | None, b: str | None) -> float:
    """Twice the matched characters over all characters; 0 if either is empty or missing."""
    return 2 * matched(a, b) / (len(a) + len(b)) if a and b else 0.0


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """:func:`ratio` of each row."""
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def stem(name):
    """The lower-cased name without its extension and without all but a-z and 0-9."""
    return F.regexp_replace(F.lower(F.regexp_replace(name, r"\.[^./]*$", "")), "[^a-z0-9]+", "")
