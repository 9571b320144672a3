"""Where a frame's content lies: uniform bars, hard boundaries of an embedded picture, padding that a decoder put around it,
and mean brightness over a grid. Frames are row-major arrays of brightness with their width; NumPy in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

# Spread of a uniform line and of padding; how far the means of two bars may lie apart; symmetry of two bars; the
# least and largest share of a side that an embedded picture takes, and the places it is looked for at; what its boundary
# and its detail must exceed.
LINE_SPREAD, PAD_SPREAD, BAR_MEANS, SYMMETRY, BAR_CONFIDENCE = 12, 10, 18, 0.55, 0.965
LEAST_SHARE, MOST_SHARE, CONTENT_RATIO, OFFSETS = 0.20, 0.68, 1.05, (-0.10, -0.06, -0.03, 0.0, 0.03, 0.06, 0.10)
BOUNDARY, OVER_P80, OVER_MEDIAN, BALANCE, DETAIL, BACKGROUND, SURE = 8.0, 1.70, 2.40, 0.55, 1.20, 0.42, 0.94

_BOX = [StructField(c, IntegerType()) for c in ("left", "top", "width", "height")]
_BOUNDS = StructType([*_BOX, StructField("confidence", DoubleType()), StructField("method", StringType())])


def uniform_lines(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(flags, means) of the rows: uniform if the 90th percentile exceeds the 10th by at most LINE_SPREAD. Long rows are
    sampled."""
    lines = image[:, :: max(1, image.shape[1] // 160)]
    ordered, n = np.sort(lines, axis=1), lines.shape[1]
    return ordered[:, int((n - 1) * 0.90)] - ordered[:, int((n - 1) * 0.10)] <= LINE_SPREAD, lines.mean(axis=1)


def extent(flags: np.ndarray) -> int:
    """How far true flags reach from the start, over gaps of at most two; 0 unless two thirds of the first three hold."""
    first = flags[:3]
    if not len(flags) or first.sum() < max(1, int(np.ceil(len(first) * 0.67))):
        return 0
    gap = np.flatnonzero(~flags[:-2] & ~flags[1:-1] & ~flags[2:])
    held = np.flatnonzero(flags[: gap[0]] if len(gap) else flags)
    return int(held[-1]) + 1 if len(held) else 0


def bars(image: np.ndarray) -> tuple[int, int]:
    """Heights of the uniform bars at the top and the bottom; (0, 0) unless both are there, alike and neither thin nor all."""
    flags, means = uniform_lines(image)
    size = len(flags)
    a, b = extent(flags), extent(flags[::-1])
    if min(a, b) < max(2, int(size * 0.015)) or a + b < max(4, int(size * 0.06)) or min(a, b) / max(a, b) < SYMMETRY or size - a - b < size * 0.15:
        return 0, 0
    return (a, b) if abs(means[:a].mean() - means[size - b :].mean()) <= BAR_MEANS else (0, 0)


def boundary(image: np.ndarray) -> tuple[int, int, float] | None:
    """(start, end, confidence) of the columns of a picture embedded in a soft background: two hard boundaries over the whole
    height, more detail between them than around. All sizes and places are judged at once, on prefix sums of the differences
    of neighbouring columns; the first of the most confident wins."""
    height, width = image.shape
    rows = image[:: max(1, height // 120)].astype(float)
    profile = np.abs(np.diff(rows, axis=1)).mean(axis=0)
    n = len(profile)
    if n < 16:
        return None
    ordered = np.sort(profile)
    median, p80 = ordered[n // 2], ordered[int((n - 1) * 0.80)]
    least, most = max(12, int(width * LEAST_SHARE)), min(int(height / CONTENT_RATIO), int(width * MOST_SHARE))
    if most < least:
        return None
    sizes = np.repeat(np.arange(least, most + 1), len(OFFSETS))
    start = (width - sizes) // 2 + np.tile(np.rint(np.array(OFFSETS) * width).astype(int), most + 1 - least)
    end, margin = start + sizes, max(4, int(width * 0.04))
    inside = (start >= margin) & (width - end >= margin)
    start, end = start[inside], end[inside]
    if not len(start):
        return None
    before = np.concatenate([[0.0], np.cumsum(profile)])

    def mean(lo, hi):
        return np.where(hi > lo, (before[np.maximum(hi, lo)] - before[lo]) / np.maximum(hi - lo, 1), 0.0)

    low, high = np.minimum(profile[start - 1], profile[end - 1]), np.maximum(profile[start - 1], profile[end - 1])
    left, right = mean(np.zeros_like(start), np.maximum(1, start - 1)), mean(np.minimum(n, end + 1), np.full_like(end, n))
    active = mean(np.minimum(n, start + 1), np.maximum(np.minimum(n, start + 2), np.minimum(n, end - 1)))
    detail = (active + 1) / ((left + right) / 2 + 1)
    good = (low >= max(BOUNDARY, p80 * OVER_P80, median * OVER_MEDIAN)) & (low / np.maximum(high, 0.001) >= BALANCE) & (detail >= DETAIL) & ((np.minimum(left, right) + 1) / (np.maximum(left, right) + 1) >= BACKGROUND)
    sure = np.minimum(0.995, 0.90 + np.minimum(0.055, np.maximum(0.0, low / max(p80, 1.0) - OVER_P80) * 0.035) + np.minimum(0.040, np.maximum(0.0, detail - DETAIL) * 0.050))
    sure = np.where(good & (sure >= SURE), sure, -1.0)
    k = int(sure.argmax())
    return (int(start[k]), int(end[k]), float(sure[k])) if sure[k] > 0 else None


def candidates(image: np.ndarray) -> list[tuple]:
    """(left, top, width, height, confidence, method) of every way to see the frame's content: between bars above and below,
    between bars at the sides, and between hard boundaries along either axis."""
    height, width = image.shape
    out = []
    top, bottom = bars(image)
    if top:
        out.append((0, top, width, height - top - bottom, BAR_CONFIDENCE, "uniform"))
    left, right = bars(image.T)
    if left:
        out.append((left, 0, width - left - right, height, BAR_CONFIDENCE, "uniform"))
    for turned in (False, True):
        found = boundary(image.T if turned else image)
        if found:
            a, b, sure = found
            out.append((0, a, width, b - a, sure, "boundary") if turned else (a, 0, b - a, height, sure, "boundary"))
    return out


def expected_size(ratio: float, side: int) -> tuple[int, int]:
    """The even size that content of a ratio takes in a square."""
    other = lambda x: max(2, int(x / 2) * 2)
    return (side, other(side / ratio)) if ratio >= 1 else (other(side * ratio), side)


def _unpadded(image: np.ndarray, width: int, height: int) -> tuple[int, int, int, int] | None:
    """The centred content of an expected size if what is around it is uniform, band by band and as a whole."""
    side = image.shape[0]
    if width >= side and height >= side:
        return 0, 0, side, side
    left, top, step = (side - width) // 2, (side - height) // 2, max(1, side // 64)
    right, bottom = left + width, top + height
    bands = [image[: max(0, top - 1) : step, ::step], image[bottom + 1 :: step, ::step], image[top:bottom:step, : max(0, left - 1) : step], image[top:bottom:step, right + 1 :: step]]
    ends = [(b.min(), b.max()) for b in bands if b.size]
    uniform = all(hi - lo <= PAD_SPREAD for lo, hi in ends) and (not ends or max(hi for _, hi in ends) - min(lo for lo, _ in ends) <= PAD_SPREAD)
    return (left, top, width, height) if uniform else None


def content(image: np.ndarray, ratio: float | None) -> tuple | None:
    """(left, top, width, height, transposed) of a square frame's content of a ratio; the ratio turned on its side is tried
    next. None where neither is surrounded by uniform padding."""
    if ratio is None or not np.isfinite(ratio) or ratio <= 0 or image.shape[0] != image.shape[1]:
        return None
    width, height = expected_size(ratio, image.shape[0])
    for w, h, turned in ((width, height, False), (height, width, True)):
        found = _unpadded(image, w, h)
        if found:
            return (*found, turned)
        if w == h:
            break
    return None


def grid_means(image: np.ndarray, cells: int, samples: int = 8) -> np.ndarray:
    """Mean brightness of cells x cells parts, row by row, from at most samples x samples pixels of each, evenly spread."""

    def places(n: int) -> tuple[np.ndarray, np.ndarray]:
        bands = [(k * n // cells, max(k * n // cells + 1, (k + 1) * n // cells)) for k in range(cells)]
        each = [np.arange(a, b) if b - a <= samples else a + np.arange(samples) * (b - a) // samples for a, b in bands]
        return np.concatenate(each), np.cumsum([0, *map(len, each)])[:-1]

    (rows, r), (columns, c) = places(image.shape[0]), places(image.shape[1])
    picked = image[rows][:, columns].astype(float)
    total = np.add.reduceat(np.add.reduceat(picked, r, axis=0), c, axis=1)
    count = np.outer(np.diff([*r, len(rows)]), np.diff([*c, len(columns)]))
    return (total / count).ravel()


def _images(pixels: pd.Series, width: pd.Series):
    for p, w in zip(pixels, width, strict=True):
        yield np.asarray(p, float).reshape(-1, int(w)) if p is not None and w and w > 0 and len(p) and len(p) % w == 0 else None


@F.pandas_udf(ArrayType(_BOUNDS))
def content_candidates(pixels: pd.Series, width: pd.Series) -> pd.Series:
    """:func:`candidates`; null where the array is no frame of that width."""
    return pd.Series([None if x is None else [dict(zip(_BOUNDS.names, c, strict=True)) for c in candidates(x)] for x in _images(pixels, width)], dtype=object)


@F.pandas_udf(StructType([*_BOX, StructField("transposed", BooleanType())]))
def padded_content(pixels: pd.Series, width: pd.Series, ratio: pd.Series) -> pd.DataFrame:
    """:func:`content`; nulls where there is none."""
    found = [None if x is None else content(x, None if pd.isna(r) else float(r)) for x, r in zip(_images(pixels, width), ratio, strict=True)]
    rows = [f or (None,) * 5 for f in found]
    out = pd.DataFrame(rows, columns=["left", "top", "width", "height", "transposed"])
    return out.astype({**dict.fromkeys(["left", "top", "width", "height"], "Int32"), "transposed": "boolean"})


def mean_grid(cells: int, samples: int = 8):
    """The pandas UDF of :func:`grid_means` for a number of cells."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def means(pixels: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else grid_means(x, cells, samples) for x in _images(pixels, width)], dtype=object)

    return means
