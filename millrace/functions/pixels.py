"""Hashes over pixels: brightness of an image as a row-major array with its width. NumPy in Arrow batches; no decoder."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean brightness over the part of the image that each target pixel covers, partly covered pixels by their share."""

    def weights(n: int, m: int) -> np.ndarray:
        edges = np.linspace(0, n, m + 1)
        lo, hi = edges[:-1, None], edges[1:, None]
        cover = np.minimum(hi, np.arange(1, n + 1)) - np.maximum(lo, np.arange(n))
        return np.clip(cover, 0, None) * (m / n)

    return weights(image.shape[0], height) @ image @ weights(image.shape[1], width).T


def squared(image: np.ndarray) -> np.ndarray:
    """Padded to a square by mirroring at both edges of the shorter side; very long images are mirrored repeatedly."""
    h, w = image.shape
    gap = abs(h - w)
    pad = (gap // 2, gap - gap // 2)
    return np.pad(image, (pad, (0, 0)) if h < w else ((0, 0), pad), mode="symmetric")


_DCT = np.cos(np.pi * (2 * np.arange(32)[None, :] + 1) * np.arange(8)[:, None] / 64) * np.where(np.arange(8)[:, None] == 0, np.sqrt(1 / 32), np.sqrt(2 / 32))


def phash(image: np.ndarray) -> int:
    """64 bits, the first highest: which of the 8 x 8 lowest frequencies of the image at 32 x 32 exceed the median of all
    but the constant one."""
    block = (_DCT @ area_resize(squared(image), 32, 32) @ _DCT.T).round(6).ravel()
    return int(np.packbits(block > np.median(block[1:])).view(">u8")[0].astype(np.int64))


def dhash(image: np.ndarray) -> str:
    """16 hex digits: whether each of 9 x 8 cells is darker than its right neighbour; the image keeps its shape within a
    square on black."""
    h, w = image.shape
    side = max(h, w)
    box = np.zeros((side, side))
    box[(side - h) // 2 : (side - h) // 2 + h, (side - w) // 2 : (side - w) // 2 + w] = image
    cells = area_resize(box, 8, 9).round(6)
    return np.packbits((cells[:, :-1] < cells[:, 1:]).ravel()).tobytes().hex()


def turned(image: np.ndarray) -> list[np.ndarray]:
    """The image and its mirror image, each in four quarter turns."""
    return [np.rot90(x, k) for x in (image, np.fliplr(image)) for k in range(4)]


def _each(pixels: pd.Series, width: pd.Series):
    for p, w in zip(pixels, width, strict=True):
        whole = p is not None and w is not None and w > 0 and len(p) > 0 and len(p) % w == 0
        yield np.asarray(p, float).reshape(-1, int(w)) if whole else None


@F.pandas_udf(LongType())
def phash64(pixels: pd.Series, width: pd.Series) -> pd.Series:
    """:func:`phash`; null where the array is no image of that width."""
    return pd.Series([None if x is None else phash(x) for x in _each(pixels, width)], dtype="Int64")


@F.pandas_udf(ArrayType(LongType()))
def transform_hashes(pixels: pd.Series, width: pd.Series) -> pd.Series:
    """:func:`phash` of the eight turned and mirrored forms, in a fixed order."""
    return pd.Series([None if x is None else [phash(t) for t in turned(x)] for x in _each(pixels, width)])


@F.pandas_udf(StringType())
def dhash_hex(pixels: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else dhash(x) for x in _each(pixels, width)])


@F.pandas_udf(StringType())
def content_signature(pixels: pd.Series, width: pd.Series) -> pd.Series:
    """SHA-256 over the size and the brightness values: equal for equal pixels however a file stores them."""
    return pd.Series([None if x is None else hashlib.sha256(f"{x.shape[1]}x{x.shape[0]}|".encode() + x.astype("<f8").tobytes()).hexdigest() for x in _each(pixels, width)])
