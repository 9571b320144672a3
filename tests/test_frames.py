"""Content of frames against plain loops over their pixels."""

import math

import numpy as np
import pytest
from millrace.functions import frames


def plain_extent(flags):
    first = flags[:3]
    if not flags or sum(first) < max(1, math.ceil(len(first) * 0.67)):
        return 0
    reach = missing = 0
    for k, f in enumerate(flags):
        reach, missing = (k + 1, 0) if f else (reach, missing + 1)
        if missing == 3:
            break
    return reach


def plain_boundary(image):
    """Every size and place one by one, means by slices."""
    height, width = image.shape
    rows = range(0, height, max(1, height // 120))
    profile = [sum(abs(float(image[r, c]) - float(image[r, c - 1])) for r in rows) / len(rows) for c in range(1, width)]
    if len(profile) < 16:
        return None
    ranked, best = sorted(profile), None
    middle, p80 = ranked[len(ranked) // 2], ranked[int((len(ranked) - 1) * 0.8)]
    mean = lambda a, b: sum(profile[a:b]) / (b - a) if b > a else 0.0
    margin = max(4, int(width * 0.04))
    for size in range(max(12, int(width * 0.2)), min(int(height / 1.05), int(width * 0.68)) + 1):
        for share in frames.OFFSETS:
            s = (width - size) // 2 + round(share * width)
            e = s + size
            if s < margin or width - e < margin:
                continue
            one, two = sorted((profile[s - 1], profile[e - 1]))
            around = [mean(0, max(1, s - 1)), mean(min(len(profile), e + 1), len(profile))]
            detail = (mean(s + 1, max(s + 2, e - 1)) + 1) / (sum(around) / 2 + 1)
            if one < max(8.0, p80 * 1.7, middle * 2.4) or one / max(two, 0.001) < 0.55 or detail < 1.2 or (min(around) + 1) / (max(around) + 1) < 0.42:
                continue
            sure = min(0.995, 0.9 + min(0.055, max(0.0, one / max(p80, 1.0) - 1.7) * 0.035) + min(0.04, max(0.0, detail - 1.2) * 0.05))
            if sure >= 0.94 and (best is None or sure > best[2] + 1e-12):
                best = (s, e, sure)
    return best


def embedded(rng, height, width, start, end, hard):
    image = 100 + rng.normal(0, 1, (height, width)) + np.linspace(0, 3, width)[None, :]
    image[:, start:end] = rng.normal(100 + hard, 9, (height, end - start))
    return image.clip(0, 255)


def test_extents():
    rng = np.random.default_rng(1)
    for n in range(12):
        for _ in range(200):
            flags = rng.random(n) < rng.choice([0.3, 0.7, 0.9])
            assert frames.extent(flags) == plain_extent(flags.tolist())


def test_boundaries():
    rng = np.random.default_rng(2)
    found = 0
    for k in range(60):
        height, width = rng.integers(40, 90), rng.integers(60, 130)
        size = int(rng.integers(int(width * 0.2), int(width * 0.68)))
        start = (width - size) // 2 + int(rng.choice(frames.OFFSETS) * width)
        image = embedded(rng, height, width, max(5, start), min(width - 5, start + size), rng.choice([0, 30, 80, 120])) if k % 4 else rng.integers(0, 255, (height, width)).astype(float)
        got, want = frames.boundary(image), plain_boundary(image)
        assert (got is None) == (want is None)
        if got:
            assert got[2] == pytest.approx(want[2]) and got[:2] == want[:2]
            found += 1
    assert 10 < found < 50 and frames.boundary(np.zeros((30, 10))) is None


def test_bars_and_padding():
    rng = np.random.default_rng(3)
    image = rng.integers(0, 255, (64, 64)).astype(float)
    image[:10] = image[-9:] = 16
    assert frames.bars(image) == (10, 9) and frames.bars(image.T) == (0, 0)
    assert [c for c in frames.candidates(image) if c[-1] == "uniform"] == [(0, 10, 64, 45, 0.965, "uniform")]
    assert [c for c in frames.candidates(image.T) if c[-1] == "uniform"] == [(10, 0, 45, 64, 0.965, "uniform")]
    lopsided = image.copy()
    lopsided[-9:] = rng.integers(0, 255, (9, 64))
    lopsided[-3:] = 16
    assert frames.bars(lopsided) == (0, 0)
    bright = image.copy()
    bright[-9:] = 60
    assert frames.bars(bright) == (0, 0)
    square = rng.integers(0, 255, (64, 64)).astype(float)
    square[:14] = square[50:] = 5
    assert frames.content(square, 64 / 36) == (0, 14, 64, 36, False)
    assert frames.content(square.T, 64 / 36) == (14, 0, 36, 64, True) and frames.content(square, 36 / 64) == (0, 14, 64, 36, True)
    assert frames.content(square, 1.0) == (0, 0, 64, 64, False)
    assert frames.content(rng.integers(0, 255, (64, 64)).astype(float), 2.0) is None and frames.content(square, None) is None and frames.content(square[:10], 2.0) is None


@pytest.mark.parametrize(("height", "width", "cells"), [(9, 9, 9), (5, 7, 9), (100, 70, 4), (200, 333, 9), (1, 1, 3)])
def test_grid_means(height, width, cells):
    image = np.random.default_rng(4).integers(0, 255, (height, width)).astype(float)

    def picked(n, k):
        a, b = k * n // cells, max(k * n // cells + 1, (k + 1) * n // cells)
        return list(range(a, b)) if b - a <= 8 else [a + i * (b - a) // 8 for i in range(8)]

    want = [np.mean([image[r, c] for r in picked(height, i) for c in picked(width, j)]) for i in range(cells) for j in range(cells)]
    assert np.allclose(frames.grid_means(image, cells), want)


def test_frames_as_columns(spark):
    rng = np.random.default_rng(5)
    image = embedded(rng, 60, 100, 30, 70, 80)
    rows = [(1, image.ravel().tolist(), 100, 1.5), (2, None, 10, 1.0), (3, [1.0, 2.0, 3.0], 2, None), (4, [], 4, 2.0), (5, [7.0] * 64, 8, 2.0), (6, [7.0] * 64, 8, None)]
    df = spark.createDataFrame(rows, "k int, p array<double>, w int, ratio double").repartition(3)
    got = {r["k"]: r for r in df.select("k", frames.content_candidates("p", "w").alias("c"), frames.padded_content("p", "w", "ratio").alias("x"), frames.mean_grid(2)("p", "w").alias("m")).collect()}
    assert [tuple(c) for c in got[1]["c"]] == [pytest.approx(c) if not isinstance(c, str) else c for c in frames.candidates(image)] and got[1]["c"][-1]["method"] == "boundary"
    assert all(got[k]["c"] is None and got[k]["m"] is None for k in (2, 3, 4)) and got[5]["c"] == [] and got[5]["m"] == [7.0] * 4
    assert tuple(got[5]["x"]) == (0, 2, 8, 4, False) and tuple(got[6]["x"]) == tuple(got[2]["x"]) == (None,) * 5
    assert df.limit(0).select(frames.content_candidates("p", "w")).count() == 0
