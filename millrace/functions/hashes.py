"""Perceptual hashes as signed 64-bit longs or hex strings: distances, similarity scores and labels."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

VARIANT = {"min_inliers": 25, "coverage": 0.5, "reprojection_px": 3.0}


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming_128(a_high: Column, a_low: Column, b_high: Column, b_low: Column) -> Column:
    return hamming(a_high, b_high) + hamming(a_low, b_low)


def from_hex(text: Column) -> Column:
    """16 hex digits as a signed long, else null."""
    return F.when(text.rlike("^[0-9a-fA-F]{16}$"), F.conv(text, 16, -10).cast("bigint"))


def hamming_hex(a: Column, b: Column, malformed: int | None = 64) -> Column:
    """Distance of two hex hashes; ``malformed`` (null for infinitely far) where either is missing or no hash."""
    d = hamming(from_hex(a), from_hex(b))
    return d if malformed is None else F.coalesce(d, F.lit(malformed))


def best_distance(a: Column, b: Column) -> Column:
    """Least distance between any of the hashes in one array and any in the other, at most 64."""
    each = F.transform(a, lambda x: F.array_min(F.transform(b, lambda y: F.bit_count(x.bitwiseXOR(y)))))
    return F.least(F.lit(64), F.coalesce(F.array_min(each), F.lit(64)))


def similarity(distance: Column, bits: int = 64) -> Column:
    return 1 - distance / bits


def radius(threshold: float, bits: int = 64) -> int:
    """The largest distance whose similarity meets the threshold."""
    if not 0 <= threshold <= 1 or bits <= 0:
        raise ValueError("threshold must be in 0..1 and bits positive")
    return max(0, min(bits, math.floor((1 - threshold) * bits + 1e-12)))


def composite_score(verification: Column, model: Column, phash: Column, coverage_a: Column, coverage_b: Column, inliers: Column, residual: Column, min_inliers: int = 25, reprojection: float = 3.0) -> Column:
    """1 for identity; 0 for what geometry did not verify or is not finite; else a weighted score below 1."""
    finite = F.lit(True)
    for c in (phash, coverage_a, coverage_b, residual):
        finite = finite & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    score = 0.50 * unit(phash) + 0.25 * F.least(F.greatest(coverage_a, F.lit(0.0)), F.greatest(coverage_b, F.lit(0.0)), F.lit(1.0)) + 0.15 * F.least(F.lit(1.0), inliers / (2 * min_inliers)) + 0.10 * F.greatest(F.lit(0.0), 1 - residual / reprojection)
    geometric = (verification == "geometry") & ~model.isin("none", "phash_only", "identity")
    return F.when(verification.isin("byte_exact", "pixel_exact"), 1.0).when(geometric & finite, F.least(F.lit(0.99), F.greatest(F.lit(0.0), score))).otherwise(0.0)


def pair_label(verification: Column, model: Column, phash: Column, inliers: Column, coverage_a: Column, coverage_b: Column, residual: Column, points_a: Column, points_b: Column, threshold: float = 0.75, low_threshold: float = 0.85, low_points: int = 80, variant: dict = VARIANT) -> Column:
    """duplicate, variant or different; texts of few key points need the higher threshold."""
    need = F.when((points_a < low_points) | (points_b < low_points), low_threshold).otherwise(threshold)
    fits = (phash >= need) & (inliers >= variant["min_inliers"]) & (coverage_a >= variant["coverage"]) & (coverage_b >= variant["coverage"]) & (residual <= variant["reprojection_px"])
    geometric = (verification == "geometry") & ~model.isin("none", "phash_only", "identity")
    return F.when(verification.isin("byte_exact", "pixel_exact"), "duplicate").when(geometric & fits, "variant").otherwise("different")


def sign_bits(values: Column, bits: int = 64) -> Column:
    """The first ``bits`` numbers of an array as a bit mask, the first highest: 1 where a number is above 0."""
    return F.aggregate(F.slice(values, 1, bits), F.lit(0).cast("bigint"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x > 0, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))))


def mean_bits(values: Column) -> Column:
    """Average hash: a bit for each number that is above the array's mean."""
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)
    return sign_bits(F.transform(values, lambda x: x - mean))


def turns(side: int) -> list[list[int]]:
    """Places of a row-major square after each of its eight turns: the square and its mirror image, each in four quarter
    turns against the clock."""
    out = []
    for mirror in (False, True):
        square = [[r * side + (side - 1 - c if mirror else c) for c in range(side)] for r in range(side)]
        for _ in range(4):
            out.append([x for row in square for x in row])
            square = [list(column) for column in zip(*square, strict=True)][::-1]
    return out


def turned(values: Column, side: int, turn: Column) -> Column:
    """The values of a square in one of its eight turns."""
    table = F.array(*(F.array(*map(F.lit, t)) for t in turns(side)))
    return F.transform(F.get(table, turn), lambda i: F.get(values, i))


def turned_bits(values: Column, side: int) -> Column:
    """:func:`sign_bits` of a square of up to 64 values in each of its eight turns."""
    return F.transform(F.array(*(F.array(*map(F.lit, t)) for t in turns(side))), lambda t: sign_bits(F.transform(t, lambda i: F.get(values, i)), side * side))


def grid_match(a: Column, b: Column, tolerance: float) -> Column:
    """How two equally large arrays agree: inliers (places within the tolerance), the share of each one's positive places that
    are inliers, and the mean difference of inliers in tolerances (null without any)."""
    cells = F.arrays_zip(a.alias("a"), b.alias("b"))
    gap = lambda c: F.abs(c["a"].cast("double") - c["b"].cast("double"))
    inside = F.filter(cells, lambda c: gap(c) <= tolerance)
    n = F.size(inside)
    share = lambda side: F.coalesce(F.try_divide(F.size(F.filter(inside, lambda c: c[side] > 0)).cast("double"), F.size(F.filter(cells, lambda c: c[side] > 0))), F.lit(0.0))
    total = F.aggregate(inside, F.lit(0.0), lambda s, c: s + gap(c))
    return F.struct(n.alias("inliers"), share("a").alias("coverage_a"), share("b").alias("coverage_b"), F.try_divide(total, n * F.lit(tolerance)).alias("residual"))


def geometry_confirmed(model: Column, inliers: Column, coverage_a: Column, coverage_b: Column, residual: Column, variant: dict = VARIANT) -> Column:
    """Whether a geometric match is good enough for a variant."""
    enough = (inliers >= variant["min_inliers"]) & (coverage_a >= variant["coverage"]) & (coverage_b >= variant["coverage"]) & (residual <= variant["reprojection_px"])
    return F.coalesce(~model.isin("none", "phash_only") & enough, F.lit(False))


#: What geometry must show to be confirmed and to be strong; key points below which a picture has little
#: texture; how far aspect ratios and numbers of pixels may lie apart.
CONFIRMED, STRONG = {"inliers": 25, "coverage": 0.35}, {"inliers": 40, "coverage": 0.50, "residual": 2.5}
TEXTURE, ASPECT, SCALE = 120, 0.15, 16.0


def safe_similarity(phash: Column, inliers: Column, coverage_a: Column, coverage_b: Column, residual: Column, model: Column, points_a: Column, points_b: Column, width_a: Column, height_a: Column, width_b: Column, height_b: Column) -> Column:
    """A similarity that is safe to delete by: the hash's, raised where geometry confirms it and held below 1 where neither
    geometry nor texture and size do. Unknown sizes count as 0."""
    wa, ha, wb, hb = (F.coalesce(c.cast("double"), F.lit(0.0)) for c in (width_a, height_a, width_b, height_b))
    aspect = lambda w, h: F.when(h > 0, w / F.nullif(h, F.lit(0.0))).otherwise(1.0)
    low, pa, pb = (points_a < TEXTURE) | (points_b < TEXTURE), wa * ha, wb * hb
    plausible = (pa > 0) & (pb > 0) & (F.greatest(pa, pb) <= SCALE * F.least(pa, pb))
    agree = (F.abs(aspect(wa, ha) - aspect(wb, hb)) <= ASPECT) & plausible
    has = F.coalesce(~model.isin("none", "phash_only"), F.lit(False))
    at_least = lambda t: (inliers >= t["inliers"]) & (coverage_a >= t["coverage"]) & (coverage_b >= t["coverage"])
    confirmed = F.coalesce(has & at_least(CONFIRMED), F.lit(False))
    strong = confirmed & F.coalesce(at_least(STRONG) & (residual <= STRONG["residual"]), F.lit(False))
    top = F.when(strong, 1.0).when(~low & agree, 1.0).when(~low, 0.99).when(confirmed, 0.99).otherwise(0.98)
    high = F.when(strong, 0.99).when(confirmed, 0.98).otherwise(phash)
    rest = F.when(strong, F.least(phash + 0.05, F.lit(0.97))).when(confirmed, F.least(phash + 0.02, F.lit(0.95))).otherwise(phash)
    return F.when(phash >= 0.99, top).when(phash >= 0.95, high).otherwise(rest)


def match_verdict(score: Column) -> Column:
    """exact_dupe from 0.98 on, quality_dupe from 0.75, else null."""
    return F.when(score >= 0.98, "exact_dupe").when(score >= 0.75, "quality_dupe")


def cluster_id(session: Column, *members: Column) -> Column:
    """24 hex digits of a SHA-256 over a session and a cluster's members, a line each."""
    return F.substring(F.sha2(F.concat_ws("\n", session, *(m.cast("string") for m in members)), 256), 1, 24)
