"""Variants of pictures: pairs whose turned or mirrored hashes are near, verified on what the pictures show."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import hashes
from millrace.operators.hamming import Carried, array_pairs

#: Pairs of pictures that are matched at a time.
SLICE = 1 << 12


def one_of_each(items: DataFrame, item: str, identity: Column) -> tuple[DataFrame, DataFrame]:
    """(the first item of each identity with its columns, (item, first)): exact copies need no comparison of their own."""
    keyed = items.withColumn("_identity", identity)
    first = keyed.groupBy("_identity").agg(F.min(item).alias("first"))
    members = keyed.select(item, "_identity").join(first, "_identity").select(item, "first")
    heads = members.where(F.col(item) == F.col("first")).select(item).distinct()
    return items.join(heads, item, "left_semi"), members


def _matches(side: int, tolerance: float) -> Callable:
    """:func:`hashes.grid_match` of many pairs at once, b turned as said; sums run in the order of places, as they do there."""
    turns = np.array(hashes.turns(side))

    def measure(left: pa.ListArray, right: pa.ListArray) -> Callable:
        ga, gb = (pc.list_flatten(g).to_numpy().astype(np.float64).reshape(-1, side * side) for g in (left, right))

        def columns(x: np.ndarray, y: np.ndarray, distance: np.ndarray, turn: np.ndarray) -> list[pa.Array]:
            n, residual, covered = np.zeros(len(x), np.int32), np.zeros(len(x)), np.zeros((2, len(x)))
            for at in range(0, len(x), SLICE):
                here = slice(at, at + SLICE)
                a, b = ga[x[here]], np.take_along_axis(gb[y[here]], turns[turn[here]], axis=1)
                gap = np.abs(a - b)
                inside = gap <= tolerance
                n[here] = inside.sum(1)
                residual[here] = np.cumsum(np.where(inside, gap, 0.0), axis=1)[:, -1] / (np.maximum(n[here], 1) * tolerance)
                for k, g in enumerate((a > 0, b > 0)):
                    covered[k, here] = (g & inside).sum(1) / np.maximum(g.sum(1), 1)
            return [pa.array(n), *map(pa.array, covered), pa.array(residual, mask=n == 0)]

        return columns

    return measure


def variant_pairs(items: DataFrame, item: str, grid: str, side: int, radius: int, threshold: float, tolerance: float, known: DataFrame | None = None) -> DataFrame:
    """(a, b, distance, turn, inliers, coverage_a, coverage_b, residual, score) of variant pairs of square pictures, each a
    row-major array ``grid`` of ``side`` x ``side`` values.

    Candidates are pairs whose hashes come within the radius in any of the eight turns (:func:`hamming.array_pairs`); pairs
    (a, b) of ``known`` are skipped. A candidate is verified with b turned as the nearest hash says (:func:`hashes.grid_match`; of many candidates in the task that compares the hashes, so that no pair moves with
    its pictures): its matches must confirm the geometry, and the composite score must
    reach the threshold and stay below 1. Equal pictures are one: the first item stands for its copies
    (:func:`one_of_each` names them). Pictures of another size or with nulls take no part.
    """
    whole = items.where((F.size(grid) == side * side) & ~F.exists(grid, lambda x: x.isNull() | F.isnan(x)))
    one = whole.groupBy(F.col(grid).alias("grid")).agg(F.min(item).alias("id"))
    rows = one.select("id", "grid").withColumn("turns", hashes.turned_bits(F.col("grid"), side))
    rows = rows.withColumn("plain", F.slice("turns", 1, 1))
    measured = Carried("grid", _matches(side, tolerance), "inliers int, coverage_a double, coverage_b double, residual double")
    near = array_pairs(rows, "id", "plain", "turns", radius, measured)
    if known is not None:
        near = near.join(known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    if "inliers" not in near.columns:  # few candidates, found by an index
        end = lambda i, v: rows.select(F.col("id").alias(i), F.col("grid").alias(v))
        match = hashes.grid_match(F.col("ga"), hashes.turned(F.col("gb"), side, F.col("turn")), tolerance)
        near = near.join(end("a", "ga"), "a").join(end("b", "gb"), "b").select("a", "b", "distance", "turn", match.alias("m")).select("a", "b", "distance", "turn", "m.*")
    m = {c: F.col(c) for c in ("inliers", "coverage_a", "coverage_b", "residual")}
    score = hashes.composite_score(F.lit("geometry"), F.lit("grid"), hashes.similarity(F.col("distance"), side * side), m["coverage_a"], m["coverage_b"], m["inliers"], m["residual"])
    confirmed = hashes.geometry_confirmed(F.lit("grid"), m["inliers"], m["coverage_a"], m["coverage_b"], m["residual"])
    found = near.where(confirmed).withColumn("score", score).where((F.col("score") >= threshold) & (F.col("score") < 1))
    return found.select("a", "b", "distance", "turn", *m, "score")
