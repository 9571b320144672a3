"""Functions on small tables against the rows they must give, and the operators that keep groups out of single tasks against plain versions."""

import random
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import pixels
from millrace.operators import duplicates, inventory, reports, tree
from millrace.operators.order import exact_median, with_before
from millrace.sources.tables import list_files
from tests.cases import CASES



@pytest.mark.parametrize("part", range(4))
def test_cases(spark, part):
    near = lambda rows: Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)
    for name in sorted(CASES)[part::4]:
        schema, rows, make, columns, want = CASES[name]
        made = make(spark.createDataFrame(rows, schema))
        assert near(made.select(*(F.col(c).cast(t).alias(c) for c, t in columns)).collect()) == near(want), name


def test_positions_and_medians(spark):
    rng = random.Random(1)
    rows = [(g, float(rng.randrange(30))) for g in "abc" for _ in range(rng.choice([1, 40, 41]))] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: (r["median"], r["n"]) for r in exact_median(df, "g", "v").collect()}
    assert got == {g: (statistics.median(x), len(x)) for g in "abc" for x in [[v for k, v in rows if k == g and v is not None]]}
    keyed = spark.createDataFrame([(k, k % 3 + 1) for k in range(50)], "k int, n int")
    before = {r["k"]: r["before"] for r in with_before(keyed, ["k"], "n").collect()}
    assert before == {k: sum(j % 3 + 1 for j in range(k)) for k in range(50)}
    assert exact_median(df.limit(0), "g", "v").count() == 0


@pytest.mark.parametrize("radius", [3, 16])
def test_hamming_pairs(spark, radius):
    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 62), 1 << 62, 40)
    bits = [int(b) for b in np.concatenate([base, base[:10], base[:20] ^ (1 << rng.integers(0, 60, 20))])]
    want = {(i, j, d) for i in range(len(bits)) for j in range(i + 1, len(bits)) if (d := ((bits[i] ^ bits[j]) & (1 << 64) - 1).bit_count()) <= radius}
    df = spark.createDataFrame([*enumerate(bits), (99, None)], "id int, bits long")
    assert {tuple(r) for r in duplicates.hamming_pairs(df, "id", "bits", radius).collect()} == want


def test_samples_and_digests(spark):
    rows = [(k % 3, k) for k in range(40) if k % 3 or k < 12]
    df = spark.createDataFrame(rows, "g int, k int")
    got = {(r["g"], r["k"]) for r in inventory.head_and_tail(df, 7, ["g"], "k").collect()}
    assert got == {(g, k) for g in range(3) for ks in [sorted(k for h, k in rows if h == g)] for k in (ks if len(ks) <= 7 else ks[:4] + ks[-3:])}
    one = inventory.snapshot_digest(df, ["g"], "k").collect()
    other = inventory.snapshot_digest(df.orderBy("k", ascending=False).repartition(7), ["g"], "k").collect()
    assert {tuple(r) for r in one} == {tuple(r) for r in other}
    assert inventory.snapshot_digest(df.where("k <> 4"), ["g"], "k").where("g = 1").first() != next(r for r in one if r["g"] == 1)


def test_pruning_order_over_partitions(spark):
    rng = random.Random(5)
    rows = [([rng.choice(["vendor", "src", "a", "b"]) for _ in range(rng.randint(1, 4))] + [f"n{k}"], rng.randint(1, 30)) for k in range(200)]
    df = spark.createDataFrame(rows, "path array<string>, lines int").repartition(6)
    out = tree.pruned(df, "path", "lines", 700).collect()
    order = sorted(out, key=lambda r: (r["tier"], -r["lines"], -len(r["path"]), "/".join(r["path"]).lower()))
    saved, want = 0, {}
    for r in order:
        want[tuple(r["path"])] = saved < 700
        saved += r["lines"]
    assert {tuple(r["path"]): r["cut"] for r in out} == want


def test_pixels(spark):
    rng = np.random.default_rng(7)
    image = rng.integers(0, 255, (20, 34)).astype(float)
    whole = pixels.area_resize(np.kron(image, np.ones((3, 2))), 20, 34)
    assert np.allclose(whole, image)
    assert pixels.phash(image) == pixels.phash(np.kron(image, np.ones((2, 2)))) and pixels.dhash(image) == pixels.dhash(image * 0.5)
    assert sorted(map(pixels.phash, pixels.turned(image))) == sorted(map(pixels.phash, pixels.turned(np.rot90(np.fliplr(image)))))
    df = spark.createDataFrame([(image.ravel().tolist(), 34), ([1.0, 2.0, 3.0], 2), (None, 4), ([], 1)], "p array<double>, w int")
    rows = df.select(pixels.phash64("p", "w").alias("h"), pixels.dhash_hex("p", "w").alias("d"), pixels.transform_hashes("p", "w").alias("t"), pixels.content_signature("p", "w").alias("s")).collect()
    assert (rows[0]["h"], rows[0]["d"]) == (pixels.phash(image), pixels.dhash(image)) and len(rows[0]["t"]) == 8 and len(rows[0]["s"]) == 64
    assert all(tuple(r) == (None,) * 4 for r in rows[1:])


def test_publish_only_over_unchanged_input(spark, tmp_path):
    listing, other = spark.createDataFrame([("a", 1)], "p string, s int"), spark.createDataFrame([("a", 2)], "p string, s int")
    target = str(tmp_path / "it's out")
    assert reports.publish(listing, target, listing, listing) and spark.read.parquet(target).count() == 1
    assert not reports.publish(listing.unionAll(other), target, listing, other) and spark.read.parquet(target).count() == 1
    assert list_files(spark, target).count() > 0
