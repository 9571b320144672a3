"""The Hamming index, variants, stored collections, leaders, hop distances and neighbours by position against plain versions."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import hashes, pixels
from millrace.operators import duplicates, graph, hamming, variants
from millrace.operators.collection import Collection

ALL = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def some_hashes(rng, n, near=0.5, most=14):
    out = []
    for _ in range(n):
        if out and rng.random() < near:
            x = rng.choice(out)
            for k in rng.sample(range(64), rng.randrange(most)):
                x ^= 1 << k
        else:
            x = rng.getrandbits(64)
        out.append(x)
    return out


def distance(a, b):
    return ((a ^ b) & ALL).bit_count()


@pytest.mark.parametrize("radius", [0, 5, 11, 24])
def test_bands_find_all_pairs(spark, radius):
    """Every way of cutting that a plan may choose is complete and finds each pair once."""
    rng = random.Random(radius)
    h = some_hashes(rng, 90, most=2 * radius + 2)
    want = {(i, j, d) for i, j in itertools.combinations(range(len(h)), 2) if (d := distance(h[i], h[j])) <= radius}
    df = spark.createDataFrame([*((i, signed(x)) for i, x in enumerate(h)), (500, None)], "id int, bits long")
    got = [tuple(r) for r in hamming.item_pairs(df, "id", "bits", radius).collect()]
    assert set(got) == want and len(got) == len(want) > 0 or radius == 0
    for size in (10, 10**5, 10**9):
        bands = hamming.plan(radius, size)
        assert sum(b.width for b in bands) == 64 and sum(b.flips for b in bands) + len(bands) == radius + 1 and sum(b.values for b in bands) <= hamming.ASKED


def test_pairs_stay_within_groups(spark):
    rng = random.Random(4)
    h = some_hashes(rng, 80)
    rows = [(i, signed(x), rng.choice(["a", None, "c"])) for i, x in enumerate(h)]
    df = spark.createDataFrame(rows, "id int, bits long, g string")
    want = {(i, j) for i, j in itertools.combinations(range(80), 2) if rows[i][2] == rows[j][2] and distance(h[i], h[j]) <= 12}
    assert {(r["a"], r["b"]) for r in hamming.item_pairs(df, "id", "bits", 12, ("g",)).collect()} == want
    near, members = hamming.links(df, "id", "bits", 12, ("g",))
    first = {r["item"]: r["first"] for r in members.collect()}
    pairs = {(r["a"], r["b"]) for r in near.collect()}
    assert {(i, j) for i, j in want if first[i] != first[j]} == {(i, j) for i, j in itertools.combinations(range(80), 2) if tuple(sorted((first[i], first[j]))) in pairs}
    assert hamming.item_pairs(df.limit(0), "id", "bits", 12).count() == 0


def plain_leaders(rows, threshold):
    """Items in order: the first unused one leads all unused ones of its group within the threshold."""
    lead = {}
    for g, i, h in sorted(rows, key=lambda r: r[1]):
        if i in lead:
            continue
        lead[i] = i
        for g2, j, h2 in rows:
            if h is not None and h2 is not None and j not in lead and g == g2 and distance(h, h2) <= threshold:
                lead[j] = i
    return lead


def test_leaders_equal_the_serial_order(spark):
    rng = random.Random(9)
    h = some_hashes(rng, 400, near=0.7)
    h[50:60] = [h[49]] * 10
    chain = [0]
    for k in range(12):  # each near the next only
        chain.append(chain[-1] | 0b11111111 << 5 * k)
    rows = [(rng.choice("xy"), i, x) for i, x in enumerate(h)] + [("z", 1000 + i, x) for i, x in enumerate(chain)] + [("x", 2000, None)]
    df = spark.createDataFrame([(g, i, None if x is None else signed(x)) for g, i, x in rows], "g string, id int, bits long").repartition(6)
    got = {r["id"]: r["leader"] for r in duplicates.leaders(df, "id", "bits", ["g"], 8).collect()}
    assert got == plain_leaders(rows, 8) and len(set(got.values())) < 350


def test_many_leaders_of_one_label(spark):
    """10,000 items of one label are more than one task's work."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 2500, dtype=np.uint64)
    h = base[rng.integers(0, 2500, 10_000)]
    for _ in range(3):
        h = h ^ (np.uint64(1) << rng.integers(0, 64, 10_000, dtype=np.uint64))
    df = spark.createDataFrame([("one", i, x) for i, x in enumerate(h.view(np.int64).tolist())], "g string, id int, bits long").repartition(8)
    got = duplicates.leaders(df, "id", "bits", ["g"], 8).toPandas().set_index("id")["leader"].reindex(range(10_000)).to_numpy()
    lead = np.full(10_000, -1)
    for i in range(10_000):
        if lead[i] < 0:
            lead[(lead < 0) & (np.bitwise_count(h ^ h[i]) <= 8)] = i
    assert (got == lead).all() and 0 < len(set(lead.tolist())) < 5000


def test_hop_distances_and_closeness(spark):
    rng = random.Random(5)
    edges = {(a, b) for k in range(6) for a, b in ((rng.randrange(10 * k, 10 * k + 10), rng.randrange(10 * k, 10 * k + 10)) for _ in range(14))} | {(100 + k, 101 + k) for k in range(9)}
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for s in near:
        want[s, s], ring, k = 0, {s}, 0
        while ring:
            k += 1
            ring = {y for x in ring for y in near[x] if (s, y) not in want}
            want |= {(s, y): k for y in ring}
    df = spark.createDataFrame([*edges, *((b, a) for a, b in list(edges)[:9]), (7, None)], "a int, b int").repartition(4)
    got = graph.hop_distances(df, "a", "b").collect()
    assert {(r["source"], r["node"]): r["hops"] for r in got} == want and len(got) == len(want)
    weighed = spark.createDataFrame([(a, b, 1 / (1 + a + b)) for a, b in edges if a != b], "a int, b int, w double")
    nodes = duplicates.components(weighed)
    total, group = defaultdict(int), {r["node"]: r["component"] for r in nodes.collect()}
    for (s, _), k in want.items():
        total[s] += k
    one = {tuple(sorted((a, b))): 1 / (1 + a + b) for a, b in edges if a != b}
    weight = {n: sum(w for p, w in one.items() if n in p) for n in near}
    best = {c: min((n for n in near if group[n] == c), key=lambda n: (total[n], -len(near[n]), -weight[n], n)) for c in set(group.values())}
    assert {r["component"]: r["representative"] for r in duplicates.closeness_representatives(weighed, nodes, "w").collect()} == best
    assert graph.hop_distances(df.limit(0), "a", "b").count() == 0


@pytest.mark.parametrize("page", [3, 7, 8192])
def test_band_pairs_by_position(spark, monkeypatch, page):
    monkeypatch.setattr(duplicates, "PAGE", page)
    rng = random.Random(page)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([rng.uniform(0, 40), 5.0, -1.0, rng.randrange(9) * 1.0])) for i in range(160)] + [(900, "a", None)]
    df = spark.createDataFrame(rows, "k int, g string, v double").repartition(5)
    want = set()
    for g in ("a", "b", None):
        own = sorted((v, i) for i, h, v in rows if h == g and v is not None and v > 0)
        for at, (v, i) in enumerate(own):
            want |= {(g, i, j) for w, j in own[at + 1 : at + 4] if w - v <= max(0.35, 0.015 * v)}
    pairs = duplicates.band_pairs(df, "v", "k", ["g"], neighbours=3)
    if page > 3:
        assert {(r["g"], r["a"], r["b"]) for r in pairs.collect()} == want
    else:
        with pytest.raises(ValueError):
            duplicates.band_pairs(df, "v", "k", ["g"], neighbours=4)
        assert {(r["g"], r["a"], r["b"]) for r in pairs.collect()} == want


def test_turns_are_those_of_pictures(spark):
    grid = np.random.default_rng(0).normal(size=(8, 8)).round(3)
    df = spark.createDataFrame([(grid.ravel().tolist(),)], "g array<double>")
    got = df.select(*(hashes.turned(F.col("g"), 8, F.lit(k)).alias(f"t{k}") for k in range(8)), hashes.turned_bits(F.col("g"), 8).alias("h")).first()
    for k, t in enumerate(pixels.turned(grid)):
        assert got[f"t{k}"] == t.ravel().tolist()
        assert got["h"][k] == signed(int("".join("1" if x > 0 else "0" for x in t.ravel()), 2))


def test_variant_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 8, 8))
    grids = [*base, *(np.rot90(g, k % 4) + rng.normal(size=(8, 8)) * 0.04 for k, g in enumerate(base)), *(np.fliplr(np.rot90(g, k % 4)) + 0.02 for k, g in enumerate(base[:6]))]
    rows = [(k, [float(np.float32(x)) for x in g.ravel()], k) for k, g in enumerate(grids)] + [(90, None, 0), (91, [1.0], 0), (92, [float("nan")] * 64, 0)]
    df = spark.createDataFrame(rows, "id int, grid array<double>, a int")
    got = {(r["a"], r["b"]): r for r in variants.variant_pairs(df, "id", "grid", 8, 16, 0.75, 0.2).collect()}
    want = {(k, 12 + k) for k in range(12)} | {(k, 24 + k) for k in range(6)} | {(12 + k, 24 + k) for k in range(6)}
    assert set(got) == want and all(r["score"] < 1 and r["inliers"] > 55 for r in got.values())
    for (a, b), r in got.items():
        t = pixels.turned(np.array(rows[b][1]).reshape(8, 8))[r["turn"]].ravel()
        gap = np.abs(np.array(rows[a][1]) - t)
        assert r["inliers"] == (gap <= 0.2).sum() and abs(r["residual"] - gap[gap <= 0.2].mean() / 0.2) < 1e-9
    copies = df.unionByName(df.where("id < 24").withColumn("id", F.col("id") + 500))
    assert {(r["a"], r["b"]) for r in variants.variant_pairs(copies, "id", "grid", 8, 16, 0.75, 0.2).collect()} == want
    known = spark.createDataFrame([(12, 0)], "a int, b int")
    assert variants.variant_pairs(df, "id", "grid", 8, 16, 0.75, 0.2, known).count() == len(want) - 1
    heads, members = variants.one_of_each(df.where("id < 3").unionByName(df.where("id = 0").withColumn("id", F.lit(-5))), "id", F.col("grid"))
    assert {r["id"] for r in heads.collect()} == {-5, 1, 2} and {tuple(r) for r in members.collect()} == {(0, -5), (-5, -5), (1, 1), (2, 2)}


def test_a_collection_is_reused(spark, tmp_path):
    rng = random.Random(12)
    path = f"{tmp_path}/c"
    old = [(i, 3 * i, [signed(x) for x in some_hashes(rng, rng.randrange(4))], rng.randrange(4)) for i in range(120)]
    schema = "id bigint, place bigint, hashes array<bigint>, kind int"
    stored = Collection.create(spark, path, 10, 200)
    assert stored.first_matches(spark.createDataFrame(old[:3], schema), lambda p: F.lit(True)).count() == 0
    stored.add(spark.createDataFrame(old[:50], schema))
    stored.add(spark.createDataFrame([], schema))
    stored.add(spark.createDataFrame(old[50:90], schema))

    def batch(first, n):
        out = []
        for i in range(first, first + n):
            x = rng.choice([h for _, _, hs, _ in old for h in hs]) & ALL
            for k in rng.sample(range(64), rng.randrange(14)):
                x ^= 1 << k
            out.append((i, [signed(x), signed(rng.getrandbits(64))], rng.randrange(4)))
        return out

    def plain(new, among):
        want = {}
        for i, hs, kind in new:
            for j, place, xs, other in sorted(among, key=lambda r: r[1]):
                near = min((distance(h, x) for h in hs for x in xs), default=99)
                if near <= 10 and other >= kind:
                    want[i] = (j, place, near)
                    break
        return want

    found = lambda c, new: {r["id"]: (r["match_id"], r["match_place"], r["distance"]) for r in c.first_matches(spark.createDataFrame(new, "id bigint, hashes array<bigint>, kind int"), lambda p: F.col("stored.kind") >= p["kind"]).collect()}
    new = batch(1000, 60)
    want = plain(new, old[:90])
    assert found(stored, new) == want and len(want) > 15
    # another session's view of the folder, a further batch, and one that broke off before it was done
    for name in spark.catalog.listTables():
        if name.name.startswith("millrace_index_"):
            spark.sql(f"DROP TABLE {name.name}")
    again = Collection(spark, path)
    assert again.generations() == [0, 1, 2] and again.bands == stored.bands
    assert found(again, new) == want
    spark.createDataFrame(old[90:], schema).write.parquet(f"{path}/items/generation=3")
    assert found(again, new) == want
    assert again.add(spark.createDataFrame(old[90:], schema)) == 3
    more = batch(2000, 60)
    assert found(again, more) == plain(more, old)


def test_lookups_do_not_shuffle_the_index(spark, tmp_path):
    c = Collection.create(spark, f"{tmp_path}/c", 8, 10**6)
    rows = spark.range(2000).selectExpr("id", "id as place", "array(xxhash64(id)) as hashes")
    c.add(rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = c.near(rows.limit(100), 0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = next(line for line in plan.splitlines() if "Bucketed: true" in line)
    assert "key" in scan
    index_side = plan[plan.rindex("SortMergeJoin") if "SortMergeJoin" in plan else 0 :]
    below = index_side[: index_side.index("Bucketed: true")].splitlines()
    assert not any("Exchange hashpartitioning(band" in line and "16" not in line for line in below)


SAFE = [  # phash, inliers, coverages, residual, model, points, sizes, expected
    (1.0, 0, 0.0, 0.0, None, None, 200, 200, (100, 100), (100, 100), 1.0), (1.0, 0, 0.0, 0.0, None, None, 200, 200, (100, 100), (100, 200), 0.99), (1.0, 0, 0.0, 0.0, None, None, 10, 200, (100, 100), (100, 100), 0.98),
    (1.0, 30, 0.4, 0.4, 9.0, "homography", 10, 200, (100, 100), (100, 100), 0.99), (1.0, 40, 0.5, 0.5, 2.5, "homography", 10, 200, (1, 1), (9, 1), 1.0), (0.96, 40, 0.5, 0.5, 2.5, "affine", 10, 200, (1, 1), (9, 1), 0.99),
    (0.96, 30, 0.4, 0.4, 9.0, "affine", 10, 200, (1, 1), (9, 1), 0.98), (0.96, 30, 0.4, 0.4, 9.0, "none", 10, 200, (1, 1), (9, 1), 0.96), (0.8, 40, 0.5, 0.5, 2.0, "affine", 10, 200, (1, 1), (9, 1), 0.85), (0.94, 40, 0.5, 0.5, 2.0, "affine", 10, 200, (1, 1), (9, 1), 0.97),
    (0.9, 25, 0.35, 0.35, None, "affine", 10, 200, (1, 1), (9, 1), 0.92), (0.9, 24, 0.9, 0.9, 0.1, "affine", 10, 200, (1, 1), (9, 1), 0.9), (1.0, 0, 0.0, 0.0, None, None, 200, 200, (0, 0), (100, 100), 0.99), (1.0, 0, 0.0, 0.0, None, None, 200, 200, (400, 400), (100, 100), 1.0),
]


def test_safe_similarity(spark):
    rows = [(*r[:8], *r[8], *r[9], r[10]) for r in SAFE]
    df = spark.createDataFrame(rows, "p double, n int, ca double, cb double, r double, m string, pa int, pb int, wa int, ha int, wb int, hb int, want double")
    c = F.col
    got = df.withColumn("got", hashes.safe_similarity(c("p"), c("n"), c("ca"), c("cb"), c("r"), c("m"), c("pa"), c("pb"), c("wa"), c("ha"), c("wb"), c("hb")))
    assert [(r["got"]) for r in got.collect()] == pytest.approx([r["want"] for r in got.collect()])
