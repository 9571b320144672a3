"""Operators on small tables against plain Python."""

import random

from pyspark.sql import functions as F

from millrace.operators import duplicates, events, inventory
from millrace.operators.graph import connected_components
from millrace.streaming import events as streams


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5), (None, 1)]
    group = {}
    for a, b in edges:
        if a is not None and a != b:
            group.setdefault(a, a), group.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a in group and b in group and group[a] != group[b]:
                group[a] = group[b] = min(group[a], group[b])
                changed = True
    got = connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r["node"]: r["component"] for r in got} == group and len(got) == len(group)
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_roll_up(spark):
    rows = [(["a", "b"], 10), (["a"], 5), (["a", "c", "d"], 1), ([], 4)]
    got = {r["folder"]: (r["files"], r["bytes"]) for r in inventory.roll_up(spark.createDataFrame(rows, "folders array<string>, size long")).collect()}
    assert got == {"/": (4, 20), "/a": (3, 16), "/a/b": (1, 10), "/a/c": (1, 1), "/a/c/d": (1, 1)}


def test_head_and_tail(spark):
    df = spark.createDataFrame([("g", i) for i in range(1, 8)], "g string, i int")
    assert sorted(r["i"] for r in inventory.head_and_tail(df, 4, ["g"], F.col("i")).collect()) == [1, 2, 6, 7]
    assert sorted(r["i"] for r in inventory.head_and_tail(df, 3, ["g"], F.col("i")).collect()) == [1, 2, 7]


def test_band_pairs(spark):
    rng = random.Random(2)
    rows = [(i, "g", v) for i, v in enumerate([10.0, 10.3, 10.36, *(rng.uniform(0.1, 200) for _ in range(150))])]
    want = {(a[0], b[0]) for a in rows for b in rows if (b[2], b[0]) > (a[2], a[0]) and b[2] - a[2] <= max(0.35, 0.015 * a[2])}
    df = spark.createDataFrame(rows, "k int, g string, v double")
    assert {(r["a"], r["b"]) for r in duplicates.band_pairs(df, "v", "k", ["g"], neighbours=None).collect()} == want


def test_hamming_pairs_and_representatives(spark):
    rng = random.Random(3)
    rows = [(i, rng.getrandbits(64) - (1 << 63)) for i in range(40)]
    rows += [(100 + i, rows[i][1] ^ sum(1 << b for b in rng.sample(range(63), 4))) for i in range(20)]
    want = {(a, b, bin((x ^ y) & (1 << 64) - 1).count("1")) for a, x in rows for b, y in rows if a < b and bin((x ^ y) & (1 << 64) - 1).count("1") <= 6}
    got = duplicates.hamming_pairs(spark.createDataFrame(rows, "i int, h long"), "i", "h", 6)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    chain = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    nodes = duplicates.components(chain)
    assert duplicates.representatives(chain, nodes).first()["representative"] == "b"
    assert duplicates.closeness_representatives(chain, nodes).first()["representative"] == "b"


def test_edges_by_priority(spark):
    e = spark.createDataFrame([(1, 2)], "a int, b int")
    f = spark.createDataFrame([(2, 1), (2, 3)], "a int, b int")
    assert {tuple(r) for r in duplicates.merge_edges((f, "pixel", 2), (e, "exact", 3)).collect()} == {(1, 2, "exact"), (2, 3, "pixel")}


def test_confidence(spark):
    rows = [(1, "network"), (1, "media-type"), (1, "network"), (2, "probe-failed")]
    got = {r["k"]: r["confidence"] for r in events.confidence(spark.createDataFrame(rows, "k int, kind string"), "k", "kind").collect()}
    assert got == {1: 50, 2: 0}


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(1, f"2024-01-01 00:00:{s:02d}", "click") for s in (0, 2, 4, 30)] + [(2, "2024-01-01 00:00:01", "view"), (1, "2024-01-01 02:00:00", "click")]
    df = spark.createDataFrame(rows, "user int, at string, kind string").select("user", F.col("at").cast("timestamp").alias("ts"), "kind")
    df.write.parquet(src)
    runs = streams.debounced(streams.read_events(spark, src, df.schema), "user", "ts", "10 seconds", "1 minute")
    got = {(r["user"], r["events"]) for r in streams.run_once(runs, "runs", str(tmp_path / "c1")).collect()}
    assert {(1, 3), (1, 1), (2, 1)} == got
    unique = streams.once(streams.read_events(spark, src, df.schema), ["user", "kind"], "ts", "1 day")
    assert streams.run_once(unique, "uniq", str(tmp_path / "c2")).count() == 2
    state = streams.flags(streams.read_events(spark, src, df.schema), "user", "kind")
    assert {(r["key"], r["segments"], r["notify"]) for r in streams.run_once(state, "flags", str(tmp_path / "c3"), "update").collect()} == {(1, 5, True), (2, 1, True)}
    seen = []
    streams.on_change(spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "k string, digest string"), spark.createDataFrame([("a", "1"), ("b", "9")], "k string, digest string"), "k", lambda keys: seen.extend(r["k"] for r in keys.collect()))
    assert sorted(seen) == ["b", "c"]
