"""Queries against their SQL on small tables that hold what only large ones hold, and what keeps their work in bounds."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import hashes, messages
from millrace.operators import duplicates, graph, hamming, sets
from millrace.plans import catalogue, derived
from tests.test_catalogue import rows


@pytest.fixture
def equal_to_sql(spark, tmp_path):
    def check(name, **tables):
        con = duckdb.connect()
        for table, df in tables.items():
            df.write.parquet(f"{tmp_path}/{table}.parquet")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        got, want = catalogue.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(catalogue.ORACLE_SQL[name]).df()
        assert rows(got) == rows(want)
        return got

    check.folder = tmp_path
    return check


def test_media_texts_of_large_keys(spark, equal_to_sql):
    """Sizes from 1 GB on, which keys reach at 60 times sf0.1."""
    assert derived.query is catalogue.query
    ids = spark.range(400).select((F.col("id") * 3001).alias("p"), (F.col("id") % 7 + 1).alias("n"), (F.col("id") % 50 + 1).alias("q"))
    found = equal_to_sql("media_texts", lineitem=ids.select(F.col("p").alias("l_orderkey"), F.col("n").cast("int").alias("l_linenumber"), F.col("p").alias("l_partkey"), F.col("n").alias("l_suppkey"), F.col("q").cast("double").alias("l_quantity")))
    assert found["bytes"].str.endswith(" MB").sum() > 100 and found["bytes"].str.len().max() == len("2861.0 MB")


def test_a_message_is_parsed_once(spark):
    text = F.concat(F.lit('{"evidence": "x", "url": "u", "pageTitle": "'), F.repeat(F.lit("t"), F.col("id").cast("int")), F.lit('"}'))
    df = spark.range(600).select(messages.bridge_message(text).alias("m")).select("m.*")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("pageTitle\": \"") == 1
    assert sorted(len(r["page_title"]) for r in df.collect()) == [min(k, 512) for k in range(600)]
    empty = spark.createDataFrame([(None,), ("[1",), ("7",)], "t string").select(messages.bridge_message(F.col("t")).alias("m"))
    assert [r["m"] for r in empty.collect()] == [None] * 3


def bits_of(n, seed):
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64)


@pytest.mark.parametrize("page", [7, 64])
def test_pairs_by_pages(spark, monkeypatch, page):
    """At a large radius pages of hashes are compared: groups of many pages, many groups in a page, copies."""
    monkeypatch.setattr(hamming, "PAGE", page)
    h, g = bits_of(200, 3), [k * k % 400 // 60 if k % 3 else None for k in range(200)]
    h[150:160] = h[10]
    df = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(zip(h.view(np.int64).tolist(), g, strict=True))], "id long, bits long, g int").repartition(5)
    assert hamming.dense(hamming.plan(24, 200)) and not hamming.dense(hamming.plan(3, 200))
    far = lambda i, j: int(np.bitwise_count(h[i] ^ h[j]))
    want = {(i, j, far(i, j)) for j in range(200) for i in range(j) if far(i, j) <= 24}
    got = [tuple(r) for r in hamming.item_pairs(df, "id", "bits", 24).collect()]
    assert set(got) == want and len(got) == len(want) > 400
    own = [tuple(r) for r in hamming.item_pairs(df, "id", "bits", 24, ("g",)).collect()]
    assert set(own) == {(i, j, d) for i, j, d in want if g[i] == g[j]} and len(own) == len(set(own)) > 60
    near, _ = hamming.links(df, "id", "bits", 24)
    first = {int(x): k for k, x in reversed(list(enumerate(h)))}
    assert {tuple(r) for r in near.collect()} == {(i, j, d) for i, j, d in want if d and i == first[int(h[i])] and j == first[int(h[j])]}


def test_variant_pairs_by_pages(spark, equal_to_sql, monkeypatch):
    """Pictures are matched in the tasks that compare their hashes; no join carries them."""
    monkeypatch.setattr(hamming, "PAGE", 50)
    grid = np.random.default_rng(8).normal(size=(180, 64)).astype(np.float32) / 8
    grid[90:100] = -grid[:10] * 0.97
    grid[100:110] = np.rot90(grid[:10].reshape(-1, 8, 8), axes=(1, 2)).reshape(-1, 64) * 1.01
    grid[110:115] = grid[:5]
    df = spark.createDataFrame([(k, x.tolist(), k % 3) for k, x in enumerate(grid)], "vec_id long, embedding array<float>, label int")
    found = equal_to_sql("variant_pairs", embeddings=df)
    assert len(found) > 100
    plan = catalogue.variants.variant_pairs(df, "vec_id", "embedding", 8, 20, 0.6, 0.15)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan


@pytest.mark.parametrize("kind", ["int", "long"])
def test_small_graphs_are_searched_in_tasks(spark, monkeypatch, kind):
    """The same distances as by a join a hop: a large component, chains and pairs; more sources than are searched from at a time."""
    rng = np.random.default_rng(6)
    edges = [*rng.integers(0, 150, (220, 2)).tolist(), *([200 + k, 201 + k] for k in range(20)), *([300 + 2 * k, 301 + 2 * k] for k in range(40)), [7, 7], [9, None]]
    df = spark.createDataFrame([(a, b) for a, b in edges], f"a {kind}, b {kind}").repartition(3)
    monkeypatch.setattr(graph, "SOURCES", 64)
    got = graph.hop_distances(df, "a", "b")
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString() and got.schema["source"].dataType == df.schema["a"].dataType
    found = sorted(map(tuple, got.collect()))
    sums = {r["node"]: r["hops"] for r in graph.hop_sums(df, "a", "b").collect()}
    monkeypatch.setattr(graph, "SMALL", 0)
    want = sorted(map(tuple, graph.hop_distances(df, "a", "b").collect()))
    assert found == want and max(k for _, _, k in want) == 20
    assert sums == {r["node"]: r["hops"] for r in graph.hop_sums(df, "a", "b").collect()}


def test_components_of_dense_graphs_are_folded_first(spark, monkeypatch):
    rng = np.random.default_rng(7)
    edges = [(g * 1000 + int(a), g * 1000 + int(b)) for g in range(3) for a, b in rng.integers(0, 40, (600, 2))] + [(5000, 5001), (39, 5001)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    want = {tuple(r) for r in graph.connected_components(df, "a", "b").collect()}
    monkeypatch.setattr(graph, "MANY", 100)
    got = [tuple(r) for r in graph.connected_components(df, "a", "b").collect()]
    assert set(got) == want and len(got) == len(want) == 122 and {c for _, c in want} == {min(n for n, d in want if d == c) for _, c in want}


def test_near_pairs_of_members_are_made_once(spark, equal_to_sql):
    """What follows from the pairs reads them as written."""
    rng = np.random.default_rng(11)
    sign = rng.choice([-1.0, 1.0], (3, 64))[np.arange(150) % 3]
    for row in sign:
        row[rng.choice(64, 11, False)] *= -1
    df = spark.createDataFrame([(k, x.tolist(), 0) for k, x in enumerate(sign)], "vec_id long, embedding array<float>, label int")
    linked = equal_to_sql("links_of_members", embeddings=df)
    assert set(linked["link"]) == {"representative", "direct", "indirect"}
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/made-once"
    df.write.parquet(f"{folder}/embeddings.parquet")
    assert hasattr(derived._linked(spark, folder), "_written_to")
    assert catalogue.QUERIES["summaries_of_clusters"](spark, folder).agg(F.sum("members")).first()[0] == len(linked)


@pytest.mark.parametrize("page", [3, 8192])
def test_mutual_nearest_forms_no_pairs(spark, equal_to_sql, monkeypatch, page):
    """Neighbours by value, over pages, with many equal values, blocks of one side and long runs of one side."""
    monkeypatch.setattr(sets, "PAGE", page)
    rng = np.random.default_rng(page)
    some = [(k, f"b{k % 7 if k % 3 else 0}", float(rng.choice([rng.integers(0, 40), rng.uniform(0, 300)]))) for k in range(240)]
    runs = [(1000 + 2 * k, "run", k * 1.5) for k in range(20)] + [(1101, "run", 40.0), (1103, "run", 7.6), (1205, "odd", 1.0), (1207, "odd", 2.0), (1300, "two", 5.0), (1301, "two", 5.0), (1400, "one", 5.0), (1401, "one", 9.0)]
    df = spark.createDataFrame([*some, *runs], "p_partkey long, p_brand string, p_retailprice double").repartition(5)
    found = equal_to_sql("nearest_mutual", part=df)
    assert len(found) > 20 and {0.0, 4.0} <= set(found["distance"]) and {"run", "two", "one"} <= set(found["brand"])
    plan = catalogue.QUERIES["nearest_mutual"](spark, f"{equal_to_sql.folder}")._jdf.queryExecution().optimizedPlan().toString()
    assert "abs(" not in plan


@pytest.mark.parametrize("head", [5, 4096])
def test_leaders_of_crowded_groups_in_rounds(spark, equal_to_sql, monkeypatch, head):
    """Where a good part of all pairs is near, leaders are found without pairs, in the serial order."""
    monkeypatch.setattr(duplicates, "HEAD", head)
    monkeypatch.setattr(duplicates, "CROWD", 0.5)
    monkeypatch.setattr(duplicates, "links", lambda *a: pytest.fail("pairs are made"))
    rng = np.random.default_rng(head)
    grid = rng.normal(size=(300, 64)).astype(np.float32)
    grid[200:280] = grid[rng.integers(0, 200, 80)]
    df = spark.createDataFrame([(k, x.tolist(), k % 4 if k < 290 else None) for k, x in enumerate(grid)], "vec_id long, embedding array<float>, label int").repartition(4)
    rows = df.where("label is not null")
    found = equal_to_sql("leader_stacks", embeddings=rows)
    assert 8 < found["leader"].nunique() < 200
    bits = df.select("vec_id", "label", hashes.sign_bits(F.col("embedding")).alias("bits")).unionByName(spark.createDataFrame([(999, 1, None)], "vec_id long, label int, bits long"))
    every = {r["vec_id"]: r["leader"] for r in duplicates.leaders(bits, "vec_id", "bits", ["label"], 24).collect()}
    assert every[999] == 999 and every[290] == 290 and len(every) == 301 and all(every[k] == v for k, v in zip(found["vec_id"], found["leader"]))
