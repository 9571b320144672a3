"""Texts beyond the size that operators take at once, clashing column names, empty tables, and learnt parts against plain
versions."""

import base64
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from millrace.llm import bpe, decontaminate, simhash, suffix, tokencount, toxicity, urlfilter, warc  # noqa: E402
from millrace.llm.text import map_texts  # noqa: E402

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def long_text():
    return prose(random.Random(31), 170_000)  # about 1.3 MB


def test_long_texts_of_simhash(long_text):
    import xxhash

    words = long_text.lower().encode().split()
    h = np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)], np.uint64)
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0)
    assert len(long_text) > 1 << 20 and simhash.simhash(long_text.encode()) == int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64).view(np.int64)[0]) & (1 << 64) - 1


def test_long_texts_of_toxicity(long_text, monkeypatch):
    stamp = np.zeros(1 << toxicity.BITS, np.int32)
    whole = set(toxicity.columns_of(long_text, stamp).tolist())
    monkeypatch.setattr(toxicity, "PIECE", 1 << 22)
    assert set(toxicity.columns_of(long_text, stamp).tolist()) == whole


def test_long_texts_of_tokenizers(long_text):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert np.frombuffer(bpe.Codec(path).encode(long_text), "<u4").tolist() == Tokenizer.from_file(path).encode(long_text, add_special_tokens=False).ids
    m = tokencount.Unigram.load(public_tokenizers.path("piece_bpe_32k.model"))
    words = long_text.split()
    parts = m.count([" ".join(words[i : i + 5000]) for i in range(0, len(words), 5000)])
    assert m.count([long_text])[0][:2] == (len(words), sum(p[1] for p in parts))
    alone = "x" * 3000
    assert m.count([alone])[0][1] == m._alone(tokencount.MARK + alone)[0]


def test_long_texts_of_search_and_suffixes(spark, long_text):
    rng = random.Random(32)
    passage = prose(rng, 60)
    one, other = long_text + " <" + passage + "> " + prose(rng, 90_000), "[" + passage + "] end"
    df = spark.createDataFrame([(1, one), (2, other), (3, "none")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix.digests(df).collect()}
    assert got == {1: (len(passage), 1), 2: (len(passage), 1), 3: (0, 0)}
    bench = spark.createDataFrame([(7, " ".join(passage.split()[5:40]))], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.contained_items(df, bench).collect()} == {1, 2}


def test_near_copies_of_large_bands(spark, monkeypatch):
    rng = random.Random(36)
    base, rows = prose(rng, 150).split(), []
    for k in range(70):  # copies of one text that differ in up to 14 places: some pairs are similar, others are not
        copy = list(base)
        for place in rng.sample(range(150), rng.randint(0, 14)):
            copy[place] = f"new{k}x{place}"
        rows.append(" ".join(copy))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in rows)]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    assert 1 < len(set(group)) < 60
    for few, many in ((16, 512), (2, 5)):
        monkeypatch.setattr(simhash, "FEW", few)
        monkeypatch.setattr(simhash, "MANY", many)
        assert {r["doc_id"] for r in simhash.one_of_each(df).collect()} == set(group)


def test_names_that_clash(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    names = ["doc_id", "text", "score", "ids", "decoded", "n_tokens", "row", "t", "c0", "x0", "spans", "k"]
    df = spark.createDataFrame([(1, "some text here", *"abcdefghij"), (2, None, *"abcdefghij")], ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))
    model = toxicity.Model([], np.array([]))
    assert sorted(toxicity.with_score(df, model).columns) == sorted(names) and toxicity.with_score(df, model, keep_below=0.5).columns == names
    encoded = bpe.encode(df, path)
    assert sorted(encoded.columns) == sorted(names)
    assert [r["decoded"] for r in bpe.decode(encoded, path).orderBy("doc_id").collect()] == ["some text here", ""]
    counted = tokencount.token_counts(df, public_tokenizers.path("piece_bpe_32k.model"))
    assert counted.count() == 2 and counted.columns.count("n_tokens") == 1
    assert suffix.without_repeats(df).columns == names and simhash.one_of_each(df).columns == names
    bench = spark.createDataFrame([(1, "nothing of it at all here")], "item_id long, text string")
    assert decontaminate.without_contained(df, bench).columns == names and decontaminate.without_contained(df, bench).count() == 2
    twice = df.select("text", F.lit(1).alias("a"), F.lit(2).alias("a"))
    assert map_texts(twice, "text", lambda t: [t], {"z": "string"}).columns == ["text", "a", "a", "z"]


def test_decontamination_by_join(spark, monkeypatch):
    rng = random.Random(33)
    texts = [(k, prose(rng, rng.choice([3, 60, 200]))) for k in range(30)] + [(99, None), (98, "")]
    texts += [(50, texts[4][1]), (4, texts[4][1]), (51, prose(rng, 400) + " " + texts[5][1][:300])]
    items = [(k, t) for k, t in texts[:12]] + [(0, texts[1][1]), (77, None), (78, "a b"), (79, " ".join(prose(rng, 40).split()))]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    near = Counter(map(tuple, decontaminate.contained_items(docs, bench).collect()))
    kept = Counter(map(tuple, decontaminate.without_contained(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 0)
    assert Counter(map(tuple, decontaminate.contained_items(docs, bench).collect())) == near and near
    assert Counter(map(tuple, decontaminate.without_contained(docs, bench).collect())) == kept
    assert decontaminate.contained_items(docs.limit(0), bench).count() == 0 and decontaminate.without_contained(docs, bench.limit(0)).count() == len(texts)


def test_toxicity_fit_against_a_plain_one():
    rng, stamp = random.Random(34), np.zeros(1 << toxicity.BITS, np.int32)
    texts = [prose(rng, 6) + (" vile" if k % 3 == 0 else "") for k in range(60)]
    y = np.array([1 if k % 3 == 0 else -1 for k in range(60)])
    rows = [toxicity.columns_of(t, stamp) for t in texts]
    # ratios of whole n-grams, counted by text
    grams = [{t.lower()[i : i + n] for n in toxicity.ORDERS for i in range(len(t) - n + 1)} for t in texts]
    count = {s: Counter(g for k in range(60) if (y[k] > 0) == s for g in grams[k]) for s in (True, False)}
    prior = {s: ((y > 0) == s).mean() for s in (True, False)}
    n = {s: ((y > 0) == s).sum() for s in (True, False)}
    share = lambda g, s: (count[s][g] + toxicity.ALPHA * prior[s]) / (n[s] + toxicity.ALPHA * prior[s])
    ratio = toxicity.ratios(rows, y)
    for g in ["vile", "ile", "alp", "eta1"]:
        column = toxicity.columns_of(g, stamp)[-1]
        assert math.isclose(ratio[column], math.log(share(g, True) / share(g, False)), abs_tol=1e-4)
    # the same problem by plain gradient descent on the primal
    x = np.zeros((60, len(set(np.concatenate(rows)))))
    place = {c: k for k, c in enumerate(sorted(set(np.concatenate(rows).tolist())))}
    for k, r in enumerate(rows):
        x[k, [place[c] for c in r.tolist()]] = ratio[r]
        x[k] /= np.linalg.norm(x[k])
    weight = toxicity.COST * np.where(y > 0, 0.5 / prior[True], 0.5 / prior[False])

    def loss(v, b):
        return 0.5 * (v @ v + b * b) + (weight * np.maximum(0, 1 - y * (x @ v + b)) ** 2).sum()

    v, b = np.zeros(x.shape[1]), 0.0
    for _ in range(4000):
        g = -2 * weight * y * np.maximum(0, 1 - y * (x @ v + b))
        v, b = v - 0.002 * (v + x.T @ g), b - 0.002 * (b + g.sum())
    w, bias = toxicity.fit(rows, y, ratio)
    assert loss(np.array([w[c] for c in place]), bias) <= 1.01 * loss(v, b) + 1e-6


def plain_tree(urls):
    """{(host, segments): template} by the rules of the operator, node by node."""
    out = {}

    def differ(b, n, ob, on):
        if not n or not on:
            return False
        p, q = (b + 1) / (n + 2), (ob + 1) / (on + 2)
        return abs(p - q) > urlfilter.Z * math.sqrt(p * (1 - p) / (n + 2) + q * (1 - q) / (on + 2))

    def walk(rows, template, level):
        n, bad = sum(r[2] for r in rows), sum(r[3] for r in rows)
        mixed = n >= urlfilter.LEAST and 0 < bad < n
        by = {}
        for r in rows:
            if not mixed or len(r[1]) <= level:
                out[r[0], r[1]] = template + ("/**" if len(r[1]) > level else "")
            else:
                by.setdefault(r[1][level], []).append(r)
        sums = {s: (sum(r[2] for r in x), sum(r[3] for r in x)) for s, x in by.items()}
        groups = {}
        for side in (0, 1, -1):
            own = [s for s, (k, b) in sums.items() if (0 if not differ(b, k, bad - b, n - k) else 1 if b * n > bad * k else -1) == side]
            if side == 0:
                groups[0, 0] = own
                continue
            held_n = held_b = part = 0
            for share, k, b in sorted({(sums[s][1] / sums[s][0], *sums[s]) for s in own}):
                same = [s for s in own if sums[s] == (k, b)]
                if differ(b, k, held_b, held_n):
                    held_n = held_b = 0
                    part += 1
                held_n, held_b = held_n + k * len(same), held_b + b * len(same)
                groups.setdefault((side, part), []).extend(same)
        for (side, _), own in groups.items():
            if own:
                name = own[0] if len(own) == 1 else "*" if side == 0 else f"{{{min(own)}|+{len(own) - 1}}}"
                walk([r for s in own for r in by[s]], f"{template}/{name}", level + 1)

    for host in {u[0] for u in urls}:
        walk([u for u in urls if u[0] == host], "", 0)
    return out


def test_url_tree_against_a_plain_one(spark):
    from millrace.plans.materialize import materialize

    rng = random.Random(35)
    rates = {s: rng.choice([0.02, 0.1, 0.5, 0.9, 0.98]) for s in "abcdefgh"}
    urls = {}
    for _ in range(400):
        path = tuple(rng.choice("abcdefgh") for _ in range(rng.randint(0, 4))) + (("deep",) * 12 if rng.random() < 0.1 else ())
        n = rng.choice([0, 0, 1, 3, 12])
        rate = rates[path[-1]] if path and path[-1] in rates else 0.3
        urls[rng.choice(["h", "g"]), path] = (n, sum(rng.random() < rate for _ in range(n)))
    rows = [(h, p, n, b) for (h, p), (n, b) in urls.items()]
    df = materialize(spark.createDataFrame([(h, list(p), n, b) for h, p, n, b in rows], "host string, segments array<string>, labelled long, bad long"), "urls")
    got = {(r["host"], tuple(r["segments"])): r["template"] for r in urlfilter.build_tree(df).collect()}
    assert got == plain_tree(rows) and any("{" in t for t in got.values())


def test_unlabelled_sibling_is_no_bridge(spark):
    rows = [(k, f"http://h/a/x{k}") for k in range(20)] + [(100 + k, f"http://h/b/x{k}") for k in range(20)] + [(200 + k, f"http://h/u/x{k}") for k in range(20)]
    labels = [(k, int(k != 0), 0) for k in range(20)] + [(100 + k, int(k == 0), 0) for k in range(20)]
    got = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), []).collect()
    assert all(r["verdict"] == ("block" if 100 <= r["page_id"] < 200 else "allow") for r in got)


def test_warc_fields_and_paths(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a", "x")], "page_id long, url string, html string")
    manifest = warc.write_archives(df, "page_id", "url", "html", folder=str(tmp_path / "with blank"))
    path = manifest.first()["path"]
    assert path.startswith("file:")
    import gzip

    with gzip.open(path.removeprefix("file:")) as f:
        head = f.read()
    assert b"WARC-Date: 20" in head and b"\r\n\r\nx" in head
    digest = base64.b32encode(hashlib.sha1(b"x").digest()).decode()
    assert warc.record_digests(manifest).first()["payload_digest"] == digest


def test_stages_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    for name, ddl in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], ddl).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_copies_of_a_context_pass_one_at_a_time(spark):
    """A context that every task has met comes to its bucket as often; one copy is held, and dead contexts are none."""
    import pyarrow as pa

    rng = random.Random(8)
    passage = bytes(rng.randrange(97, 123) for _ in range(260))
    other, dead = passage[:230] + b"x" * 40, bytes(rng.randrange(97, 123) for _ in range(300))
    rows = [(0, 1, 1, 1, 500, None)] + [(0, 1, 1, 1, None, passage)] * 500 + [(0, 1, 2, 2, 1, None), (0, 1, 2, 2, None, other), (0, 5, 5, 5, None, dead), (0, 5, 5, 5, None, dead), (1, 9, 9, 9, 1, None), (1, 9, 9, 9, None, dead)]
    schema = pa.schema([(c, pa.int64()) for c in suffix._LIVE[:5]] + [("context", pa.binary())])
    batches = [pa.RecordBatch.from_pylist([dict(zip(suffix._LIVE, r, strict=True)) for r in rows[k : k + 7]], schema) for k in range(0, len(rows), 7)]
    got = [tuple(r.values()) for b in suffix._bucket_windows(200)(iter(batches)) for r in b.to_pylist()]
    # all windows of the context with 500 places, and those of the other one that it shares
    assert sorted(got) == [(1, 1, 1, 0, 60), (1, 2, 2, 0, 30)]
    text = passage.decode()
    docs = spark.createDataFrame([(k, f"{k:06d} {text} {k * 7:07d}") for k in range(240)], "doc_id long, text string")
    one, many = (Counter(tuple(r) for r in suffix.digests(docs.repartition(n)).collect()) for n in (1, 60))
    assert one == many and sum(r[2] for r in one) >= 240 * 260


def test_a_small_sample_gives_the_same_groups(spark, monkeypatch):
    """The tree's sample decides how fingerprints are dealt out, never which of them are linked."""
    rng = random.Random(17)
    base = [prose(rng, 40) for _ in range(90)]
    rows = [(k, t) for k, t in enumerate(base)] + [(100 + k, " ".join([*t.split()[:-1], "end"])) for k, t in enumerate(base[:60])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    groups = lambda: {r["doc_id"]: r["component"] for r in simhash.near_duplicates(docs).collect()}
    want = groups()
    monkeypatch.setattr(simhash, "SAMPLED", 40)
    assert groups() == want
    monkeypatch.setattr(simhash, "SAMPLED", 0)
    assert groups() == want and len(set(want.values())) < 150


def test_of_equal_keys_and_texts_the_least_row_stays(spark):
    text = prose(random.Random(3), 30)
    rows = [(1, text, v, "x") for v in (5, 3, 9)] + [(2, text, 0, "x"), (None, "alone", 7, "b"), (None, "alone", 7, "a")]
    for n in (1, 4):
        got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, v int, w string").repartition(n)).collect()
        assert sorted(map(tuple, got), key=str) == sorted([(1, text, 3, "x"), (None, "alone", 7, "a")], key=str)
