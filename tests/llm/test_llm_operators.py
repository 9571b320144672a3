"""Each operator against a brute-force version, with nulls, empty texts, ties, repeated rows, empty tables and clashing
column names."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest


public_tokenizers = pytest.importorskip("public_tokenizers")

from millrace.llm import bpe, decontaminate, rules, sharding, simhash, suffix, tokencount, toxicity, urlfilter, warc  # noqa: E402
from millrace.llm.text import shingle_pieces, word_pieces  # noqa: E402

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, n) for n in (3, 40, 80, 120, 200, 300)]
    passage = prose(rng, 70)
    near = base[4].split()
    near[50] = "changed"
    out = [*base, base[3], base[3], " ".join(near), "lead " + passage + " tail", prose(rng, 30) + " " + passage, "", None, "a" * 900, "é" * 500, "x", "\x00\x01 \x0b y"]
    return list(enumerate(out)) + [(None, "no key"), (3, base[3])]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, k, "r", "s") for k, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, rid long, row string, fp string").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_words_and_shingles():
    text = b" a\tb  c\x0bd e " * 50
    assert [w for p in word_pieces(text, 16) for w in p] == text.split()
    assert [s for p in shingle_pieces(b"a b", 3) for s in p] == [b"a b"]
    assert [s for p in shingle_pieces(b" ", 3) for s in p] == []


def test_simhash_groups(docs, texts):
    got = simhash.near_duplicates(docs).collect()
    fp = [np.uint64(simhash.simhash((t or "").encode())) for _, t in texts]
    group = list(range(len(fp)))
    for _ in fp:
        for i in range(len(fp)):
            for j in range(len(fp)):
                if np.bitwise_count(fp[i] ^ fp[j]) <= 3:
                    group[i] = group[j] = min(group[i], group[j])
    want = Counter()
    for i, (k, _) in enumerate(texts):
        keys = [texts[j][0] for j in range(len(fp)) if group[j] == group[i] and texts[j][0] is not None]
        want[k, int(fp[i].view(np.int64)), min(keys, default=None)] += 1
    assert Counter((r["doc_id"], r["fp"], r["component"]) for r in got) == want


def test_simhash_tree_finds_every_pair():
    rng = np.random.default_rng(1)
    points = np.unique(np.concatenate([rng.integers(0, 1 << 63, 3000, np.uint64), np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 64, 60, np.uint64))]))
    tree = simhash.build_tree(points[::7], 16)
    idx, leaf, home = simhash.route(tree, points, 3)
    assert sorted(idx[home]) == list(range(len(points)))
    own = dict(zip(idx[home], leaf[home], strict=True))
    at = {(i, x) for i, x in zip(idx, leaf, strict=True)}
    pairs = {(int(a), int(b)) for q, p in simhash.close_pairs(points, points, 3) for a, b in zip(q, p, strict=True) if a < b}
    brute = {(i, int(j)) for i in range(len(points)) for j in np.flatnonzero(np.bitwise_count(points[i + 1 :] ^ points[i]) <= 3) + i + 1}
    assert pairs == brute
    for a, b in brute:
        low, high = sorted((own[a], own[b]))
        assert low == high or ((a if own[a] == low else b), high) in at


def test_simhash_one_of_each(docs, texts, none):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert len({r["text"] or "" for r in rows}) == len(rows)
    assert {3} == {r["doc_id"] for r in rows if r["text"] == texts[3][1]}
    assert not any(r["text"] == texts[8][1] for r in rows)
    assert simhash.one_of_each(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0


def test_stage_links_by_simhash_trees(spark):
    rng = random.Random(23)
    base = [prose(rng, rng.randrange(100, 400)) for _ in range(30)]
    texts = base + [t + " end" for t in base] + [prose(rng, 200) for _ in range(30)]
    sets = [simhash.shingle_hashes(t.encode()) for t in texts]
    fps = [simhash.set_simhashes(s).view(np.int64).tolist() for s in sets]
    # no two sets share a band: only the trees can find the copies
    rows = spark.createDataFrame([(i, len(sets[i]), fps[i], [i]) for i in range(90)], "id long, n long, fps array<long>, bands array<long>")
    pairs = {(r["src"], r["dst"]) for r in simhash.tree_pairs(rows).collect()}
    near = {(i + 30, i) for i in range(30) if min(int(np.bitwise_count(np.uint64(a % 2**64) ^ np.uint64(b % 2**64))) for a, b in zip(fps[i], fps[i + 30], strict=True)) <= simhash.STAGE_RADIUS}
    assert pairs == near and len(near) > 25
    known = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = simhash.similar(rows, lambda ids: known.join(ids, "id")).collect()
    assert {(r["node"], r["component"]) for r in got} == near | {(b, b) for _, b in near}


def test_simhash_one_of_each_is_exact_in_similarity(spark):
    rng = random.Random(12)
    rows = []
    for k in range(60):
        words = prose(rng, 200).split()
        rows.append(" ".join(words))
        for changes in (4, 5, 8):  # scattered, so five shingles each: similarities of 0.81, 0.77 and 0.66
            copy = list(words)
            for c in range(changes):
                copy[10 + 20 * c] = f"new{k}x{c}"
            rows.append(" ".join(copy))
    # a chain whose ends are not similar, and a text of one shingle
    words = prose(rng, 120).split()
    rows += [" ".join(words[i : i + 100]) for i in (0, 8, 16)] + ["one two", "One  TWO", "one two three"]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for t in rows for w in [t.lower().split()]]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in simhash.one_of_each(df).collect()} == set(group)


def brute_spans(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        cover = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                cover[i : i + length] = True
        runs = int((np.diff(np.r_[0, cover.astype(int)]) == 1).sum())
        out.append((len(t), int(cover.sum()), runs, hashlib.sha256(bytes(b for b, c in zip(t, cover, strict=True) if not c)).hexdigest()))
    return out


def test_suffix_array_windows():
    rng = random.Random(2)
    for _ in range(60):
        length = rng.choice([1, 2, 3, 5, 8, 9, 20])
        letters = rng.choice([b"ab", b"a", b"abcd\x00\xff"])
        some = [bytes(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 40, 120]))) for _ in range(rng.randint(1, 5))]
        count = Counter(t[i : i + length] for t in some for i in range(len(t) - length + 1))
        want = [[count[t[i : i + length]] > 1 for i in range(len(t) - length + 1)] for t in some]
        assert [x.tolist() for x in suffix.repeated_windows(some, length)] == want


def test_suffix_dedup(docs, texts, none):
    got = Counter(tuple(r) for r in suffix.digests(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == Counter((k, *x) for (k, _), x in zip(texts, brute_spans([t for _, t in texts], 200), strict=True))
    assert suffix.digests(none).count() == 0
    cleaned = suffix.without_repeats(docs, chars="rid")
    assert cleaned.columns == docs.columns and cleaned.count() == len(texts)
    assert {r["text"] for r in cleaned.where("doc_id = 14").collect()} == {""}


def test_suffix_crowd(spark, monkeypatch):
    monkeypatch.setattr(suffix, "CROWD", 2)
    rng = random.Random(3)
    shared = prose(rng, 60)
    rows = [(i, prose(rng, 12) + " " + shared[rng.randrange(60) :] + " " + prose(rng, 12)) for i in range(14)]
    rows += [(14, rows[0][1]), (15, "ab" * 300), (16, "x" + "ab" * 200), (17, None)]
    got = {r["k"]: tuple(r)[1:] for r in suffix.digests(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect()}
    assert got == dict(enumerate(brute_spans([t for _, t in rows], 200)))


def test_distributed_suffix_sort(spark):
    from millrace.llm.suffixsort import suffix_ranks
    from millrace.plans.materialize import materialize

    rng = random.Random(21)
    words = [bytes(rng.choice(b"ab") for _ in range(rng.choice([1, 2, 3, 4, 9, 30]))) for _ in range(20)] + [b"a" * 31, b"ab" * 20]
    df = spark.createDataFrame([(i, [c - 96 for c in w]) for i, w in enumerate(words)], "id long, s array<long>")
    depth = 12
    ranks = {r["id"]: r["r"] for r in suffix_ranks(materialize(df, "strings"), depth).collect()}
    order = [w[i : i + depth] for r, w, i in sorted((r, w, i) for k, w in enumerate(words) for i, r in enumerate(ranks[k]) if i + depth <= len(w))]
    assert order == sorted(order) and all(len(ranks[k]) == len(w) for k, w in enumerate(words))


def test_decontamination(spark, docs, texts, none):
    items = [(1, texts[4][1]), (2, " ".join(texts[5][1].split()[20:60])), (3, prose(random.Random(9), 30)), (4, ""), (5, None), (6, "no key"), (7, texts[2][1].upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    sets = [(k, decontaminate.shingles((t or "").encode())) for k, t in texts]
    want = Counter()
    for i, t in items:
        s = decontaminate.shingles((t or "").encode())
        for k, d in sets:
            if s and len(s & d) >= 0.8 * len(s):
                want[k, i, len(s), len(s & d)] += 1
    got = Counter((r["doc_id"], r["item_id"], r["n_shingles"], r["n_found"]) for r in decontaminate.contained_items(docs, bench).collect())
    assert got == want and want
    left = decontaminate.without_contained(docs, bench)
    assert left.columns == docs.columns
    assert left.count() == sum(1 for k, _ in sets) - len([1 for k, d in sets if any(len(s & d) >= 0.8 * len(s) for s in (decontaminate.shingles((t or "").encode()) for _, t in items) if s)])
    assert decontaminate.contained_items(none, bench).count() == 0
    assert decontaminate.contained_items(docs, bench.limit(0)).count() == 0


def test_toxicity(spark, none):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(500):
        toxic = i % 5 == 0
        rows.append((i, prose(rng, 40) + (" you horrible nasty villain" if toxic else "") + prose(rng, 5)))
        labels.append((i, int(toxic)))
    df = spark.createDataFrame([*rows, (None, None), (501, "")], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(df, marks)
    got = toxicity.with_score(df, model, name="s").select("doc_id", "s", toxicity.held_out().alias("h")).collect()
    unseen = [r for r in got if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert unseen and all(r["h"] for r in unseen)
    right = [(r["s"] >= 0.5) == (r["doc_id"] % 5 == 0 and r["doc_id"] < 500) for r in unseen]
    assert sum(right) / len(right) > 0.95
    assert all(0 <= r["s"] <= 1 for r in got) and len(got) == 502
    assert toxicity.with_score(none, model).count() == 0
    assert toxicity.train(df, marks.limit(0)).score("any", np.zeros(1 << toxicity.BITS, np.int32)) < 0.01


def test_toxicity_of_few_labels():
    rng, stamp = random.Random(13), np.zeros(1 << toxicity.BITS, np.int32)
    bad = "qzvxj wkqpz jyqwv".split()  # each in 12 of 180 texts

    def some(n):
        return [(prose(rng, 40) + (f" {bad[i // 5 % 3]}" if i % 5 == 0 else "") + " " + prose(rng, 5), int(i % 5 == 0)) for i in range(n)]

    seen = some(180)
    model = toxicity.Model([toxicity.columns_of(t, stamp) for t, _ in seen], np.array([y for _, y in seen]))
    right = [(model.score(t, stamp) >= toxicity.THRESHOLD) == y for t, y in some(120)]
    assert sum(right) / len(right) > 0.95


def test_bpe_equals_the_library(docs, texts, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    c = bpe.Codec(path)
    rng = random.Random(6)
    some = ["", "<|endoftext|>a <|endoftext|>", " " * 30, "\x1c\x85　 c\n\n", "a" * 300, "日本語 \U0001f600", "don't WE'LL 12 ½"]
    some += ["".join(chr(rng.choice([rng.randint(1, 127), rng.randint(128, 0x2FFF)])) for _ in range(80)) for _ in range(100)]
    some += ["".join(rng.choice("the ing abon'st\n  ") for _ in range(rng.randint(1, 200))) for _ in range(300)]
    for x in some:
        ids = t.encode(x, add_special_tokens=False).ids
        assert np.frombuffer(c.encode(x), "<u4").tolist() == ids
        assert c.decode(np.array(ids, "<u4").tobytes()).decode("utf-8", "replace") == t.decode(ids, skip_special_tokens=False)
    rows = bpe.decode(bpe.encode(docs, path), path).select("doc_id", "text", "ids", "decoded", "row").collect()
    assert all(r["decoded"] == (r["text"] or "") and r["ids"] == t.encode(r["text"] or "", add_special_tokens=False).ids for r in rows)
    assert bpe.round_trip(docs, path).count() == len(texts) and bpe.round_trip(none, path).count() == 0


def test_token_counts(docs, texts, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    m = tokencount.Unigram.load(path)
    longest = max(map(len, m.scores))

    def plain(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            options = [(best[end - 1][0] + m.floor, -(-best[end - 1][1] + len(word[end - 1].encode())))]
            options += [(best[s][0] + m.scores[word[s:end]], best[s][1] - 1) for s in range(max(0, end - longest), end) if word[s:end] in m.scores]
            best.append(max(options))
        return -best[-1][1]

    want = Counter((k, len((t or "").split()), sum(plain(tokencount.MARK + w) for w in (t or "").split())) for k, t in texts)
    got = tokencount.token_counts(docs, path)
    assert Counter((r["doc_id"], r["n_pretokens"], r["n_tokens"]) for r in got.collect()) == want
    assert tokencount.token_counts(none, path).count() == 0


def test_sharding(docs, texts, none, spark, tmp_path):
    got = sharding.assign(docs, 3, slots=64, folder=str(tmp_path / "map")).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in texts)
    for s in range(3):
        at = sorted(r["position"] for r in got if r["shard"] == s)
        assert at == list(range(len(at)))
    assert sharding.assign(none, 3).count() == 0
    rng = random.Random(1)
    size = [rng.randrange(1, 1000) for _ in range(512)]
    even = sharding.even(512, 8)
    flat = sharding.rebalance(even, size, 8)
    load = [sum(b for s, b in zip(flat, size, strict=True) if s == k) for k in range(8)]
    assert max(load) - min(load) <= 0.002 * load[0]
    grown = sharding.grow(flat, size, 8)
    assert all(b in (a, 8) for a, b in zip(flat, grown, strict=True))
    new = sum(b for s, b in zip(grown, size, strict=True) if s == 8)
    assert 0.9 * sum(size) / 9 <= new <= sum(size) / 9


def test_warc(spark, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 1000)
    rows = [(1, "http://a/é b", "x" * 2500), (2, None, "same"), (3, "http://c", "same"), (4, "http://d", None), (5, "http://e", ""), (6, "u\r\nv", "WARC/1.1\r\n\r\n"), (3, "http://c", "same"), (None, "n", "alone")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(2)
    manifest = warc.write_archives(df, "page_id", "url", "html")
    got = Counter(tuple(r) for r in warc.record_digests(manifest).select("id", "payload_bytes", "payload_digest", "type", "refers_to").collect())
    want = Counter()
    for k, _, h in rows:
        raw = (h or "").encode()
        keys = [i for i, _, x in rows if (x or "").encode() == raw and i is not None]
        top = max(keys, default=None)
        want[str(k) if k is not None else "null", len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if k == top else "revisit", None if k == top else str(top)] += 1
    assert got == want
    chunks = warc.read_chunks(manifest, size=1000).where("id = '1'").orderBy("number").collect()
    assert [len(c["chunk"]) for c in chunks] == [1000, 1000, 500] and b"".join(c["chunk"] for c in chunks) == b"x" * 2500
    assert [c["last"] for c in chunks] == [False, False, True] and chunks[1]["bytes"] == 2000
    assert {r["uri"] for r in warc.read_chunks(manifest, False).collect()} >= {"http://a/é b", "u\r\nv", None}
    empty = warc.write_archives(df.limit(0), "page_id", "url", "html")
    assert warc.record_digests(empty).count() == 0


def test_url_filters(spark):
    rows = [(i, f"http://shop.bad.example/{'spam' if i % 2 else 'news'}/{i}.html?x=1") for i in range(60)]
    rows += [(100, "https://WWW.Example.com/en/7?q"), (101, "ftp://example.com/en/8"), (102, "http://a.example.net/de/81"), (103, "http://x.net/de/81#f"), (104, None), (105, "no scheme"), (106, "://h"), (107, "http://netx/de/"), (108, "http://a.b.org/es/1"), (None, "http://q.example/1")]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(60)] + [(1, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    from millrace.llm.queries import URL_RULES

    got = {r["page_id"]: r for r in urlfilter.judge(pages, labels, URL_RULES).collect()}
    assert len(got) == len(rows)
    for k, u in rows:
        host = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        assert (got[k]["host"], got[k]["path"]) == ((re.sub("[A-Z]", lambda m: m[0].lower(), host[1]), host[2]) if host else ("", ""))
    assert all(got[i]["verdict"] == ("block" if i % 2 else "allow") for i in range(60))
    assert [got[k]["rule"] for k in (100, 101, 102, 103, 107, 108)] == ["example.com/en/7", "com/en/", "example.net/de/8", "net/de/", None, "org/es/"]
    assert [got[k]["verdict"] for k in (100, 101, 102, 103, 108)] == ["allow", "block", "block", "allow", "block"]
    assert urlfilter.judge(pages.limit(0), labels, URL_RULES).count() == 0
    assert {r["verdict"] for r in urlfilter.judge(pages.where("page_id < 60"), labels.limit(0), []).collect()} == {"allow"}


def test_url_filters_keep_a_rare_bad_section(spark):
    # 60 sections of a host; one with under 2 % of the pages is all bad
    rows = [(i, f"http://h.example/s{i % 60}x/{i}.html") for i in range(3000)] + [(3000 + i, f"http://h.example/rare/{i}.html") for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i < 3000), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    got = urlfilter.judge(pages, labels, []).collect()
    assert all(r["verdict"] == ("block" if r["page_id"] >= 3000 else "allow") for r in got) and len(got) == len(rows)


def test_quality_rules(spark, docs, texts, none):
    stats = {(r["k"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rules.statistics(docs).collect()}
    extra = [(1, "a b c d e f a b c d e\n\nx\nx\n \n \n#$ <>"), (2, "a a a a a a a"), (3, "x y z w")]
    more = spark.createDataFrame(extra, "doc_id long, text string")
    stats |= {(r["k"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rules.statistics(more).collect()}
    want = set()
    for k, t in [*texts, *extra]:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        count = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        want.add((k, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)))
    assert stats == want
    rng = random.Random(8)
    rows = [(i, prose(rng, 60) if i % 3 else " ".join(w + "###" for w in prose(rng, 60).split())) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int")
    out = rules.judge(df, labels).collect()
    assert all(r["kept"] for r in out if r["doc_id"] % 3)
    assert not any(r["kept"] for r in out if r["doc_id"] % 3 == 0)
    assert rules.judge(none, labels).count() == 0
    assert all(r["kept"] == (not r["base_failed"]) for r in rules.judge(docs, labels.limit(0)).collect())
    plan = df.select("doc_id")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in rules.judge(df, labels)._jdf.queryExecution().executedPlan().toString()


def test_quality_rules_deal_rows_out_once(spark, monkeypatch):
    rng = random.Random(9)
    spoil = [lambda w: w + "##", str.upper, lambda w: w + "!", str]
    rows = [(i, " ".join(map(spoil[min(3, i % 9)], prose(rng, 60).split()))) for i in range(450)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 9 < 3) for i in range(450)], "k long, bad boolean")
    dealt, expr = [], rules.F.expr
    monkeypatch.setattr(rules.F, "expr", lambda x: (dealt.append(x), expr(x))[1])
    assert len(rules.learn(rules.statistics(df).join(known, "k"))) == 2
    assert sum(x.startswith("stack") for x in dealt) == 1


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    passage, leak = prose(rng, 60), prose(rng, 30)
    rows = [(i, prose(rng, 60) + (" you horrible nasty villain" if i % 5 == 0 else ""), "en", "s", 1) for i in range(300)]
    rows[1] = (1, rows[2][1], "en", "s", 1)
    rows[3] = (3, rows[3][1] + " " + passage, "en", "s", 1)
    rows[4] = (4, passage + " " + rows[4][1], "en", "s", 1)
    rows[6] = (6, rows[6][1] + " " + leak, "en", "s", 1)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = {i for i in range(300) if i % 5}
    assert len(clean - set(kept["toxicity"])) <= 2 and len(set(kept["toxicity"]) - clean) <= 3
    assert 1 in kept["near_dedup"] and 2 not in kept["near_dedup"]
    assert passage[50:-50] not in kept["suffix_array_dedup"][3] and kept["suffix_array_dedup"][3].startswith(rows[3][1][:100])
    assert 6 not in kept["benchmark_decontamination"] and 7 in kept["benchmark_decontamination"]
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in final} == set(kept["benchmark_decontamination"])


