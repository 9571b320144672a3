"""Fill-in-the-middle, periodic runs and language identification against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

pytest.importorskip("public_tokenizers")

from millrace.llm import fim, langid, queries, runs  # noqa: E402

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tables(sf):
    return pd.read_parquet(f"{sf}/documents.parquet")


# fill-in-the-middle


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    some = ["", None, "\n", "one", "a\nb\n\nc", "x\n" * 50, "ends<", "S>\n<\n<P", "has <P> in it", "é \n\U0001f600\r\n日", "l\n" * 30_000]
    some += ["\n".join("".join(rng.choice("<PSM>ab\r") for _ in range(rng.randrange(6))) for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    rows = [*enumerate(some), (None, "null key\nb"), (4, "a\nb\n\nc")]
    return rows, spark.createDataFrame([(k, t, "e", "o", "f") for k, t in rows], "doc_id long, text string, extra string, output string, form string").repartition(3)


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (60, 10)])
def test_fill_in_middle(texts, rate, spm):
    rows, docs = texts
    want = Counter()
    for k, t in rows:
        t = t or ""
        hexed = hashlib.sha256(f"7:{'' if k is None else k}".encode()).hexdigest()
        h = [int(hexed[8 * i : 8 * i + 8], 16) for i in range(4)]
        lines = re.findall(r"[^\n]*\n|[^\n]+", t)
        a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
        p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
        if t == "" or re.search("<[PSM]>", t) or h[2] % 100 >= rate:
            want[k, len(lines), "plain", None, None, t, sha(t), t, "e"] += 1
        else:
            form = "spm" if h[3] % 100 < spm else "psm"
            out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
            want[k, len(lines), form, len(p), len(m), out, sha(out), t, "e"] += 1
    got = fim.restore(fim.transform(docs, rate=rate, spm=spm))
    cols = ["doc_id", "n_units", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored", "extra"]
    assert Counter(tuple(r) for r in got.select(*cols).collect()) == want
    assert {x[2] for x in want} == {"plain", "spm", "psm"}
    assert all(r["restored_sha256"] == sha(r["restored"]) for r in got.select("restored", "restored_sha256").collect())


def test_fill_in_middle_of_other_units(texts, spark):
    _, docs = texts
    words = fim.restore(fim.transform(docs, units=r"\S*\s+|\S+", sentinels=("[pre]", "[suf]", "[mid]"), seed="s"), sentinels=("[pre]", "[suf]", "[mid]"))
    assert words.where("restored <> coalesce(text, '')").count() == 0 and words.where("form <> 'plain'").count() > 100
    assert fim.restore(fim.transform(docs.limit(0))).count() == 0
    twice = spark.createDataFrame([(1, "a\nb", 2)], "doc_id long, text string, x long").toDF("doc_id", "text", "x").select("doc_id", "text", "x", "x")
    assert fim.transform(twice).columns[:4] == ["doc_id", "text", "x", "x"]
    for bad in (("<P>", "<P>", "<M>"), ("aba", "x", "y"), ("ab", "bc", "d"), ("", "b", "c")):
        with pytest.raises(ValueError):
            fim.transform(docs, sentinels=bad)


# periodic runs


def plain_runs(words, least=12):
    """Every maximal stretch by its smallest period, from the definition."""
    found, n = {}, len(words)
    for p in range(1, n // 2 + 1):
        s = 0
        while s + p < n:
            e = s
            while e + p < n and words[e] == words[e + p]:
                e += 1
            if e > s and e + p - s >= max(least, 2 * p):
                found.setdefault((s, e + p), p)
            s = max(e, s) + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def collapsed(words, rows):
    gone = {i for s, n, p in rows for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def numbered(texts):
    ids, starts, _ = runs._numbered([t.encode() for t in texts])
    return ids, starts


def found_runs(texts, least=12):
    ids, starts = numbered(texts)
    rows = runs.find(ids, starts, least)
    which = np.searchsorted(starts, rows[:, 0], "right") - 1
    return [[(int(s - starts[k]), int(e - s), int(p)) for s, e, p in rows[which == k]] for k in range(len(texts))]


def test_runs_equal_brute_force(monkeypatch):
    rng = random.Random(11)
    texts = ["", "a", "a " * 11, "a " * 12, "a b " * 6, "a b " * 5 + "a", ("x y z " * 9 + "q ") * 4, "a " * 40 + "b " + "a " * 40]
    for _ in range(250):
        t = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            unit = [rng.choice("abcd") for _ in range(rng.randint(1, 9))]
            at = rng.randrange(len(t) + 1)
            t[at:at] = unit * rng.randint(2, 5) + unit[: rng.randrange(len(unit))]
        texts.append(" ".join(t))
    thue = "a"
    for _ in range(11):
        thue += thue.translate(str.maketrans("ab", "ba"))
    texts += [" ".join(thue), " ".join("abaababaabaab" * 3)]
    want = [plain_runs(t.split()) for t in texts]
    assert found_runs(texts) == want and sum(map(len, want)) > 300
    assert found_runs(texts, 4) == [plain_runs(t.split(), 4) for t in texts]
    monkeypatch.setattr(runs, "PAIRS", 100)  # many small blocks give the same
    assert found_runs(texts) == want


def test_lying_hashes_are_found_out(monkeypatch):
    """With hashes of a few bits stretches are claimed that are none; verification asks for other bases until all is right."""
    monkeypatch.setattr(runs, "PRIMES", (10_007,))
    monkeypatch.setattr(np.random, "default_rng", lambda k, f=np.random.default_rng: _Low(f(k), k))
    tried.clear()
    rng = random.Random(2)
    texts = [" ".join(rng.choice("ab") for _ in range(60)) for _ in range(60)]
    assert found_runs(texts) == [plain_runs(t.split()) for t in texts] and len(tried) > 1


tried = []


class _Low:
    """A generator whose first bases make all words hash alike."""

    def __init__(self, rng, k):
        tried.append(k)
        self.rng, self.k = rng, k

    def integers(self, low, high, n):
        return np.array([1, 0]) if self.k < 2 else self.rng.integers(2, 10_000, n)


def test_runs_query_equals_brute_force(spark):
    want = set()
    docs = tables(SMALL)
    for k, t in zip(docs.doc_id, docs.text, strict=True):
        w = WORD.findall(t or "")
        h, n = zlib.crc32(str(k).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        rows = plain_runs(w)
        best = min(((-n, s, p) for s, n, p in rows), default=None)
        top = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        want.add((k, len(rows), *top, sha("".join(f"{s},{n},{p}\n" for s, n, p in sorted(rows, key=lambda r: (r[0], r[2])))), sha(collapsed(w, rows))))
    got = queries.op12_periodic_runs(spark, SMALL).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(docs)
    assert sum(r["n_runs"] > 0 for r in got) > 10


def test_runs_of_odd_rows(spark):
    long = "w%d " * 6 % tuple(range(6)) * 3000
    rows = [(1, None, 7), (2, "", 7), (3, " \t\r\n", 7), (None, "é ü " * 8, 7), (4, long, 7), (4, long, 7), (5, "a\x0bb\x0ca\x1cb", 7)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, runs long, x long, n_words long").toDF("doc_id", "text", "runs", "text2", "n_words")
    got = runs.with_runs(df)
    assert got.columns == ["doc_id", "text", "text2", "n_words", "runs", "collapsed"]
    by = Counter((r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in got.collect())
    assert by == Counter({(1, 0, (), ""): 1, (2, 0, (), ""): 1, (3, 0, (), ""): 1, (None, 16, ((0, 16, 2),), "é ü"): 1, (4, 18000, ((0, 18000, 6),), "w0 w1 w2 w3 w4 w5"): 2, (5, 3, (), "a b a\x1cb"): 1})
    assert runs.with_runs(df.limit(0)).count() == 0
    null_key = queries.looped(spark.createDataFrame([(None, "a b c", "z"), (None, None, "z")], "doc_id long, text string, h string")).collect()
    assert [tuple(r) for r in null_key] == [(None, "z", "a b c"), (None, "z", None)]


def test_runs_query_of_rows_without_words(spark, tmp_path):
    keys = [k for k in range(200) if zlib.crc32(str(k).encode()) % 10 == 0]
    texts = [None, "", " \t\n", "one"]
    rows = list(zip(keys, texts, strict=False))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()}
    assert got == {k: (0, None, None, None, None, sha(""), sha((t or "").strip())) for k, t in rows}


# languages


def test_language_of_held_out_documents(spark):
    docs = tables(SF)
    got = {r["doc_id"]: r for r in queries.op13_language_id(spark, SF).collect()}
    assert len(got) == len(docs)
    for k in docs.doc_id:
        assert got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= got[k]["score"] <= 1
    unseen = [(r.text, r.lang, got[r.doc_id]["lang_pred"]) for r in docs.itertuples() if got[r.doc_id]["held_out"] and r.lang and any(map(str.isalpha, r.text or ""))]
    assert len(unseen) > 200 and sum(a == b for _, a, b in unseen) / len(unseen) >= 0.98


def test_languages_of_odd_rows(spark):
    rng = random.Random(8)
    make = {"xx": "abcde", "yy": "vwxyz", "zz": "αβγδε"}
    rows = [(k, " ".join("".join(rng.choice(make[lang]) for _ in range(5)) for _ in range(20)), lang, "n") for k in range(300) for lang in [rng.choice(list(make))]]
    rows += [(k, None, "xx", "n") for k in range(300, 310)] + [(None, "abc", "xx", "n"), (400, "12 ,", "yy", "n"), (401, "edcba", None, "n")] + [(0, "q", "aa", "n")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(5)
    model = langid.train(docs)
    assert set(make) <= set(model.languages) and not langid.train(docs.where("lang is null")).languages and not langid.train(docs.limit(0)).languages
    got = langid.with_language(docs, model).collect()
    assert len(got) == len(rows)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["text"] is None or not any(map(str.isalpha, r["text"])))
    assert all(r["lang_pred"] == r["lang"] for r in got if r["text"] and len(r["text"]) > 50)
    assert {r["lang_pred"] for r in got if r["doc_id"] == 401} == {"xx"}
    assert langid.with_language(docs.limit(0), model).count() == 0
    nothing = langid.with_language(docs, langid.Model([], np.empty((0, 0)), np.empty(0))).select("lang_pred", "score").distinct().collect()
    assert [tuple(r) for r in nothing] == [("und", 0.0)]


def test_languages_are_learnt_from_visible_rows_alone(spark):
    """Rows that are held out, and the languages of rows, change no prediction."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    other = docs.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 'zz top' else text end text", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 'zz' else lang end lang")
    a, b = langid.train(docs), langid.train(other)
    assert a.languages == b.languages and (a.log == b.log).all() and (a.prior == b.prior).all()
    few = langid.train(docs, sample=20)
    assert few.languages == a.languages and (few.prior == a.prior).all() and (few.log != a.log).any()


def test_a_model_equals_its_definition():
    seen = [("aa", "abab ab"), ("aa", "ba"), ("bb", "xyx")]
    counts = np.stack([sum(np.bincount(g, minlength=1 << langid.BITS) for n, t in seen if n == name for g in langid.gram_pieces(t)) for name in ("aa", "bb")])
    m = langid.Model(["aa", "bb"], counts, np.array([2.0, 1.0]))
    text = "ab, XY; 12 ab" * 30_000  # more than one piece

    def plain(k):
        p = (counts[k] + langid.ALPHA) / (counts[k] + langid.ALPHA).sum()
        return np.log([2 / 3, 1 / 3][k]) + sum(np.log(p)[g].sum() for g in langid.gram_pieces(text))

    s = m.scores(["ab", text, None])
    assert np.allclose(s[1], [plain(0), plain(1)], rtol=1e-6) and np.allclose(s[2], m.prior)
    assert sum(map(len, langid.gram_pieces(text))) > 4 * 230_000
