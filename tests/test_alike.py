"""Similar names against a comparison of all pairs by the standard library's matcher."""

import difflib
import itertools
import random

import pandas as pd
import pytest

from millrace.functions import names
from millrace.operators import alike


def plain(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def test_ratio_equals_the_standard_library():
    rng = random.Random(1)
    for k in range(1500):
        letters = "ab" if k % 3 else "abcdefghij "
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(14 if k % 5 else 40))) for _ in range(2))
        assert names.ratio(a, b) == plain(a, b), (a, b)
    for k in range(60):  # texts in which frequent characters begin no block
        a = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöü0123456789     eeeee") for _ in range(rng.randrange(150, 420)))
        b = list(a)
        for _ in range(rng.randrange(60)):
            b[rng.randrange(len(b))] = rng.choice("xyz eäq")
        b = "".join(b)[rng.randrange(30) :]
        assert names.ratio(a, b) == plain(a, b) and names.ratio("e" * 300, b) == plain("e" * 300, b)
    assert names.ratio(None, "a") == names.ratio("", "a") == 0


@pytest.mark.parametrize("least", [0.6, 0.8, 0.84, 0.95, 1.0])
def test_no_similar_pair_is_missed(spark, least):
    rng = random.Random(int(least * 100))
    base = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 16))) for _ in range(40)]
    rows = []
    for k in range(220):
        n = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            n[rng.randrange(len(n))] = rng.choice(["", "x", "ab", "é"])
            n = list("".join(n)) or ["q"]
        rows.append((k, "".join(n), rng.choice(["u", "v", None])))
    rows += [(900, None, "u"), (901, "", "u"), (902, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "id int, name string, brand string").repartition(4)
    first = {}
    for k, n, g in sorted(rows):
        first.setdefault((g, n), k)
    want = {(g, a, b): plain(n, m) for ((g, n), a), ((h, m), b) in itertools.permutations(first.items(), 2) if g == h and a < b and plain(n, m) >= least}
    got = alike.similar_names(df, "id", "name", ["brand"], least).collect()
    assert {(r["brand"], r["a"], r["b"]): r["similarity"] for r in got} == want and len(got) == len(want)
    assert least == 1.0 or len(want) > 3
    free = {(a, b) for (g, n), a in first.items() for (h, m), b in first.items() if a < b and n and n != m and plain(n, m) >= least}
    if least == 0.84:
        loose = {(r["a"], r["b"]) for r in alike.similar_names(df.where("brand = 'u'"), "id", "name", [], least).collect()}
        assert loose == {(a, b) for g, a, b in want if g == "u"} and free
    assert alike.similar_names(df.limit(0), "id", "name", ["brand"], least).count() == 0


def test_names_of_parts(spark):
    """All pairs within a brand, over the whole table."""
    from millrace.plans.catalogue import QUERIES

    sf = "/root/testdata/sf0.001"
    parts = pd.read_parquet(f"{sf}/part.parquet")
    first = parts.groupby(["p_brand", "p_name"]).p_partkey.min()
    want = {(g, a, b): plain(n, m) for g, own in first.groupby(level=0) for ((_, n), a), ((_, m), b) in itertools.permutations(own.items(), 2) if a < b and plain(n, m) >= 0.84}
    got = QUERIES["similar_names"](spark, sf).collect()
    assert {(r["p_brand"], r["a"], r["b"]): r["similarity"] for r in got} == pytest.approx(want) and want
    with pytest.raises(ValueError):
        alike.similar_names(spark.createDataFrame([], "a int, n string"), "a", "n", [], 0.0)
