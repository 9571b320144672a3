"""Cuts of nested folders against the serial order, on random trees."""

import random

import pytest

from millrace.functions import entries
from millrace.operators import tree

NAMES = ["vendor", "src", "docs", "a", "b", "Tmp", "lib", "x", "core"]


def plain_lines(nodes, cut):
    """Lines of the tree by walking it."""
    kids = {}
    for path, folder in nodes:
        kids.setdefault(path[:-1], []).append((path, folder))

    def below(path):
        return sum(1 + (below(p) if f and p not in cut else 0) for p, f in kids.get(path, []))

    top = kids.get((), [])
    folders = sum(f for _, f in top)
    return below(()) + (folders + (len(top) > folders) if folders >= 2 else 0), below


def plain_cuts(nodes, tiers, most):
    cut = {}
    while True:
        total, below = plain_lines(nodes, cut)
        open_ = [p for p, f in nodes if f and not any(p[:k] in cut for k in range(1, len(p) + 1)) and below(p)]
        if total <= most or not open_:
            return cut
        best = min(open_, key=lambda p: (tiers[p], -below(p), -len(p), "/".join(p).lower(), "/".join(p)))
        cut[best] = (tiers[best], below(best))


@pytest.mark.parametrize("seed", range(2))
def test_cuts_keep_the_serial_order(spark, seed):
    rng = random.Random(seed)
    folders = {()}
    for _ in range(70):
        folders.add((*rng.choice(sorted(folders)), rng.choice(NAMES)))
    folders = {p for p in folders if p and len(p) < 7}
    folders |= {p[:k] for p in folders for k in range(1, len(p))}
    nodes = [(p, True) for p in folders] + [((*p, f"f{k}"), False) for p in [*folders, ()] for k in range(rng.randrange(4))]
    df = spark.createDataFrame([(list(p), f) for p, f in nodes], "path array<string>, is_folder boolean").repartition(3)
    tiers = {tuple(r["path"]): r["t"] for r in df.where("is_folder").select("path", entries.prune_tier(df["path"]).alias("t")).collect()}
    total, below = plain_lines(nodes, {})
    assert tree.drawn_lines(df) == total
    assert {tuple(r["path"]): r["lines"] for r in tree.line_counts(df).collect()} == {p: below(p) for p in [*folders, ()] if below(p)}
    for most in (total, total // 2, 1):
        got = {tuple(r["path"]): (r["tier"], r["lines"]) for r in tree.cut_to_budget(df, most).collect()}
        assert got == plain_cuts(nodes, tiers, most)
    assert tree.cut_to_budget(df.limit(0), 5).count() == 0
