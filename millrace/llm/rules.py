"""Quality rules as a learned decision list, with DataFrame functions only.

Statistics of every whole text are computed in the JVM. A list of rules is learnt from the statistics of labelled rows by
sequential covering: a rule is a conjunction of thresholds that is grown by information gain on one part of the rows and
pruned on another. A threshold, grown at the edge of a bin, then moves out to the middle between the bad rows that it
covers and the nearest good row. What a rule covers is set aside and the next one is learnt on the rest; a rule that fails
where it is pruned bars the threshold that it began with, and covering ends when none is left. Rows are dealt out to their
(statistic, bin) pairs once; each step is one aggregation of (statistic, bin, label) counts over these, of bounded size, and
what all rows that are left count is taken once for all rules that are tried on them. The list comes out as one ordered
Spark conditional.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import inf, log2, nextafter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.materialize import materialize, release

#: Labelled rows that are learnt from at most; bins of a statistic; conditions of a rule at most; the share of bad rows and
#: the number of rows that a rule needs where it is pruned.
SAMPLE, BINS, CONDITIONS, PURITY, SUPPORT = 50_000, 24, 3, 0.8, 5
WINDOW = 5
SYMBOLS = "#*$%&|<>"
_SPACE = r"[\x20\x09-\x0D]+"


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for a row, also where ``use`` refers to it in inner functions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeated_words(words: Column) -> Column:
    """Words that lie in windows of WINDOW words which occur twice or more in the array, each word once. Words and windows
    are compared by 64-bit hashes."""

    def windows(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return F.transform(starts, lambda i: F.struct(F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))).alias("h"), i.alias("i")))

    def twice(s: Column) -> Column:
        same = lambda x, i, d: F.coalesce(F.get(s, i + d)["h"] == x["h"], F.lit(False))
        return F.filter(s, lambda x, i: same(x, i, F.lit(1)) | ((i > 0) & same(x, i, F.lit(-1))))

    def covered(starts: Column) -> Column:
        step = F.transform(starts, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    starts = _bound(F.sort_array(_bound(hashes, windows)), lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"])))
    return F.when(F.size(words) >= WINDOW, _bound(starts, covered)).otherwise(F.lit(0).cast("long"))


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key as ``k``, and the statistics of each whole text. A null text is an empty one."""
    t = F.coalesce(F.col("t"), F.lit(""))
    number = lambda chars: F.char_length(F.regexp_replace(t, f"[^{chars}]+", "")).cast("long")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    df = df.select("k", "t", F.filter(F.split(t, _SPACE), lambda w: w != "").alias("words"), lines.alias("lines"))
    return df.select(
        "k",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace(t, _SPACE, "")).cast("long").alias("word_chars"),
        number(SYMBOLS).alias("n_symbols"),
        _bound(F.col("lines"), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        number("A-Z").alias("n_upper"),
        number("!").alias("n_exclaim"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _share(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))


#: What rules test: a name and an expression over the statistics.
FEATURES = {
    "words": lambda: F.col("n_words").cast("double"),
    "word_length": lambda: _share("word_chars", "n_words"),
    "symbols": lambda: _share("n_symbols", "word_chars"),
    "dup_lines": lambda: _share("n_dup_lines", "n_lines"),
    "repeats": lambda: _share("n_repeat_words", "n_words"),
    "distinct": lambda: _share("n_distinct", "n_words"),
    "upper": lambda: _share("n_upper", "word_chars"),
    "exclaim": lambda: _share("n_exclaim", "n_words"),
    "line_words": lambda: _share("n_words", "n_lines"),
}


@dataclass
class Rule:
    """A conjunction of (feature, at least or below, threshold)."""

    conditions: list[tuple[str, bool, float]] = field(default_factory=list)

    def column(self, of=None) -> Column:
        """The condition over the statistics, or over columns that ``of`` gives for features."""
        out = F.lit(True)
        for name, up, cut in self.conditions:
            value = of(name) if of else FEATURES[name]()
            out = out & (value >= F.lit(cut) if up else value < F.lit(cut))
        return out

    def __str__(self) -> str:
        return " AND ".join(f"{n} {'>=' if up else '<'} {cut:g}" for n, up, cut in self.conditions)


def as_conditional(rules: list[Rule]) -> Column:
    """The number of the first rule that covers a row, from 1, or null: one ordered CASE."""
    if not rules:
        return F.lit(None).cast("int")
    out = F
    for k, r in enumerate(rules, 1):
        out = out.when(r.column(), F.lit(k))
    return out


def _gain(p: int, n: int, all_p: int, all_n: int) -> float:
    return p * (log2(p / (p + n)) - log2(all_p / (all_p + all_n))) if p else 0.0


def learn(labelled: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules that cover bad rows of ``labelled`` (the statistics, ``k`` and ``bad``); rows that fail the base rules and
    null labels are not learnt from. Without bad or without good rows there is no rule."""
    rows = labelled.where(F.col("bad").isNotNull() & ~base_failed()).orderBy(F.xxhash64("k", "n_words", "word_chars"), "k").limit(sample)
    rows = rows.select("k", "bad", *(e().alias(f) for f, e in FEATURES.items()))
    rows = materialize(rows, "labelled-statistics")
    cuts_of = rows.agg(*(F.percentile_approx(f, [k / BINS for k in range(1, BINS)], 10_000).alias(f) for f in FEATURES)).first()
    # a value that fills several bins is a candidate from below and from above
    cuts = {f: sorted({c for c in got} | {nextafter(c, inf) for c in got if got.count(c) > 1}) for f in FEATURES for got in [cuts_of[f] or []]}
    bins = [sum(((F.col(f) >= c).cast("int") for c in cuts[f]), F.lit(0)).alias(f"b_{f}") for f in FEATURES]
    binned = materialize(rows.select("bad", (F.pmod(F.xxhash64("k"), F.lit(3)) == 0).alias("prune"), *FEATURES, *bins), "binned-statistics")
    release(rows)
    bad = F.col("bad").cast("int")
    stack = ", ".join(f"'{f}', `b_{f}`" for f in FEATURES)
    pairs = binned.where(~F.col("prune")).select(bad.alias("y"), *FEATURES, *(f"b_{f}" for f in FEATURES), F.expr(f"stack({len(FEATURES)}, {stack}) as (f, b)"))
    pairs = materialize(pairs, "statistic-bins")

    def covers(conditions) -> Column:
        """Of (feature, up, bin)."""
        out = F.lit(True)
        for f, up, b in conditions:
            out = out & (F.col(f"b_{f}") >= b if up else F.col(f"b_{f}") < b)
        return out

    def counts(where: Column) -> dict:
        """Bad and good rows by feature and bin."""
        got = pairs.where(where).groupBy("f", "b").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n")).collect()
        return {(r["f"], r["b"]): (r["p"], r["n"]) for r in got}

    def grow(left: Column, whole: dict, barred: set) -> list[tuple[str, bool, int]]:
        grown: list[tuple[str, bool, int]] = []
        while len(grown) < CONDITIONS:
            have = counts(left & covers(grown)) if grown else whole
            first = next(iter(FEATURES))
            total = [sum(v[k] for (f, _), v in have.items() if f == first) for k in (0, 1)]
            if not total[0] or not total[1]:
                break
            best = (1e-9, None)
            for f in FEATURES:
                for b in range(1, len(cuts[f]) + 1):
                    above = [sum(v[k] for (g, c), v in have.items() if g == f and c >= b) for k in (0, 1)]
                    for up, (p, n) in ((True, above), (False, [total[k] - above[k] for k in (0, 1)])):
                        if p >= SUPPORT and (grown or (f, up) not in barred) and (g := _gain(p, n, *total)) > best[0]:
                            best = (g, (f, up, b))
            if best[1] is None:
                break
            grown.append(best[1])
        return grown

    def settled(left: Column, grown) -> Rule:
        """The rule with each threshold moved out, one after the other, to the middle of the gap behind which good rows are."""
        found = [(f, up, cuts[f][b - 1]) for f, up, b in grown]
        for k, (f, up, cut) in enumerate(found):
            others = Rule(found[:k] + found[k + 1 :]).column(of=F.col)
            v = F.col(f)
            outside = (v < cut) if up else (v >= cut)
            good = binned.where(left & others & outside & (bad == 0)).agg((F.max(v) if up else F.min(v)).alias("g")).first()["g"]
            beyond = F.lit(True) if good is None else (v > good if up else v < good)
            edge = binned.where(left & others & beyond & (bad == 1)).agg((F.min(v) if up else F.max(v)).alias("e")).first()["e"]
            if good is not None and edge is not None and (edge < cut if up else edge >= cut):
                found[k] = (f, up, (good + edge) / 2)
            elif good is None and edge is not None and (edge < cut if up else edge >= cut):
                found[k] = (f, up, edge if up else nextafter(edge, inf))
        return Rule(found)

    found: list[Rule] = []
    left, barred = F.lit(True), set()
    whole = counts(left)
    while grown := grow(left, whole, barred):
        tests = [F.sum((covers(grown[: k + 1]) & (bad == y)).cast("int")).alias(f"c{k}{y}") for k in range(len(grown)) for y in (1, 0)]
        got = binned.where(left & F.col("prune")).agg(*tests).first()
        worth = [((got[f"c{k}1"] or 0) - (got[f"c{k}0"] or 0)) / max(1, (got[f"c{k}1"] or 0) + (got[f"c{k}0"] or 0)) for k in range(len(grown))]
        keep = max(range(len(grown)), key=lambda k: (worth[k], -k))
        p, n = got[f"c{keep}1"] or 0, got[f"c{keep}0"] or 0
        if p + n < SUPPORT or p < PURITY * (p + n):
            barred.add(grown[0][:2])
            continue
        rule = settled(left, grown[: keep + 1])
        left = left & ~rule.column(of=F.col)
        found.append(rule)
        whole, barred = counts(left), set()
    release(binned, pairs)
    return found


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(key, the statistics, base_failed, rule, kept) of each whole text; rule is the number of the first learnt rule that
    covers the row. Labels of 0 are bad; a key with several labels takes the lowest. Null keys have no label. Repeated
    rows are judged alike; an empty table gives an empty one; other columns are not read."""
    stats = materialize(statistics(docs, key, text), "statistics")
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg((F.min(label) == 0).alias("bad"))
    rules = learn(stats.join(known, "k"))
    rule = as_conditional(rules)
    failed = base_failed()
    return stats.select(F.col("k").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & rule.isNull()).alias("kept"), rule.alias("rule"))
