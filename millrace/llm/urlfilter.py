"""URL filters: explicit rules, and a path-template tree that is learnt from labelled pages.

For each host the tree of path segments is walked from the root. Segments that look variable (numbers, hex, dates, ids;
an extension stays) are wildcards from the start, which shrinks the table before anything is joined. At each node

1. a child stands apart if its share of bad labels differs significantly from that of the rest of the node; all other
   children, those without labels too, are one wildcard branch;
2. of the children that stand apart, on either side of the rest, similar ones are merged: in the order of their shares each
   is tested against the branch put together so far, not against its neighbour, so no chain of small steps joins far ends.

A branch is walked on while its labels are mixed and enough for a split to be significant; the depth is the data's. What is left is a
template. It is rejected if it has labels of its own and its share of bad ones, smoothed towards its host's share and that
towards the whole table's, reaches the threshold. All steps are aggregations and joins of distinct (host, segments) rows;
children of a node with equal counts are one entry where branches are merged, so no group is as large as a node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.materialize import materialize, release

#: The z value beyond which shares differ (1 %), and the labels that a node needs to be split (with fewer no split can be
#: significant).
Z, LEAST = 2.58, 7
#: The names of the branch of children that do not stand apart, and of what lies below a branch that is not
#: walked on.
OTHER, BELOW = "*", "**"
#: Labelled pages that the host's share counts for in a template, and the share of bad labels that rejects.
WEIGHT, THRESHOLD = 8.0, 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. A rule is (verdict, ``host/path``); it fits its host and
    all subdomains if the path starts with the rule's; of equally long rules the first in text order wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, word).otherwise(verdict)
    return rule, verdict


def _shape(segment: Column) -> Column:
    """A wildcard for a segment that looks variable (keeping an extension), else the segment."""
    extension = F.regexp_extract(segment, r"(\.[A-Za-z][A-Za-z0-9]{0,4})$", 1)
    stem = F.substring(segment, F.lit(1), F.char_length(segment) - F.char_length(extension))
    variable = stem.rlike(r"^[0-9][0-9._-]*$|^[0-9a-fA-F]{8,}$|^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|[0-9]{3,}|^.{40,}$")
    return F.when(variable, F.concat(F.lit("*"), extension)).otherwise(segment)


def shapes(path: Column) -> Column:
    """All segments of the path, variable ones as wildcards."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), _shape)


def _differ(bad: Column, n: Column, other_bad: Column, other_n: Column) -> Column:
    """Whether two shares of bad labels differ significantly; false where a side has no labels. Each side gets a good and
    a bad label more, so that a handful of labels says little."""
    p, q = (bad + 1.0) / (n + 2), (other_bad + 1.0) / (other_n + 2)
    error = F.sqrt(p * (1 - p) / (n + 2) + q * (1 - q) / (other_n + 2))
    return (n > 0) & (other_n > 0) & (F.abs(p - q) > Z * error)


def _merged(apart: DataFrame, node: list[str]) -> DataFrame:
    """(node, side, labelled, bad, part): the branch of the children with these counts."""
    entry = F.struct((F.col("bad") / F.col("labelled")).alias("share"), "labelled", "bad", F.count(F.lit(1)).alias("k"))
    kinds = apart.groupBy(*node, "side", "labelled", "bad").agg(entry.alias("x")).groupBy(*node, "side").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("bad"), F.lit(0).alias("part"), F.array().cast("array<int>").alias("parts"))

    def add(a: Column, x: Column) -> Column:
        new = _differ(x["bad"], x["labelled"], a["bad"], a["n"])
        part = a["part"] + new.cast("int")
        held = lambda so_far, more: F.when(new, F.lit(0)).otherwise(so_far) + more * x["k"]
        return F.struct(held(a["n"], x["labelled"]).alias("n"), held(a["bad"], x["bad"]).alias("bad"), part.alias("part"), F.concat(a["parts"], F.array(part)).alias("parts"))

    parts = F.aggregate("xs", start, add, lambda a: a["parts"])
    return kinds.select(*node, "side", F.explode(F.arrays_zip("xs", parts.alias("part"))).alias("z")).select(*node, "side", "z.xs.labelled", "z.xs.bad", "z.part")


def build_tree(urls: DataFrame) -> DataFrame:
    """(host, segments, labelled, bad, template) for each distinct (host, segments) of ``urls`` (host, segments, labelled,
    bad), which is a written table."""
    node, done, level = ["host", "template"], [], 0
    tree = urls.withColumn("template", F.lit(""))
    while True:
        mixed = tree.groupBy(*node).agg(F.sum("labelled").alias("all_n"), F.sum("bad").alias("all_bad")).where((F.col("all_n") >= LEAST) & (F.col("all_bad") > 0) & (F.col("all_bad") < F.col("all_n")))
        here = tree.join(mixed, node, "left").withColumn("segment", F.get("segments", F.lit(level)))
        stop = F.col("all_n").isNull() | F.col("segment").isNull()
        tail = F.when(F.col("segment").isNotNull(), F.concat("template", F.lit(f"/{BELOW}"))).otherwise(F.col("template"))
        here = materialize(here.withColumn("stop", stop).withColumn("tail", tail), f"tree-{level}")
        done.append(here.where("stop").select("host", "segments", "labelled", "bad", F.col("tail").alias("template")))
        on = here.where("not stop")
        if not on.limit(1).count():
            break
        child = on.groupBy(*node, "segment", "all_n", "all_bad").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
        rest_n, rest_bad = F.col("all_n") - F.col("labelled"), F.col("all_bad") - F.col("bad")
        above = F.when(F.col("bad") * F.col("all_n") > F.col("all_bad") * F.col("labelled"), 1).otherwise(-1)
        child = child.withColumn("side", F.when(_differ(F.col("bad"), F.col("labelled"), rest_bad, rest_n), above).otherwise(0))
        child = materialize(child, "children")
        apart = child.where("side <> 0")
        parts = apart.join(_merged(apart, node), [*node, "side", "labelled", "bad"]).select(*node, "side", "part", "segment")
        first, more = F.min("segment").alias("first"), F.count(F.lit(1)).alias("n")
        names = parts.groupBy(*node, "side", "part").agg(first, more)
        names = names.union(child.where("side = 0").groupBy(*node).agg(first, more).select(*node, F.lit(0), F.lit(0), "first", "n"))
        # a branch of one child has its name, one that stands apart that of its first child and how many more it holds
        name = F.when(F.col("n") == 1, F.col("first")).when(F.col("side") == 0, OTHER).otherwise(F.format_string("{%s|+%d}", "first", F.col("n") - 1))
        members = parts.unionByName(child.where("side = 0").select(*node, "side", F.lit(0).alias("part"), "segment"))
        branch = members.join(names.select(*node, "side", "part", name.alias("branch")), [*node, "side", "part"]).select(*node, "segment", "branch")
        tree = on.join(branch, [*node, "segment"]).select("host", "segments", "labelled", "bad", F.concat("template", F.lit("/"), "branch").alias("template"))
        tree = materialize(tree, f"walked-{level}")
        release(child)
        level += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return materialize(out, "tree")


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url", label_key: str = "doc_id", bad: Column | None = None) -> DataFrame:
    """(key, host, path, rule, verdict, template, purity) for each page; purity is the smoothed share of bad labels.

    A label is bad if ``bad`` holds (low quality or toxic unless given); a key with several labels is bad if one is. Null
    keys have no label. Null and malformed urls belong to the host and path "". Repeated rows are judged alike, each as a
    page of its own; a template without labels of its own is allowed; an empty table gives an empty one. Other columns are
    not read. Of children with equal shares those with fewer labels are merged first.
    """
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))) if bad is None else bad
    known = labels.groupBy(F.col(label_key).alias("k")).agg(F.max(bad.cast("int")).alias("is_bad"))
    at = pages.select(F.col(key).alias("k"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    at = materialize(at.join(known, "k", "left").withColumn("segments", shapes(F.col("path"))), "urls")
    urls = at.groupBy("host", "segments").agg(F.count("is_bad").alias("labelled"), F.coalesce(F.sum("is_bad"), F.lit(0)).alias("bad"))
    tree = build_tree(materialize(urls.withColumn("bad", F.col("bad").cast("bigint")), "url-shapes"))
    hosts = tree.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("bad").alias("host_bad"))
    whole = tree.agg(F.coalesce(F.try_divide(F.sum("bad"), F.sum("labelled")), F.lit(0.0))).first()[0]
    shares = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).join(hosts, "host")
    towards = (F.col("host_bad") + WEIGHT * whole) / (F.col("host_labelled") + WEIGHT)
    shares = shares.select("host", "template", ((F.col("bad") + WEIGHT * towards) / (F.col("labelled") + WEIGHT)).alias("purity"), (F.col("labelled") > 0).alias("known"))
    named = tree.select("host", "segments", "template").join(shares, ["host", "template"])
    rule, word = rule_for(F.col("host"), F.col("path"), rules)
    learnt = F.when(F.col("known") & (F.col("purity") >= THRESHOLD), "block").otherwise("allow")
    return at.join(named, ["host", "segments"]).select(F.col("k").alias(key), "host", "path", rule.alias("rule"), F.coalesce(word, learnt).alias("verdict"), "template", "purity")
