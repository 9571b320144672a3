"""Folder trees as tables: descendants, fingerprints of subtrees, groups of equal siblings, caps, and cuts to a budget.

A folder is a row with its path as an array of segments; the root is the empty array. Subtree facts are sums over exploded
ancestors, so nothing loops over levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import entries
from millrace.operators.inventory import head_and_tail
from millrace.operators.order import with_before
from millrace.plans.materialize import materialize, release


def ancestors(path: Column) -> Column:
    """A path's own prefixes, the root first, without the path itself."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(path) - 1, F.lit(0))), lambda k: F.slice(path, F.lit(1), k))


def descendant_counts(nodes: DataFrame, path: str = "path", is_folder: str = "is_folder") -> DataFrame:
    """(path, folders, files) below each folder that holds something."""
    below = nodes.where(F.size(path) > 0).select(F.explode(ancestors(F.col(path))).alias(path), is_folder)
    return below.groupBy(path).agg(F.count_if(F.col(is_folder)).alias("folders"), F.count_if(~F.col(is_folder)).alias("files"))


def bulk_only(files: DataFrame, path: str = "path") -> DataFrame:
    """(path, categories) of folders all of whose files, at any depth, are of repetitive bulk categories."""
    kind = entries.category(F.try_element_at(F.col(path), F.lit(-1)))
    below = files.select(F.explode(ancestors(F.col(path))).alias(path), kind.alias("c"))
    kinds = below.groupBy(path, "c").agg(F.count(F.lit(1)).alias("n")).groupBy(path).agg(F.bool_and(F.col("c").isin(*entries.REPETITIVE)).alias("bulk"), F.array_sort(F.collect_set("c")).alias("categories"))
    return kinds.where("bulk").select(path, "categories")


def subtree_fingerprints(files: DataFrame, path: str = "path") -> DataFrame:
    """(path, fingerprint, files) of each folder: equal for folders with the same relative layout. Bulk files count by
    their folder and category alone, so how they are called does not matter.

    The fingerprint adds up the digests of what lies below, so a large folder is neither collected nor sorted in one task.
    """
    name = F.try_element_at(F.col(path), F.lit(-1))
    kind = entries.category(name)
    named = F.when(kind.isin(*entries.REPETITIVE), F.concat(F.lit("*"), kind)).otherwise(F.lower(name))
    below = files.select(path, named.alias("leaf"), F.explode(F.sequence(F.lit(0), F.size(path) - 1)).alias("k"))
    inner = F.concat_ws("/", F.slice(F.col(path), F.col("k") + 1, F.size(path) - 1 - F.col("k")), F.col("leaf"))
    lines = below.select(F.slice(F.col(path), F.lit(1), F.col("k")).alias(path), inner.alias("line"))
    # bulk files of one folder are one line, however many there are
    lines = lines.groupBy(path, "line").agg(F.count(F.lit(1)).alias("n"))
    digest = F.conv(F.substring(F.sha2("line", 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return lines.groupBy(path).agg(F.pmod(F.sum(digest), F.lit(1 << 60).cast("decimal(38,0)")).cast("bigint").alias("fingerprint"), F.sum("n").alias("files"))


def equal_siblings(folders: DataFrame, path: str = "path", fingerprint: str = "fingerprint", least: int = 6, shown: int = 4) -> DataFrame:
    """Adds whether a folder is expanded: of ``least`` or more siblings with one fingerprint the first and last ``shown`` / 2
    are, all others always."""
    parent = F.slice(F.col(path), F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))
    rows = folders.withColumn("_parent", parent)
    sizes = rows.groupBy("_parent", fingerprint).agg(F.count(F.lit(1)).alias("_n"))
    at = rows.join(sizes, ["_parent", fingerprint]).withColumn("_at", F.row_number().over(W.partitionBy("_parent", fingerprint).orderBy(F.lower(F.array_join(path, "/")))))
    keep = (F.col("_n") < least) | (F.col("_at") <= (shown + 1) // 2) | (F.col("_at") > F.col("_n") - shown // 2)
    return at.withColumn("expanded", keep).drop("_parent", "_n", "_at")


def capped_folders(folders: DataFrame, group: str, name: str, limit: int = 60) -> DataFrame:
    """At most ``limit`` folders of a parent: hidden, collapsed and well-known ones first, then head and tail of the others."""
    low = F.lower(F.col(name))
    rows = folders.withColumn("_p", (low.startswith(".") | low.isin(*entries.PRIORITY_FOLDERS) | low.isin(*entries.COLLAPSED)).cast("int"))
    from millrace.operators.selection import budgeted

    return budgeted(rows, [group], limit, F.col("_p"), low, F.col(name)).drop("_p")


def _by_worth(folders: DataFrame, path: str, savings: str) -> DataFrame:
    """``folders`` with ``before``, the lines that cheaper cuts save: by tier, then most lines, deepest, path."""
    text = F.array_join(path, "/")
    keyed = folders.select("*", entries.prune_tier(F.col(path)).alias("tier"), (-F.col(savings)).alias("_s1"), (-F.size(path)).alias("_s2"), F.lower(text).alias("_s3"), text.alias("_s4"))
    return with_before(keyed, ["tier", "_s1", "_s2", "_s3", "_s4"], savings)


def pruned(folders: DataFrame, path: str, savings: str, excess: int) -> DataFrame:
    """Adds ``cut``: folders that give up their contents, cheapest first (tier, then most lines saved, deepest, path), until
    ``excess`` lines are saved. Folders do not contain one another here; for those that do there is :func:`cut_to_budget`.

    The order is one range-partitioned sort over all candidates, written; no task sees all of them.
    """
    placed = _by_worth(folders, path, savings)
    return placed.withColumn("cut", F.col("before") < excess).drop("before", "_s1", "_s2", "_s3", "_s4")


def line_counts(nodes: DataFrame, path: str = "path") -> DataFrame:
    """(path, lines) of each folder: the lines that what lies below it takes in a drawn tree, one a node. Each node adds one
    to each of its ancestors, so no level waits for another. The root is the empty path."""
    return nodes.where(F.size(path) > 0).select(F.explode(ancestors(F.col(path))).alias(path)).groupBy(path).agg(F.count(F.lit(1)).alias("lines"))


def drawn_lines(nodes: DataFrame, path: str = "path", is_folder: str = "is_folder") -> int:
    """The lines of a whole tree: one a node, and where the root holds two folders or more a blank line before the first and
    after each that something follows."""
    top = F.size(path) == 1
    n = nodes.where(F.size(path) > 0).agg(F.count(F.lit(1)).alias("all"), F.count_if(top & F.col(is_folder)).alias("folders"), F.count_if(top & ~F.col(is_folder)).alias("others")).first()
    return n["all"] + (n["folders"] + (n["others"] > 0) if n["folders"] >= 2 else 0)


def cut_to_budget(nodes: DataFrame, most: int, path: str = "path", is_folder: str = "is_folder") -> DataFrame:
    """(path, tier, lines) of the folders that give up their contents until a tree takes at most ``most`` lines, and the lines
    that each saves: greedily, the folder of the lowest tier first, then the one that saves most, deepest, by path.

    Folders may contain one another. Within a tier an outer folder always saves more than one inside it, so only outermost
    folders of a tier are ever chosen, and they don't touch each other's savings: a tier is one sort of its outermost
    folders with running sums. After it what lies in a cut folder is gone, and what it saved is taken from its ancestors. So
    the serial order is kept in at most ten rounds, each of joins on exploded ancestors; what is left is written.
    """
    excess = drawn_lines(nodes, path, is_folder) - most
    folders = materialize(nodes.where(F.col(is_folder)).select(path).distinct().join(line_counts(nodes, path), path).withColumn("tier", entries.prune_tier(F.col(path))), "tree")
    chosen = []
    for tier in range(10):
        if excess <= 0:
            break
        here = folders.where((F.col("tier") == tier) & (F.col("lines") > 0)).drop("tier")
        inner = here.select(path, F.explode(ancestors(F.col(path))).alias("_up")).join(here.select(F.col(path).alias("_up")), "_up", "left_semi").select(path).distinct()
        placed = _by_worth(here.join(inner, path, "left_anti"), path, "lines")
        cut = materialize(placed.where(F.col("before") < excess).select(path, "tier", "lines"), "cuts")
        release(placed)
        saved = cut.agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0]
        chosen.append(cut)
        if not saved:
            continue
        excess -= saved
        less = cut.select(F.explode(ancestors(F.col(path))).alias(path), "lines").groupBy(path).agg(F.sum("lines").alias("_less"))
        gone = folders.select(path, F.explode(F.concat(ancestors(F.col(path)), F.array(path))).alias("_up")).join(cut.select(F.col(path).alias("_up")), "_up", "left_semi").select(path).distinct()
        left = folders.join(gone, path, "left_anti").join(less, path, "left").select(path, (F.col("lines") - F.coalesce("_less", F.lit(0))).alias("lines"), "tier")
        last, folders = folders, materialize(left, "tree")
        release(last)
    release(folders)
    if not chosen:
        return nodes.limit(0).select(path, F.lit(0).alias("tier"), F.lit(0).cast("bigint").alias("lines"))
    out = chosen[0]
    for part in chosen[1:]:
        out = out.unionByName(part)
    return out


def rendered_tree(nodes: DataFrame, path: str = "path", is_folder: str = "is_folder") -> DataFrame:
    """(line, text) of a tree in depth-first order, folders before files, names in any case: two blanks a level."""
    # the sort key of each segment says whether it is a folder: all but the last are
    key = F.transform(F.col(path), lambda s, i: F.concat(F.when((i < F.size(path) - 1) | F.col(is_folder), "0").otherwise("1"), F.lower(s), F.lit("\x01"), s))
    name = F.try_element_at(F.col(path), F.lit(-1))
    rows = nodes.where(F.size(path) > 0).select(key.alias("key"), F.concat(F.repeat(F.lit("  "), F.size(path) - 1), F.lit("- "), name, F.when(F.col(is_folder), "/").otherwise("")).alias("text"))
    return rows.orderBy("key").select("text")


def sampled_names(files: DataFrame, group: list[str], limit: int, *order: Column) -> DataFrame:
    return head_and_tail(files, limit, group, *order)
