"""Pairs of similar names, by a set-similarity join over letters and an exact ratio on what it leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.names import similarity


def tokens(name: Column, size: int) -> Column:
    """The runs of ``size`` (1 or 2) characters of a name, each with how many equal ones came before; a shorter name is its
    own run."""
    n = F.char_length(name)
    runs = F.when(n >= size, F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.substring(name, i, F.lit(size)))).otherwise(F.array(name))
    return F.transform(runs, lambda p, i: F.concat(p, F.size(F.filter(F.slice(runs, F.lit(1), i), lambda q: q == p)).cast("string")))


def token_size(least: float) -> int:
    """Pairs of letters where similar names must share one, single letters at lower ratios."""
    return 2 if least > 5 / 6 else 1


def shared_at_least(total: Column, least: float) -> Column:
    """Tokens that two names of ``total`` characters share if their ratio reaches ``least``.

    The ratio is twice the matched characters over the total, so m >= least * total / 2 are matched: as many letters are
    shared. At most (1 - least) * total are not matched. Between two blocks a character at least is not: there are at most
    that many blocks and one, and a block of k characters shares k - 1 pairs. That leaves a pair from four characters on if
    ``least`` exceeds 5/6, and names of three or fewer are similar if equal only."""
    n = total * (1.5 * least - 1) - 1 if token_size(least) == 2 else total * (least / 2)
    return F.greatest(F.lit(1), F.ceil(n - 1e-9).cast("int"))


def similar_names(df: DataFrame, item: str, name: str, on: list[str], least: float = 0.84) -> DataFrame:
    """(on, a, b, similarity) of distinct names within a group whose ratio (of a's name to b's) is at least ``least``, by the
    first item of each name, a before b.

    Complete: of each name only so many of its rarest tokens (pairs of letters; single ones for ratios up to 5/6) are joined
    that two similar names must meet in one; lengths and numbers of shared tokens then leave few candidates for the ratio.
    Names may have any length, and no token counts as too frequent. Items with equal names are one class
    (:func:`classes_of_names`); null and empty names are similar to nothing.
    """
    if not 0 < least <= 1:
        raise ValueError("a ratio lies above 0 and is at most 1")
    names = classes_of_names(df, item, name, on).groupBy("g", "name").agg(F.min("first").alias("first"))
    sized = names.select("g", "name", "first", F.char_length("name").alias("n"), tokens(F.col("name"), token_size(least)).alias("tokens"))
    each = sized.select("g", "first", F.explode("tokens").alias("token"))
    often = each.groupBy("g", "token").agg(F.count(F.lit(1)).alias("often"))
    ranked = each.join(often, ["g", "token"]).groupBy("g", "first").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("rare"))
    # with the shortest partner that it may have a name shares the fewest tokens
    fewest = shared_at_least(F.col("n") * (2 / (2 - least)), least)
    rows = sized.join(ranked, ["g", "first"])
    lead = rows.select("g", "first", "n", F.explode(F.slice("rare", F.lit(1), F.greatest(F.size("rare") - fewest + 1, F.lit(1)))["token"]).alias("token"))
    end = lambda i, n: lead.select("g", "token", F.col("first").alias(i), F.col("n").alias(n))
    fits = F.least("n", "m") * 2 >= least * (F.col("n") + F.col("m")) - 1e-9
    met = end("a", "n").join(end("b", "m"), ["g", "token"]).where("a < b").where(fits).select("g", "a", "b").distinct()
    side = lambda i, k: sized.select("g", F.col("first").alias(i), F.col("name").alias(f"name_{i}"), F.col("tokens").alias(f"tokens_{i}"), F.col("n").alias(k))
    both = met.join(side("a", "n"), ["g", "a"]).join(side("b", "m"), ["g", "b"])
    enough = both.where(F.size(F.array_intersect("tokens_a", "tokens_b")) >= shared_at_least(F.col("n") + F.col("m"), least))
    found = enough.select("g", "a", "b", similarity("name_a", "name_b").alias("similarity")).where(F.col("similarity") >= least)
    return found.select("g.*", "a", "b", "similarity") if on else found.select("a", "b", "similarity")


def classes_of_names(df: DataFrame, item: str, name: str, on: list[str]) -> DataFrame:
    """(g, name, item, first): each item with a name, and the first item of the same name and group."""
    rows = df.where(F.col(name) != "").select((F.struct(*on) if on else F.lit(0)).alias("g"), F.col(name).alias("name"), F.col(item).alias("item"))
    return rows.join(rows.groupBy("g", "name").agg(F.min("item").alias("first")), ["g", "name"])
