"""Images found on pages: which are kept, shown and in what order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.media import size_class

#: Fixed value: images of fewer bytes are favicons and spacers.
TINY = 3072


def worth_keeping(requests: DataFrame, seen: DataFrame, key: list[str], kind: str, size: str) -> DataFrame:
    """Requests without tiny images that were not seen before: an image of known size below TINY counts only as news of one
    that is there already."""
    known = seen.select(*key).distinct().withColumn("_seen", F.lit(True))
    tiny = F.coalesce((F.col(kind) == "image") & (F.col(size) < TINY), F.lit(False))
    return requests.join(known, key, "left").where(F.col("_seen").isNotNull() | ~tiny).drop("_seen")


def shown(images: DataFrame, downloaded: DataFrame | None, url: str, hidden: str, width: str, height: str, least_edge: int = 0, band: str = "all") -> DataFrame:
    """Images that are not hidden as copies, not downloaded before, at least so large on one edge, and in the band: all,
    large or medium."""
    w, h = (F.coalesce(F.col(c), F.lit(0)) for c in (width, height))
    rows = images.where(~F.coalesce(F.col(hidden), F.lit(False)))
    if downloaded is not None:
        rows = rows.join(downloaded.select(F.col(url).alias("_u")).distinct(), F.col(url) == F.col("_u"), "left_anti")
    if least_edge > 0:
        rows = rows.where(F.greatest(w, h) >= least_edge)
    return rows.where(size_class(w, h) == band) if band in ("large", "medium") else rows


def gallery_order(mode: str, width: Column, height: Column, found: Column) -> list[Column]:
    """Sort columns of a mode: smallest, newest (the order in which images were found), or largest; ties as found."""
    area = F.coalesce(width, F.lit(0)) * F.coalesce(height, F.lit(0))
    return [*{"smallest": [area.asc()], "newest": []}.get(mode, [area.desc()]), found.asc()]


def largest(images: DataFrame, key: Column, area: str, thumb: str, found: str) -> DataFrame:
    """(key, ...): of all forms of an image the largest, the first found of equals; where it has no thumbnail, that of the
    largest form that has one."""
    rank = F.struct(F.coalesce(area, F.lit(0)).alias("a"), (-F.col(found)).alias("f"))
    best = images.groupBy(key.alias("key")).agg(F.max_by(F.struct(*images.columns), rank).alias("_b"), F.max_by(thumb, F.when(F.col(thumb).isNotNull(), rank)).alias("_t"))
    return best.select("key", *(F.coalesce(F.col(f"_b.{c}"), "_t").alias(c) if c == thumb else F.col(f"_b.{c}").alias(c) for c in images.columns))
