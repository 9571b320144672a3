"""Loading tables of a scale-factor folder, and the file inventories that are derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import entries


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; only the columns and row groups that a query asks for are read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session_defaults(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings that the operators count on: UTC, adaptive execution with skew joins, no legacy charsets."""
    return builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")


def list_files(spark: SparkSession, folder: str, extensions: list[str] | None = None, depth: int | None = None, skip: list[str] | None = None) -> DataFrame:
    """(path, size, modified, extension, depth) of the files below a folder, contents unread.

    Extensions are compared in any case; ``depth`` keeps files at most so many folders down; ``skip`` names folders that
    are left out wherever they occur.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    root = folder.rstrip("/").split("://")[-1].removeprefix("file:")
    inner = F.substring(F.col("path"), F.instr("path", root) + len(root) + 1, F.lit(1 << 30))
    parts = F.split(inner, "/")
    files = files.withColumn("extension", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))).withColumn("depth", F.size(parts) - 1)
    if extensions:
        files = files.where(F.col("extension").isin([e.lower() for e in extensions]))
    if depth is not None:
        files = files.where(F.col("depth") <= depth)
    if skip:
        files = files.where(~F.arrays_overlap(parts, F.array(*map(F.lit, skip))))
    return files


def scanned(files: DataFrame, parts: str, include: list[str] | None = None, exclude: list[str] | None = None, depth: int | None = None, hidden: bool = False) -> DataFrame:
    """``files`` (``parts``: the segments of their paths) with ``state``: why a file is not shown, or ``shown``.

    In this order: below a ``collapsed`` folder, ``hidden`` (a segment that begins with a dot, unless hidden ones are
    asked for), ``deep`` (more than ``depth`` folders down), ``filtered`` by globs (:func:`entries.kept_by_globs`). Nothing is dropped, so counts of what is not shown stay at hand (:func:`scan_counts`).
    """
    inner = F.slice(F.col(parts), F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(inner), F.lit(1))), lambda k: F.slice(inner, F.lit(1), k))
    out = F.when((F.size(inner) > 0) & F.exists(folders, entries.is_collapsed), "collapsed")
    if not hidden:
        out = out.when(F.exists(parts, lambda s: s.startswith(".")), "hidden")
    if depth is not None:
        out = out.when(F.size(inner) > depth, "deep")
    if include or exclude:
        out = out.when(~entries.kept_by_globs(F.array_join(parts, "/"), include or [], exclude or []), "filtered")
    return files.withColumn("state", out.otherwise("shown"))


def scan_counts(scan: DataFrame, parts: str, size: str) -> DataFrame:
    """(folder, state, files, bytes) of each top folder, shown and not."""
    return scan.groupBy(F.get(F.col(parts), F.lit(0)).alias("folder"), "state").agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"))


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files (path, size): the folders are region, nation and customer, the size is the price in cents."""
    region, nation, customer = (load(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    folders = customer.join(F.broadcast(nation.join(region, nation.n_regionkey == region.r_regionkey)), customer.c_nationkey == nation.n_nationkey)
    at = folders.select("c_custkey", F.array("r_name", "n_name", F.concat(F.lit("c"), F.col("c_custkey").cast("string"))).alias("folders"))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("size"))
    return orders.join(at, orders.o_custkey == at.c_custkey).select("folders", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("name"), "size")
