"""M3U and HLS playlists: lines in, entries or segments out, and lines back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text): the lines of each file, in order; UTF-8 with or without a mark, else Windows-1252."""
    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    return raw.select("file", F.posexplode(F.split(F.regexp_replace(text, "^﻿", ""), r"\r\n|\r|\n")).alias("line", "text"))


def write_files(lines: DataFrame, path: str, playlist: str, text: str, *order: str) -> None:
    """Write lines as text, a folder ``playlist=name`` with one file a playlist, lines in order. A playlist is sorted by one task, which
    spills what does not fit."""
    rows = lines.select(F.col(playlist).alias("playlist"), *order, F.col(text).alias("value")).repartition("playlist").sortWithinPartitions("playlist", *order)
    rows.select("playlist", "value").write.partitionBy("playlist").text(path)


def entries(lines: DataFrame) -> DataFrame:
    """(file, line, location, comments): each line that is no comment, with the comments right before it; blank lines and
    the header are dropped."""
    t = lines.select("file", "line", F.trim("text").alias("text")).where((F.col("text") != "") & (F.upper("text") != "#EXTM3U"))
    is_entry = (~F.col("text").startswith("#")).cast("int")
    w = W.partitionBy("file").orderBy("line")
    group = t.withColumn("e", is_entry).withColumn("g", F.sum("e").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("e"))
    packed = group.groupBy("file", "g").agg(F.sort_array(F.collect_list(F.when(F.col("e") == 0, F.struct("line", "text")))).alias("c"), F.max(F.when(F.col("e") == 1, F.struct("line", "text"))).alias("x"))
    return packed.where("x is not null").select("file", F.col("x.line").alias("line"), F.col("x.text").alias("location"), F.transform("c", lambda x: x["text"]).alias("comments"))


def entry_key(location: Column) -> Column:
    """``url:`` and the address, or ``path:`` and the path with forward slashes, in lower case."""
    return F.when(location.rlike(r"^[A-Za-z][A-Za-z0-9+.-]+://"), F.concat(F.lit("url:"), F.lower(location))).otherwise(F.concat(F.lit("path:"), F.lower(F.translate(location, "\\", "/"))))


def merge_entries(rows: DataFrame, source: str = "source", line: str = "line", location: str = "location", deduplicate: bool = True) -> DataFrame:
    """Entries of several sources in source order, each location once (where it occurs first) unless told otherwise."""
    if not deduplicate:
        return rows
    first = rows.groupBy(entry_key(F.col(location)).alias("_k")).agg(F.min(F.struct(F.col(source), F.col(line), *(F.col(c) for c in rows.columns if c not in (source, line)))).alias("f"))
    return first.select(*(F.col("f")[c].alias(c) for c in rows.columns))


def write_lines(df: DataFrame, order: Column, seconds: Column, title: Column, location: Column) -> DataFrame:
    """The text lines of a playlist, in order, ready for ``write.text``: header, then an information line and a location
    for each entry; unknown durations are -1."""
    body = df.select(order.alias("o"), F.explode(F.array(F.struct(F.lit(0).alias("k"), F.concat(F.lit("#EXTINF:"), F.coalesce(F.bround(seconds).cast("bigint"), F.lit(-1)).cast("string"), F.lit(","), F.coalesce(title, F.lit(""))).alias("t")), F.struct(F.lit(1).alias("k"), location.alias("t")))).alias("x"))
    head = df.sparkSession.range(1).select(F.lit("#EXTM3U").alias("value"), F.lit(None).cast(body.schema["o"].dataType).alias("o"), F.lit(-1).alias("k"))
    return head.unionByName(body.select(F.col("x.t").alias("value"), "o", F.col("x.k").alias("k"))).orderBy(F.col("o").asc_nulls_first(), "k").select("value")


def attributes(text: Column) -> Column:
    """KEY=VALUE pairs of an attribute list as a map; commas in quotes do not part pairs and quotes are dropped."""
    pattern = F.lit(r'([A-Z0-9-]+)=("[^"]*"|[^,]*)')
    return F.map_from_arrays(F.regexp_extract_all(text, pattern, F.lit(1)), F.transform(F.regexp_extract_all(text, pattern, F.lit(2)), lambda v: F.regexp_replace(v, '^"|"$', "")))


def hls_variants(lines: DataFrame) -> DataFrame:
    """(file, line, url, bandwidth, resolution, codecs) of a master playlist: each stream line with the next location."""
    t = lines.where(F.trim("text") != "").select("file", "line", F.trim("text").alias("text"))
    t = t.withColumn("url", F.lead("text").over(W.partitionBy("file").orderBy("line"))).where(F.col("text").startswith("#EXT-X-STREAM-INF:"))
    a = attributes(F.substring("text", 19, 1 << 20))
    return t.select("file", "line", "url", F.try_element_at(a, F.lit("BANDWIDTH")).try_cast("bigint").alias("bandwidth"), F.try_element_at(a, F.lit("RESOLUTION")).alias("resolution"), F.try_element_at(a, F.lit("CODECS")).alias("codecs"))


def hls_segments(lines: DataFrame) -> DataFrame:
    """(file, seq, url, duration, range_start, range_length, key_uri) of a media playlist: byte ranges run on within one
    address, a key holds until the next."""
    w = W.partitionBy("file").orderBy("line")
    back = w.rowsBetween(W.unboundedPreceding, 0)
    t = lines.where(F.trim("text") != "").select("file", "line", F.trim("text").alias("text"))
    tag = lambda name: F.when(F.col("text").startswith(f"#{name}:"), F.substring("text", len(name) + 3, 1 << 20))
    location = ~F.col("text").startswith("#")
    t = t.withColumn("g", F.sum(location.cast("int")).over(back) - location.cast("int"))
    key = tag("EXT-X-KEY")
    t = t.withColumn("key", F.last(F.when(key.isNotNull(), F.when(F.try_element_at(attributes(key), F.lit("METHOD")) == "NONE", "").otherwise(F.coalesce(F.try_element_at(attributes(key), F.lit("URI")), F.lit("")))), ignorenulls=True).over(back))
    first = F.max(tag("EXT-X-MEDIA-SEQUENCE").try_cast("int")).over(W.partitionBy("file"))
    t = t.withColumn("start", F.coalesce(first, F.lit(0)))
    s = t.groupBy("file", "g").agg(F.max(F.when(location, F.struct("line", F.col("text").alias("url"), "key", "start"))).alias("x"), F.max(F.regexp_extract(tag("EXTINF"), r"^([0-9.]+)", 1).try_cast("double")).alias("duration"), F.max(tag("EXT-X-BYTERANGE")).alias("r"))
    s = s.where("x is not null").select("file", (F.col("g") + F.col("x.start")).alias("seq"), F.col("x.url").alias("url"), "duration", F.regexp_extract("r", r"^(\d+)", 1).try_cast("bigint").alias("range_length"), F.regexp_extract("r", r"@(\d+)$", 1).try_cast("bigint").alias("offset"), F.nullif(F.col("x.key"), F.lit("")).alias("key_uri"))
    per = W.partitionBy("file", "url").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    s = s.withColumn("run", F.count("offset").over(per))
    inner = W.partitionBy("file", "url", "run").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    start = F.coalesce(F.first("offset").over(inner), F.lit(0)) + F.sum("range_length").over(inner) - F.col("range_length")
    return s.select("file", "seq", "url", "duration", F.when(F.col("range_length").isNotNull(), start).alias("range_start"), "range_length", "key_uri")


def pick_renditions(renditions: DataFrame, group: str, url: str, default: Column, *order: str) -> DataFrame:
    """(group, url) of the rendition to play with each group: the default one, else the first, of those with an address."""
    return renditions.where(F.col(url).isNotNull()).groupBy(group).agg(F.min_by(url, F.struct((~default).alias("_d"), *order)).alias(url))


def pick_variant(variants: DataFrame, height: int | None = None) -> DataFrame:
    """One variant a file: the widest bandwidth; with a height, the best that is no taller, else the lowest."""
    tall = F.regexp_extract("resolution", r"x(\d+)$", 1).try_cast("int")
    if height is None:
        rank = F.struct(F.coalesce("bandwidth", F.lit(0)), -F.col("line"))
    else:
        fits = F.coalesce((tall <= height).cast("int"), F.lit(0))
        rank = F.struct(fits, F.when(fits == 1, F.coalesce("bandwidth", F.lit(0))).otherwise(-F.coalesce("bandwidth", F.lit(0))), -F.col("line"))
    return variants.groupBy("file").agg(F.max_by(F.struct("url", "bandwidth", "resolution", "codecs"), rank).alias("v")).select("file", "v.*")
