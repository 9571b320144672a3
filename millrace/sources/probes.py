"""Probe documents (JSON of formats and streams) as columns, and snapshots of probes keyed by file facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import media

_STREAM = (
    "struct<index:int, codec_type:string, codec_name:string, width:string, height:string, duration:string, bit_rate:string, avg_frame_rate:string, r_frame_rate:string, pix_fmt:string, bits_per_raw_sample:string, bits_per_sample:string, "
    "color_transfer:string, color_primaries:string, color_space:string, sample_aspect_ratio:string, display_aspect_ratio:string, tags:map<string,string>, disposition:map<string,int>, side_data_list:array<map<string,string>>>"
)
SCHEMA = f"struct<format:struct<duration:string, bit_rate:string, tags:map<string,string>>, streams:array<{_STREAM}>>"


def _whole(c: Column) -> Column:
    return media.positive(c).cast("bigint")


def _rate(s: Column) -> Column:
    """A stream's bits per second: its own field, else the first of its tags that holds a number."""
    return F.coalesce(_whole(s["bit_rate"]), *(_whole(F.try_element_at(s["tags"], F.lit(t))) for t in ("BPS", "BPS-eng", "BPS_ENG", "bps")))


def video_stream(streams: Column) -> Column:
    """The stream to look at: of video streams that are no attached picture the first default one, else the first."""
    usable = F.filter(streams, lambda s: (s["codec_type"] == "video") & (F.coalesce(F.try_element_at(s["disposition"], F.lit("attached_pic")), F.lit(0)) == 0))
    default = F.filter(usable, lambda s: F.coalesce(F.try_element_at(s["disposition"], F.lit("default")), F.lit(0)) != 0)
    return F.coalesce(F.get(default, F.lit(0)), F.get(usable, F.lit(0)))


def read_probes(df: DataFrame, document: str, size: str) -> DataFrame:
    """Adds duration, codec, width, height, bitrate and its source, fps, bit_depth, hdr_score, rotation, display_ratio and
    orientation. What the document does not say is null; a document that is no JSON gives nulls."""
    d = df.withColumn("_d", F.from_json(document, SCHEMA)).withColumn("_v", video_stream(F.col("_d.streams")))
    v, f = F.col("_v"), F.col("_d.format")
    duration = F.coalesce(media.positive(f["duration"]), media.positive(v["duration"]))
    sound = F.aggregate(F.filter(F.col("_d.streams"), lambda s: s["codec_type"] == "audio"), F.lit(0).cast("bigint"), lambda a, s: a + F.coalesce(_rate(s), F.lit(0)))
    total = F.coalesce(_whole(f["bit_rate"]), F.floor(F.try_divide(F.col(size) * 8.0, duration)))
    guessed = F.when((sound > 0) & (total > sound), total - sound).otherwise(total)
    source = F.when(_rate(v).isNotNull(), "stream").when(total.isNull(), None).when(_whole(f["bit_rate"]).isNotNull() & ~((sound > 0) & (total > sound)), "format").otherwise("estimated")
    fps = F.coalesce(media.ratio(v["avg_frame_rate"]), media.ratio(v["r_frame_rate"]))
    turn = F.coalesce(F.try_element_at(v["tags"], F.lit("rotate")).try_cast("double"), F.try_element_at(f["tags"], F.lit("rotate")).try_cast("double"), F.get(F.filter(F.transform(v["side_data_list"], lambda s: F.try_element_at(s, F.lit("rotation")).try_cast("double")), lambda x: x.isNotNull()), F.lit(0)), F.lit(0.0))
    w, h = _whole(v["width"]), _whole(v["height"])
    sized = w.isNotNull() & h.isNotNull()
    rotation = F.when(sized, media.rotation(turn))
    wide = F.coalesce(media.ratio(v["display_aspect_ratio"]), w * F.coalesce(media.ratio(v["sample_aspect_ratio"]), F.lit(1.0)) / h)
    sideways = rotation.isin(90, 270)
    ratio = F.when(sized, F.when(sideways, 1 / wide).otherwise(wide))
    out = {
        "duration": duration, "codec": F.lower(v["codec_name"]), "width": F.when(sized, F.when(sideways, h).otherwise(w)), "height": F.when(sized, F.when(sideways, w).otherwise(h)),
        "bitrate": F.when(sized, F.coalesce(_rate(v), guessed)), "bitrate_source": F.when(sized, source), "fps": F.when(sized & (fps <= 240), fps),
        "bit_depth": F.when(sized, media.bit_depth(v["bits_per_raw_sample"], v["bits_per_sample"], v["pix_fmt"])), "hdr_score": F.when(sized, media.hdr_score(v["color_transfer"], v["color_primaries"], v["color_space"])),
        "rotation": rotation, "display_ratio": ratio, "orientation": media.orientation(ratio),
    }
    return d.withColumns(out).drop("_d", "_v")


def split_by_cache(files: DataFrame, cache: DataFrame, version: int, keys=("path", "size", "mtime_ns")) -> tuple[DataFrame, DataFrame]:
    """(hits, pending): files whose facts and version match a cached row, with its payload, and those to be probed."""
    valid = cache.where(F.col("version") == version)
    return files.join(valid, list(keys)), files.join(valid, list(keys), "left_anti")


def latest_rows(cache: DataFrame, keys: list[str], written: str) -> DataFrame:
    """An append-only cache as its newest row for each key."""
    return cache.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in cache.columns if c not in keys)), written).alias("r")).select(*keys, "r.*")


def adopt(cache: DataFrame, nested: DataFrame, live: DataFrame, prefix: Column, payloads: list[str]) -> DataFrame:
    """A cache with the rows of a nested one: keys are rebased by the prefix, rows whose size and time match a live file
    come in, and where both hold a row the gaps of the outer one are filled."""
    moved = nested.withColumn("path", F.concat(prefix, "path")).join(live.select("path", "size", "mtime_ns"), ["path", "size", "mtime_ns"], "left_semi")
    inner = moved.select("path", "size", "mtime_ns", *(F.col(p).alias(f"_{p}") for p in payloads))
    both = cache.join(inner, ["path", "size", "mtime_ns"], "full_outer")
    return both.select("path", "size", "mtime_ns", *(F.coalesce(p, f"_{p}").alias(p) for p in payloads))


def prune(cache: DataFrame, live: DataFrame, key: str = "path") -> DataFrame:
    return cache.join(live.select(key), key, "left_semi")


def changed_since(records: DataFrame, listing: DataFrame) -> DataFrame:
    """Adds why a record no longer holds, in order: missing, size, time, content; null while it does."""
    now = listing.select("path", F.col("size").alias("_s"), F.col("mtime_ns").alias("_t"), F.col("sha256").alias("_h"), F.lit(True).alias("_e"))
    reason = F.when(F.col("_e").isNull(), "missing").when(F.col("_s") != F.col("size"), "size").when(F.col("_t") != F.col("mtime_ns"), "time").when(F.col("_h") != F.col("sha256"), "content")
    return records.join(now, "path", "left").withColumn("changed", reason).drop("_s", "_t", "_h", "_e")
