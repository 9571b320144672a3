"""Scalar functions on media facts: buckets, tiers, formats and quality. All are Column expressions; null means unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KB, MB, GB, TB = 1 << 10, 1 << 20, 1 << 30, 1 << 40

# Names and bounds that results must show as they are.
RESOLUTIONS = [
    ("480p", 640, 480), ("720p", 1280, 720), ("1080p", 1920, 1080), ("1440p", 2560, 1440), ("4K", 3840, 2160), ("8K", 7680, 4320),
    ("480p vertical", 480, 640), ("720p vertical", 720, 1280), ("1080p vertical", 1080, 1920), ("1440p vertical", 1440, 2560), ("4K vertical", 2160, 3840), ("8K vertical", 4320, 7680),
]
SNAP_DISTANCE = 400
DURATIONS = [("Under 1 min", 60), ("1-3 min", 180), ("3-5 min", 300), ("5-10 min", 600), ("10-20 min", 1200), ("20-30 min", 1800), ("30-60 min", 3600), ("Over 60 min", None)]
VIDEO_SIZES = [("Under 10 MB", 10 * MB), ("10-50 MB", 50 * MB), ("50-100 MB", 100 * MB), ("100-500 MB", 500 * MB), ("500 MB-1 GB", GB), ("1-5 GB", 5 * GB), ("5-10 GB", 10 * GB), ("Over 10 GB", None)]
IMAGE_SIZES = [("Under 100 KB", 100 * KB), ("100-500 KB", 500 * KB), ("500 KB-1 MB", MB), ("1-5 MB", 5 * MB), ("5-10 MB", 10 * MB), ("10-50 MB", 50 * MB), ("50-100 MB", 100 * MB), ("Over 100 MB", None)]
FRAME_RATES = [("24fps", 23.976), ("24fps", 24.0), ("25fps", 25.0), ("30fps", 29.97), ("30fps", 30.0), ("50fps", 50.0), ("60fps", 59.94), ("60fps", 60.0)]
TIERS = [(30_000_000, 8), (12_000_000, 7), (7_000_000, 6), (3_000_000, 5), (1_700_000, 4), (800_000, 3), (300_000, 2)]
CODEC_WEIGHTS = {
    "h264": 1.0, "avc1": 1.0, "hevc": 1.5, "h265": 1.5, "av1": 1.8, "vp9": 1.4, "vp8": 0.85, "mpeg4": 0.65, "mpeg2video": 0.55, "mpeg1video": 0.45,
    "wmv3": 0.75, "wmv2": 0.65, "vc1": 0.9, "theora": 0.75, "prores": 1.0, "dnxhd": 1.0, "ffv1": 1.0, "huffyuv": 1.0, "rawvideo": 1.0,
}


def half_open_bucket(value: Column, bounds: list[tuple[str, float | None]], unknown: str = "Unknown") -> Column:
    """The name of the first bucket whose upper bound exceeds a value of 0 or more; null and negative are unknown."""
    out = F.when(value.isNull() | (value < 0), unknown)
    for name, upper in bounds:
        out = out.otherwise(name) if upper is None else out.when(value < upper, name)
    return out


def duration_bucket(seconds: Column) -> Column:
    return half_open_bucket(seconds, DURATIONS)


def video_size_bucket(size: Column) -> Column:
    return half_open_bucket(size, VIDEO_SIZES)


def image_size_bucket(size: Column) -> Column:
    return half_open_bucket(size, IMAGE_SIZES)


def nearest_resolution(width: Column, height: Column, points=RESOLUTIONS, snap: float = SNAP_DISTANCE) -> Column:
    """The nearest listed resolution, the first listed of equally near ones, or Other beyond the snap distance."""
    ranked = [F.struct(F.hypot(width - w, height - h).alias("d"), F.lit(k).alias("k"), F.lit(name).alias("name")) for k, (name, w, h) in enumerate(points)]
    best = F.least(*ranked)
    return F.when(best["d"] <= snap, best["name"]).otherwise("Other")


def frame_rate(text: Column) -> Column:
    """``n/d`` or a number as double; null for 0/0, N/A and whatever is no number."""
    parts = F.split(F.trim(text), "/")
    top, bottom = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    return F.when(F.size(parts) == 1, top).when(F.size(parts) == 2, F.try_divide(top, bottom))


def ratio(text: Column) -> Column:
    """``a/b`` or ``a:b`` as a positive finite double, else null."""
    parts = F.split(F.trim(text), "[/:]")
    value = F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.coalesce(F.get(parts, F.lit(1)), F.lit("1")).try_cast("double"))
    return positive(value)


def positive(value: Column) -> Column:
    """The value as double if it is a finite number above 0, else null."""
    x = value.try_cast("double")
    return F.when((x > 0) & ~F.isnan(x) & (x < float("inf")), x)


def frame_rate_bin(fps: Column) -> Column:
    out = F.when(fps.isNull(), "Unknown")
    for name, rate in FRAME_RATES:
        out = out.when(F.abs(fps - rate) < 0.1, name)
    return out.otherwise("Other")


def _scaled(size: Column, unit: int, name: str, exact: bool) -> Column:
    # format_number rounds the exact binary value, halves to even
    return F.concat(F.replace(F.format_number(size / unit, 2), F.lit(","), F.lit("")) if exact else F.floor(size / unit).cast("string"), F.lit(f" {name}"))


def human_size(size: Column) -> Column:
    """Two decimals from KB on; plain bytes below; N/A for null."""
    return _sizes(size, {"TB", "GB", "MB", "KB"})


def human_size_short(size: Column) -> Column:
    """Two decimals for TB and GB, whole MB and KB; plain bytes below; N/A for null."""
    return _sizes(size, {"TB", "GB"})


def _sizes(size: Column, exact: set[str]) -> Column:
    out = F.when(size.isNull(), "N/A")
    for name, unit in (("TB", TB), ("GB", GB), ("MB", MB), ("KB", KB)):
        out = out.when(size >= unit, _scaled(size, unit, name, name in exact))
    return out.otherwise(F.concat(size.cast("bigint").cast("string"), F.lit(" bytes")))


def human_duration(seconds: Column) -> Column:
    s = F.floor(seconds).cast("bigint")
    h, m, rest = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return F.when(seconds.isNull(), "N/A").when(h > 0, F.format_string("%dh %dm %ds", h, m, rest)).when(m > 0, F.format_string("%dm %ds", m, rest)).otherwise(F.format_string("%ds", rest))


def clock_seconds(text: Column) -> Column:
    """``m:ss`` or ``mm:ss`` with seconds below 60 as seconds, else null."""
    t = F.trim(text)
    sec = F.regexp_extract(t, r"^\d{1,2}:(\d{2})$", 1).try_cast("int")
    return F.when(sec <= 59, F.regexp_extract(t, r"^(\d{1,2}):\d{2}$", 1).try_cast("int") * 60 + sec)


def age(seconds: Column) -> Column:
    out = F.when(seconds < 60, F.concat(F.floor(seconds).cast("string"), F.lit("s ago")))
    for limit, unit, mark in ((3600, 60, "m"), (86400, 3600, "h"), (604800, 86400, "d"), (None, 604800, "w")):
        text = F.concat(F.floor(seconds / unit).cast("string"), F.lit(f"{mark} ago"))
        out = out.when(seconds < limit, text) if limit else out.when(seconds.isNotNull(), text)
    return out


def kbps(bits: Column) -> Column:
    return bits / 1000


def rotation(degrees: Column) -> Column:
    """To the nearest quarter turn, halves to even, in 0..270."""
    return F.pmod(F.bround(degrees / 90).cast("int") * 90, F.lit(360))


def resolution_tier(pixels: Column) -> Column:
    out = F
    for least, tier in TIERS:
        out = out.when(pixels >= least, F.lit(tier))
    return out.when(pixels >= 0, F.lit(1)).otherwise(F.lit(0))


def codec_weight(codec: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in CODEC_WEIGHTS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(codec)), F.lit(1.0))


def bits_per_pixel_frame(bitrate: Column, codec: Column, pixels: Column, fps: Column, area: Column) -> Column:
    """Weighted bits per active pixel and frame, at most 10; 0 where the bitrate is unknown. An unknown rate counts as 30
    frames a second, an unknown area as the whole, at least a twentieth."""
    active = F.greatest(F.lit(1.0), pixels * F.least(F.greatest(F.coalesce(area, F.lit(1.0)), F.lit(0.05)), F.lit(1.0)))
    rate = F.coalesce(F.when(fps > 0, fps), F.lit(30.0))
    return F.when(bitrate > 0, F.round(F.least(F.lit(10.0), bitrate * codec_weight(codec) / (active * rate)), 9)).otherwise(F.lit(0.0))


def quality_key(width: Column, height: Column, hdr: Column, depth: Column, bitrate: Column, source: Column, fps: Column, codec: Column, area: Column, size: Column) -> Column:
    """A struct whose descending order ranks files by quality; unknown dimensions rank last, by size."""
    known = (width > 0) & (height > 0)
    pixels = (width.cast("bigint") * height).cast("bigint")
    at = lambda c, kind, other=0: F.when(known, c.cast(kind)).otherwise(F.lit(other).cast(kind))
    rank = F.when(source == "stream", 2).when(source.isin("format", "estimated"), 1).otherwise(0)
    return F.struct(
        at(F.lit(1), "int").alias("known"), at(resolution_tier(pixels), "int").alias("tier"), at(F.coalesce(hdr, F.lit(0)), "int").alias("hdr"),
        at(F.coalesce(F.when(depth > 0, depth), F.lit(8)), "int").alias("depth"), at(pixels, "bigint").alias("pixels"), at((F.coalesce(bitrate, F.lit(0)) > 0).cast("int"), "int").alias("has_bitrate"),
        at(bits_per_pixel_frame(bitrate, codec, pixels, fps, area), "double").alias("bppf"), at(F.round(F.coalesce(fps, F.lit(0.0)), 3), "double").alias("fps"),
        at(rank, "int").alias("source_rank"), at(F.coalesce(bitrate, F.lit(0)), "bigint").alias("bitrate"), F.coalesce(size, F.lit(0)).cast("bigint").alias("size"),
    )


def hdr_label(transfer: Column, side_data: Column) -> Column:
    t = F.lower(F.coalesce(transfer, F.lit("")))
    return F.when(F.lower(F.coalesce(side_data, F.lit(""))).contains("dolby vision"), "Dolby Vision").when(t == "smpte2084", "HDR10").when(t == "arib-std-b67", "HLG").otherwise("SDR")


def hdr_score(transfer: Column, primaries: Column, space: Column) -> Column:
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return F.when(low(transfer).isin("smpte2084", "arib-std-b67"), 2).when((low(primaries) == "bt2020") | low(space).startswith("bt2020"), 1).otherwise(0)


def bit_depth(raw_sample: Column, sample: Column, pixel_format: Column) -> Column:
    """From the sample fields if positive, else from the pixel format's name, else 8."""
    fmt = F.lower(F.coalesce(pixel_format, F.lit("")))
    named = [F.regexp_extract(fmt, p, 1).try_cast("int") for p in (r"p(9|10|12|14|16)(?:le|be)?$", r"^p[024](10|12|14|16)(?:le|be)?$", r"^gray(9|10|12|14|16)(?:le|be)?$")]
    packed = F.when(fmt.rlike(r"^(?:v210|y210(?:le|be)?|r210|x2rgb10(?:le|be)?|x2bgr10(?:le|be)?)$"), 10)
    whole = [F.when(c.try_cast("int") > 0, c.try_cast("int")) for c in (raw_sample, sample)]
    return F.coalesce(*whole, *named, packed, F.lit(8))


def orientation(value: Column, tie: str = "horizontal") -> Column:
    r = positive(value)
    return F.when(r > 1, "horizontal").when(r < 1, "vertical").when(r == 1, tie)


def extinf_seconds(seconds: Column) -> Column:
    """Whole seconds for a playlist line, halves to even; -1 if unknown."""
    return F.coalesce(F.bround(positive(seconds)).cast("bigint"), F.lit(-1))


def clamp(value: Column, default: float, low: float, high: float) -> Column:
    return F.least(F.greatest(F.coalesce(value.try_cast("double"), F.lit(default)), F.lit(low)), F.lit(high))


def analysis_size(width: Column, height: Column, box: int = 320) -> Column:
    """The size that fits a ratio into a square box, with even sides of at least 2."""
    scale = F.least(F.lit(1.0), box / F.greatest(width, height))
    side = lambda x: F.greatest(F.lit(2), (F.floor(x * scale / 2) * 2).cast("int"))
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def median_int(value: Column) -> Column:
    """Aggregate: the exact median as a whole number, halves to even; null values are left out."""
    return F.bround(F.median(value)).cast("bigint")


def cooldown(failures: Column, base: int = 60, most: int = 1800) -> Column:
    return F.when(failures > 0, F.least(F.lit(base) * F.pow(F.lit(2), failures - 1), F.lit(most)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def byte_text(size: Column, largest: str = "GB") -> Column:
    """Bytes, whole KB, MB with one decimal, GB with two; empty for null. ``largest`` (GB or MB) is the last unit: larger
    sizes stay in it."""
    text = F.when(size < KB, F.concat(size.cast("string"), F.lit(" B")))
    rest = (None, MB, "%.1f MB") if largest == "MB" else (GB, MB, "%.1f MB")
    for limit, unit, form in ((MB, KB, "%.0f KB"), rest, *([] if largest == "MB" else [(None, GB, "%.2f GB")])):
        value = F.format_string(form, size / unit)
        text = text.when(size < limit, value) if limit else text.when(size.isNotNull(), value)
    return F.coalesce(text, F.lit(""))


def clock_text(seconds: Column) -> Column:
    """m:ss below an hour, else h:mm:ss; empty for null."""
    m, s = F.floor(seconds / 60), F.lpad(F.floor(F.pmod(seconds, F.lit(60))).cast("string"), 2, "0")
    long = F.concat_ws(":", F.floor(m / 60).cast("string"), F.lpad(F.pmod(m, F.lit(60)).cast("string"), 2, "0"), s)
    return F.when(seconds.isNull(), "").when(m < 60, F.concat_ws(":", m.cast("string"), s)).otherwise(long)


def size_class(width: Column, height: Column) -> Column:
    """large from 1,000 on either edge, medium from 500, else small."""
    edge = F.greatest(width, height)
    return F.when(edge >= 1000, "large").when(edge >= 500, "medium").otherwise("small")


def keeps_existing(new_pixels: Column, new_size: Column, old_pixels: Column, old_size: Column) -> Column:
    """Whether of two copies the existing one stays: it has more pixels, or as many and is no smaller a file."""
    return (old_pixels > new_pixels) | ((old_pixels == new_pixels) & (old_size >= new_size))


def gradient_bits(grid: Column, side: int = 9) -> Column:
    """Two 64-bit masks of a square grid of brightness, row by row: whether each cell is brighter than its right neighbour,
    and than the one below. Null where the grid is flat (brightest less darkest under 6) or of another size."""
    at = lambda y, x: F.get(grid, F.lit(y * side + x))
    cells = [(y, x) for y in range(side - 1) for x in range(side - 1)]

    def mask(dy: int, dx: int) -> Column:
        bits = F.array(*(at(y, x) > at(y + dy, x + dx) for y, x in cells))
        return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b.cast("bigint")))

    usable = (F.size(grid) == side * side) & (F.array_max(grid) - F.array_min(grid) >= 6)
    return F.when(usable, F.struct(mask(0, 1).alias("across"), mask(1, 0).alias("down")))


def frame_usable(samples: Column) -> Column:
    """Whether a frame shows something: its 95th percentile is at least 24 and 8 above its 5th."""
    s, n = F.array_sort(samples), F.size(samples)
    at = lambda q: F.get(F.array_sort(samples), F.floor((n - 1) * q).cast("int"))
    return F.coalesce((F.size(s) > 0) & (at(0.95) >= 24) & (at(0.95) - at(0.05) >= 8), F.lit(False))


def uniform_line(samples: Column, spread: int = 12) -> Column:
    """(uniform, mean) of a line of brightness: its 90th less its 10th percentile is at most ``spread``."""
    n = F.size(samples)
    at = lambda q: F.get(F.array_sort(samples), F.floor((n - 1) * q).cast("int"))
    mean = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x) / n
    return F.struct(F.coalesce(at(0.9) - at(0.1) <= spread, F.lit(False)).alias("uniform"), mean.alias("mean"))


def line_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two lines of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, x: s + x) / F.size(a)
