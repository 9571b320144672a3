"""Media types: kinds, extensions, magic bytes, and the cascade that classifies a request."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Type names, extensions and signatures.
EXTENSIONS = {
    "image/jpeg": "jpg", "image/png": "png", "image/gif": "gif", "image/webp": "webp", "image/avif": "avif", "image/heic": "heic", "image/bmp": "bmp", "image/tiff": "tif", "image/svg+xml": "svg", "image/vnd.microsoft.icon": "ico",
    "video/mp4": "mp4", "video/webm": "webm", "video/quicktime": "mov", "video/x-matroska": "mkv", "video/mp2t": "ts", "video/x-msvideo": "avi", "video/ogg": "ogv",
    "audio/mpeg": "mp3", "audio/mp4": "m4a", "audio/ogg": "ogg", "audio/flac": "flac", "audio/wav": "wav", "audio/x-wav": "wav", "audio/aac": "aac", "audio/webm": "weba", "audio/x-m4a": "m4a",
}
IMAGE_BRANDS = ["avif", "avis", "heic", "heix", "hevc", "hevx", "mif1", "msf1"]
AUDIO_BRANDS = ["M4A ", "M4B ", "M4P "]
SEGMENT_TYPES = ["video/mp2t", "video/iso.segment", "audio/iso.segment", "video/vnd.dlna.mpeg-tts"]
_END = r"(?:$|[?#])"
MANIFEST_URL = rf"(?i)\.(m3u8|mpd){_END}"
SEGMENT_URL = rf"(?i)\.(ts|m4s|m4f|cmfv|cmfa|cmft){_END}"
VIDEO_URL = rf"(?i)\.(mp4|m4v|webm|mov|mkv|avi|ogv|flv|3gp|m2ts){_END}"
AUDIO_URL = rf"(?i)\.(mp3|m4a|aac|ogg|oga|opus|flac|wav|wma|weba){_END}"
IMAGE_URL = rf"(?i)\.(jpe?g|png|gif|webp|avif|bmp|tiff?|heic|svg|ico){_END}"
JUNK_URL = r"(?i)/(?:pixel|beacon|spacer|blank|1x1|tracking)[.\-_]"


def base_type(mime: Column) -> Column:
    return F.lower(F.trim(F.get(F.split(F.coalesce(mime, F.lit("")), ";"), F.lit(0))))


def kind_of(mime: Column) -> Column:
    m = base_type(mime)
    return F.when(m.contains("mpegurl") | m.contains("m3u8") | m.contains("dash+xml"), "stream").when(m.startswith("image/"), "image").when(m.startswith("video/"), "video").when(m.startswith("audio/"), "audio")


def extension_of(mime: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for p in EXTENSIONS.items() for x in p)), base_type(mime))


def is_savable(mime: Column) -> Column:
    return kind_of(mime).isNotNull() | base_type(mime).isin("application/octet-stream", "binary/octet-stream")


def is_manifest(url: Column, mime: Column) -> Column:
    m = base_type(mime)
    return F.coalesce(url, F.lit("")).rlike(MANIFEST_URL) | m.contains("mpegurl") | m.contains("dash+xml")


def is_segment(url: Column, mime: Column) -> Column:
    return base_type(mime).isin(*SEGMENT_TYPES) | F.coalesce(url, F.lit("")).rlike(SEGMENT_URL)


def classify(url: Column, resource: Column, mime: Column) -> Column:
    """(kind, signal) of a request: the first rule that fits, from the scheme to the extension."""
    u, by_type = F.coalesce(url, F.lit("")), kind_of(mime)
    out = lambda kind, signal: F.struct((F.lit(kind) if isinstance(kind, str) or kind is None else kind).cast("string").alias("kind"), F.lit(signal).alias("signal"))
    return (
        F.when(~u.rlike("(?i)^https?:"), out(None, "non-http"))
        .when(u.rlike(JUNK_URL), out(None, "junk"))
        .when(is_manifest(u, mime), out("stream", "manifest"))
        .when(is_segment(u, mime), out("segment", "segment"))
        .when(resource == "media", out(F.when(by_type == "audio", "audio").otherwise("video"), "resource-type-media"))
        .when(resource == "image", out("image", "resource-type-image"))
        .when(by_type.isNotNull(), out(by_type, "content-type"))
        .when(u.rlike(VIDEO_URL), out("video", "extension"))
        .when(u.rlike(AUDIO_URL), out("audio", "extension"))
        .when(u.rlike(IMAGE_URL), out("image", "extension"))
        .otherwise(out(None, "unclassified"))
    )


def header(headers: Column, name: str) -> Column:
    """Value of the first header of array<struct<name, value>> with the name, in any case."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))["value"]


def total_bytes(headers: Column, status: Column) -> Column:
    """The total of Content-Range for a partial response, else Content-Length; null if absent."""
    ranged = F.regexp_extract(F.coalesce(header(headers, "content-range"), F.lit("")), r"/(\d+)\s*$", 1).try_cast("bigint")
    return F.when(status == 206, ranged).otherwise(F.regexp_extract(F.coalesce(header(headers, "content-length"), F.lit("")), r"^\s*(\d+)", 1).try_cast("bigint"))


def sniff(head: Column) -> Column:
    """(mime, kind) by magic bytes of at least 4 leading bytes; null if unknown."""
    x = F.hex(F.substring(head, 1, 192))
    at = lambda pos, text: F.substring(x, 2 * pos + 1, 2 * len(text)) == text.encode("latin-1").hex().upper()
    begins = lambda h: x.startswith(h)
    out = lambda mime, kind: F.struct(F.lit(mime).alias("mime"), F.lit(kind).alias("kind"))
    byte = lambda k: F.conv(F.substring(x, 2 * k + 1, 2), 16, 10).cast("int")
    size = F.conv(F.substring(x, 1, 8), 16, 10).cast("bigint")
    end = F.least(F.octet_length(head).cast("bigint"), F.when((size > 16) & (size < 4096), size).otherwise(32))
    brand = lambda k: F.decode(F.substring(head, k + 1, F.lit(4)), "ISO-8859-1")
    more = F.when(end >= 20, F.transform(F.sequence(F.lit(16).cast("bigint"), end - 4, F.lit(4).cast("bigint")), lambda k: F.decode(F.substring(head, (k + 1).cast("int"), F.lit(4)), "ISO-8859-1"))).otherwise(F.array().cast("array<string>"))
    brands = F.concat(F.array(brand(F.lit(8))), more)
    has = lambda names: F.arrays_overlap(brands, F.array(*map(F.lit, names)))
    iso = F.when((F.octet_length(head) >= 12) & has(IMAGE_BRANDS), F.when(F.exists(brands, lambda b: b.startswith("avi")), out("image/avif", "image")).otherwise(out("image/heic", "image")))
    iso = iso.when((F.octet_length(head) >= 12) & has(AUDIO_BRANDS), out("audio/mp4", "audio")).otherwise(out("video/mp4", "av"))
    text = F.ltrim(F.decode(F.substring(head, 1, 16), "ISO-8859-1"))
    rules = [
        (begins("FFD8FF"), out("image/jpeg", "image")), (begins("89504E470D0A1A0A"), out("image/png", "image")), (at(0, "GIF8"), out("image/gif", "image")), (at(0, "BM"), out("image/bmp", "image")),
        (begins("49492A00") | begins("4D4D002A"), out("image/tiff", "image")), (begins("00000100"), out("image/vnd.microsoft.icon", "image")), (at(0, "RIFF") & at(8, "WEBP"), out("image/webp", "image")),
        (at(4, "ftyp"), iso), (at(0, "FLV"), out("video/x-flv", "video")), (begins("000001BA"), out("video/mpeg", "video")), (at(0, "RIFF") & at(8, "AVI "), out("video/x-msvideo", "video")),
        (begins("47") & (F.substring(x, 377, 2) == "47"), out("video/mp2t", "video")), (begins("1A45DFA3"), out("video/webm", "av")), (at(0, "OggS"), out("audio/ogg", "av")), (at(0, "ID3"), out("audio/mpeg", "audio")),
        ((byte(0) == 255) & (byte(1).bitwiseAND(F.lit(0xE0)) == 0xE0) & (byte(1).bitwiseAND(F.lit(6)) == 2), out("audio/mpeg", "audio")), ((byte(0) == 255) & (byte(1).bitwiseAND(F.lit(0xF6)) == 0xF0), out("audio/aac", "audio")),
        (at(0, "fLaC"), out("audio/flac", "audio")), (at(0, "RIFF") & at(8, "WAVE"), out("audio/wav", "audio")), (at(0, "<!DOCTYPE") | at(0, "<!doctype") | at(0, "<html") | at(0, "<HTML"), out("text/html", "notmedia")),
        (text.startswith("{") | text.startswith("[") | text.startswith("<?xml"), out("application/json", "notmedia")),
    ]
    found = F
    for test, value in rules:
        found = found.when(test, value)
    return F.when(F.octet_length(head) >= 4, found)


def kinds_agree(sniffed: Column, expected: Column) -> Column:
    """Whether a sniffed kind may be what was expected; unknown on either side passes, text never does."""
    timed = expected.isin("video", "audio", "stream")
    return F.when(sniffed.isNull(), True).when(sniffed == "notmedia", False).when(expected.isNull(), True).when(sniffed == "av", timed).when(expected == "stream", sniffed.isin("video", "audio")).otherwise(sniffed == expected)
