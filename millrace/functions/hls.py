"""HLS facts: protection, initialisation vectors, tracks, ranges and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Key formats of protection systems, and the codec names that stand for video and for audio.
SYSTEMS = [("urn:uuid:edef8ba9-79d6-4ace-a3c8-27dcd51d21ed", "Widevine"), ("urn:uuid:9a04f079-9840-4286-ab92-e65be0885f95", "PlayReady"), ("com.apple.streamingkeydelivery", "FairPlay")]
VIDEO_CODECS = "avc1|avc3|hvc1|hev1|hev2|vp09|vp8|vp9|av01|dvh1|dvhe|mp4v|theora"
AUDIO_CODECS = "mp4a|ac-3|ec-3|opus|vorbis|flac|alac|mp3|ac-4"


def protection(attributes: Column) -> Column:
    """The protection system of a key's attributes, by key format, then by method; plain AES-128 is none."""
    of = lambda name: F.coalesce(F.try_element_at(attributes, F.lit(name)), F.lit(""))
    out = F
    for urn, name in SYSTEMS:
        out = out.when(F.lower(of("KEYFORMAT")).contains(urn), F.lit(name))
    return out.when(F.upper(of("METHOD")).isin("SAMPLE-AES", "SAMPLE-AES-CTR"), F.lit("SAMPLE-AES"))


def initial_vector(iv: Column, sequence: Column) -> Column:
    """16 bytes as lower-case hex: the given ones, else the sequence number, big-endian."""
    given = F.rpad(F.regexp_replace(F.lower(iv), "^0x", ""), 32, "0")
    return F.coalesce(F.nullif(given, F.lit("0" * 32)), F.lower(F.lpad(F.hex(F.pmod(sequence.cast("bigint"), F.lit(1 << 32))), 32, "0")))


def has_video(codecs: Column) -> Column:
    """Whether codecs name a video track; without codecs there may be one."""
    return F.coalesce(F.nullif(codecs, F.lit("")).rlike(rf"(?i)\b({VIDEO_CODECS})"), F.lit(True))


def has_audio(codecs: Column) -> Column:
    return F.coalesce(F.nullif(codecs, F.lit("")).rlike(rf"(?i)\b({AUDIO_CODECS})"), F.lit(True))


def range_header(text: Column) -> Column:
    """``length@offset`` as the value of a Range header; null if it is none."""
    size, start = (F.regexp_extract(text, r"^(\d+)@(\d+)$", k).try_cast("bigint") for k in (1, 2))
    return F.concat(F.lit("bytes="), start.cast("string"), F.lit("-"), (start + size - 1).cast("string"))


def estimated_bytes(bandwidth: Column, seconds: Column) -> Column:
    return F.when((bandwidth > 0) & (seconds > 0), F.round(bandwidth / 8 * seconds).cast("bigint"))
