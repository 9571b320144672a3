"""Sizes of pictures from the first bytes of their files, and fingerprints of files' ends, in Arrow batches."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType


def _jpeg(head: bytes) -> tuple[int, int] | None:
    """From the frame header, found by walking over the segments before it."""
    at = 2
    while at + 9 <= len(head):
        if head[at] != 0xFF:
            return None
        mark = head[at + 1]
        if mark == 0xFF:  # fill
            at += 1
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(head[at + 7 : at + 9], "big"), int.from_bytes(head[at + 5 : at + 7], "big")
        elif mark == 0x01 or 0xD0 <= mark <= 0xD8:
            at += 2
        else:
            at += 2 + int.from_bytes(head[at + 2 : at + 4], "big")
    return None


def _webp(head: bytes) -> tuple[int, int] | None:
    little = lambda a, b: int.from_bytes(head[a:b], "little")
    kind = head[12:16]
    if kind == b"VP8X" and len(head) >= 30:
        return little(24, 27) + 1, little(27, 30) + 1
    if kind == b"VP8L" and len(head) >= 25:
        packed = little(21, 25)
        return (packed & 0x3FFF) + 1, (packed >> 14 & 0x3FFF) + 1
    if kind == b"VP8 " and len(head) >= 30:
        return little(26, 28) & 0x3FFF, little(28, 30) & 0x3FFF
    return None


def dimensions(head: bytes | None) -> tuple[str, int, int] | None:
    """(format, width, height) of a picture by the start of its file; None if it is none of the known ones or cut off."""
    head = bytes(head or b"")
    found = None
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24:
        found = "png", int.from_bytes(head[16:20], "big"), int.from_bytes(head[20:24], "big")
    elif head[:4] == b"GIF8" and len(head) >= 10:
        found = "gif", int.from_bytes(head[6:8], "little"), int.from_bytes(head[8:10], "little")
    elif head[:2] == b"BM" and len(head) >= 26:
        found = "bmp", abs(int.from_bytes(head[18:22], "little", signed=True)), abs(int.from_bytes(head[22:26], "little", signed=True))
    elif head[:3] == b"\xff\xd8\xff":
        found = ("jpeg", *size) if (size := _jpeg(head)) else None
    elif head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        found = ("webp", *size) if (size := _webp(head)) else None
    return found if found and found[1] > 0 and found[2] > 0 else None


@F.pandas_udf(StructType([StructField("format", StringType()), StructField("width", IntegerType()), StructField("height", IntegerType())]))
def header_size(head: pd.Series) -> pd.DataFrame:
    """:func:`dimensions` of the first bytes of files; nulls for what is no picture."""
    rows = [dimensions(h) or (None, None, None) for h in head]
    return pd.DataFrame(rows, columns=["format", "width", "height"]).astype({"width": "Int32", "height": "Int32"})


def edge_digest(content: bytes, most: int) -> str:
    """BLAKE2b, 16 bytes in hex, of a file's size, its first ``most`` bytes and, if there are more, its last."""
    h = hashlib.blake2b(len(content).to_bytes(8, "little"), digest_size=16)
    h.update(content[:most])
    if len(content) > most:
        h.update(content[-most:])
    return h.hexdigest()


def edge_fingerprint(most: int):
    """The pandas UDF of :func:`edge_digest` over binary contents; null for null."""

    @F.pandas_udf(StringType())
    def digest(content: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else edge_digest(bytes(c), most) for c in content], dtype=object)

    return digest
