"""Pictures' headers, file fingerprints, publishing, stale files, playlists as files."""

import hashlib
import random
import struct

from pyspark.sql import functions as F

from millrace.functions import images, urls
from millrace.operators import reports, sets
from millrace.plans.materialize import delete_stale
from millrace.sources import playlists


def test_picture_sizes(spark):
    riff = lambda kind, rest: b"RIFF\0\0\0\0WEBP" + kind + b"\0\0\0\0" + rest
    heads = {
        b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480): ("png", 640, 480),
        b"GIF89a" + struct.pack("<HH", 7, 9): ("gif", 7, 9),
        b"BM" + b"\0" * 16 + struct.pack("<ii", 30, -20): ("bmp", 30, 20),
        b"\xff\xd8\xff\xe0\0\x06JFIF\xff\xff\xdb\0\x03\0\xff\xc4\0\x02\xff\xc2\0\x11\x08" + struct.pack(">HH", 12, 34) + b"\3": ("jpeg", 34, 12),
        riff(b"VP8X", b"\0" * 4 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")): ("webp", 100, 50),
        riff(b"VP8L", b"\x2f" + ((639) | (479 << 14)).to_bytes(4, "little")): ("webp", 640, 480),
        riff(b"VP8 ", b"\0" * 6 + struct.pack("<HH", 320 | 1 << 14, 200)): ("webp", 320, 200),
        b"\xff\xd8\xff\xe0\0\x10cut": None, b"\x89PNG\r\n\x1a\n\0": None, b"": None, b"%PDF-1.4 and so on": None, b"GIF89a\0\0\0\0": None, b"\xff\xd8\xff\xd9" + b"\0" * 20: None,
    }
    for head, want in heads.items():
        assert images.dimensions(head) == want
    rows = spark.createDataFrame([(k, bytearray(h)) for k, h in enumerate(heads)] + [(99, None)], "k int, head binary")
    got = {r["k"]: tuple(r["s"]) for r in rows.select("k", images.header_size("head").alias("s")).collect()}
    assert got == {**{k: w or (None,) * 3 for k, w in enumerate(heads.values())}, 99: (None,) * 3}


def test_edge_fingerprints(spark):
    rng = random.Random(1)
    contents = [b"", b"a", rng.randbytes(64), rng.randbytes(65), rng.randbytes(5000)]

    def plain(c):
        return hashlib.blake2b(len(c).to_bytes(8, "little") + c[:64] + (c[-64:] if len(c) > 64 else b""), digest_size=16).hexdigest()

    df = spark.createDataFrame([(k, bytearray(c)) for k, c in enumerate(contents)] + [(9, None)], "k int, c binary")
    got = {r["k"]: r["f"] for r in df.select("k", images.edge_fingerprint(64)("c").alias("f")).collect()}
    assert got == {**{k: plain(c) for k, c in enumerate(contents)}, 9: None}


def test_a_broken_publication_is_undone(spark, tmp_path):
    one, two = spark.range(1), spark.range(2)
    target = f"{tmp_path}/report"
    assert reports.publish(one, target, one, one) and reports.publish(two, target, one, one)
    assert spark.read.parquet(target).count() == 2 and sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["report"]
    (tmp_path / "report").rename(tmp_path / "report.before")  # it broke off here
    assert reports.recovered(spark, target) and not reports.recovered(spark, target) and spark.read.parquet(target).count() == 2
    (tmp_path / "report").rename(tmp_path / "report.before")
    assert not reports.publish(one, target, one, two) and spark.read.parquet(target).count() == 2


def test_stale_files_go(spark, tmp_path):
    for name in ("a.m3u", "b.m3u", "keep.m3u", "other.txt"):
        (tmp_path / name).write_text("x")
    assert delete_stale(spark, str(tmp_path), ["keep.m3u"], ".m3u") == ["a.m3u", "b.m3u"]
    assert {p.name for p in tmp_path.iterdir()} >= {"keep.m3u", "other.txt"} and delete_stale(spark, f"{tmp_path}/none", []) == []


def test_playlists_as_files(spark, tmp_path):
    rows = [("one", k, f"line {k}") for k in range(300)] + [("é two", 1, "ü"), ("é two", 0, "")]
    playlists.write_files(spark.createDataFrame(rows, "p string, k int, t string").repartition(7), f"{tmp_path}/out", "p", "t", "k")
    got = playlists.read_lines(spark, f"{tmp_path}/out/*/*.txt").where("text <> ''").select("file", "line", "text").collect()
    assert sorted((r["line"], r["text"]) for r in got if "one" in r["file"]) == [(k, f"line {k}") for k in range(300)]
    assert [(r["line"], r["text"]) for r in got if "two" in r["file"]] == [(1, "ü")]
    (tmp_path / "old.m3u").write_bytes("﻿a\r\nb\rc".encode() + b"\n")
    (tmp_path / "latin.m3u").write_bytes(b"caf\xe9\n")
    read = {(r["file"].rsplit("/")[-1], r["line"]): r["text"] for r in playlists.read_lines(spark, f"{tmp_path}/*.m3u").collect()}
    assert read["old.m3u", 0] == "a" and read["old.m3u", 2] == "c" and read["latin.m3u", 0] == "café"


def test_small_sets(spark):
    a, b = spark.createDataFrame([("X",), ("y",), (None,)], "p string"), spark.createDataFrame([("x",), (None,)], "p string")
    assert sets.have_common(a, b, F.lower("p")) and not sets.have_common(a, b, F.col("p"))
    assert [r["p"] for r in sets.reconciled(a, b.select(F.upper("p").alias("p")), "p").collect()] == ["X"]
    hashed = spark.createDataFrame([("\U0001f600",), ("",), (None,)], "t string").select(urls.text_hash(F.col("t")).alias("h")).collect()
    value = 0
    for unit in (0xD83D, 0xDE00):  # code units, as two
        value = (value * 31 + unit + (1 << 31)) % (1 << 32) - (1 << 31)
    digits, n = "", abs(value)
    while n:
        digits, n = "0123456789abcdefghijklmnopqrstuvwxyz"[n % 36] + digits, n // 36
    assert [r["h"] for r in hashed] == [digits, "0", None]
