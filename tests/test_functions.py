"""Scalar functions and sources on the fixture rows."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import hashes, media, mime, urls
from millrace.functions.names import stem
from millrace.sources import playlists


def values(spark, rows, schema, *columns):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").orderBy("i")
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.select(*columns).collect()]


def test_buckets(spark):
    got = values(spark, [(10485760, 1920, 1080), (10485759, 1600, 900), (-1, 0, 0), (None, 3000, 1440)], "b long, w int, h int", media.video_size_bucket(F.col("b")), media.nearest_resolution(F.col("w"), F.col("h")))
    assert got == [("10-50 MB", "1080p"), ("Under 10 MB", "720p"), ("Unknown", "Other"), ("Unknown", "Other")]


def test_rates_and_sizes(spark):
    assert values(spark, [("30000/1001",), ("0/0",), ("N/A",), ("25",)], "t string", F.round(media.frame_rate(F.col("t")), 5)) == [29.97003, None, None, 25.0]
    assert values(spark, [(23.98,), (29.97,), (120.0,), (None,)], "x double", media.frame_rate_bin(F.col("x"))) == ["24fps", "30fps", "Other", "Unknown"]
    assert values(spark, [(1536,)], "b long", media.human_size_short(F.col("b")), media.human_size(F.col("b"))) == [("1 KB", "1.50 KB")]
    assert values(spark, [(45.0,), (135.0,), (-90.0,), (270.0,)], "r double", media.rotation(F.col("r"))) == [0, 180, 270, 270]
    assert values(spark, [("1:05",), ("1:75",), ("12:34:56",)], "t string", media.clock_seconds(F.col("t"))) == [65, None, None]
    assert values(spark, [(1,), (2,), (3,), (6,)], "n int", media.cooldown(F.col("n"))) == [60, 120, 240, 1800]
    assert values(spark, [("x", "Dolby Vision"), ("smpte2084", None), ("arib-std-b67", ""), (None, None)], "t string, s string", media.hdr_label(F.col("t"), F.col("s"))) == ["Dolby Vision", "HDR10", "HLG", "SDR"]
    quality = media.bits_per_pixel_frame(F.col("b"), F.lit("hevc"), F.lit(1920 * 1080), F.lit(30.0), F.lit(1.0))
    assert values(spark, [(8_000_000,)], "b long", quality) == [pytest.approx(0.192901, abs=1e-6)]
    assert values(spark, [("yuv420p10le",), ("p010le",), ("gray12",), ("v210",), ("yuv420p",)], "f string", media.bit_depth(F.lit(None).cast("string"), F.lit("0"), F.col("f"))) == [10, 10, 12, 10, 8]


def test_hashes(spark):
    rows = [("0f0f0f0f0f0f0f0f", "0f0f0f0f0f0f0f0f"), ("ffffffffffffffff", "0000000000000000"), ("0f0f0f0f0f0f0f0f", "0e0f0f0f0f0f0f0f"), (None, "ffffffffffffffff"), ("abc", "abcdef0123456789")]
    assert values(spark, rows, "a string, b string", hashes.hamming_hex(F.col("a"), F.col("b"))) == [0, 64, 1, 64, 64]
    assert values(spark, rows, "a string, b string", hashes.hamming_hex(F.col("a"), F.col("b"), None))[3:] == [None, None]
    assert hashes.radius(0.5) >= 32 and hashes.radius(1.0) == 0
    schema = "v string, m string, p double, n int, a double, b double, r double, k int, l int"
    rows = [("none", "phash_only", 1.0, 0, 0.0, 0.0, float("inf"), 500, 500), ("none", "none", 1.0, 0, 0.0, 0.0, float("inf"), 0, 0), ("pixel_exact", "identity", 1.0, 0, 1.0, 1.0, 0.0, 9, 9)]
    c = F.col
    label = hashes.pair_label(c("v"), c("m"), c("p"), c("n"), c("a"), c("b"), c("r"), c("k"), c("l"))
    score = hashes.composite_score(c("v"), c("m"), c("p"), c("a"), c("b"), c("n"), c("r"))
    assert values(spark, rows, schema, label, score) == [("different", 0.0), ("different", 0.0), ("duplicate", 1.0)]


def test_media_types(spark):
    u = "https://x.com/"
    rows = [("a", "media", "audio/mpeg", "audio"), ("a", "media", "video/mp4", "video"), ("a", "media", None, "video"), ("a", "media", "application/octet-stream", "video"), ("p/master.m3u8?tok=1", "xmlhttprequest", "application/octet-stream", "stream")]
    rows += [("p/index", "xmlhttprequest", "audio/x-mpegurl", "stream"), ("p/seg-00042.ts", "xmlhttprequest", "video/mp2t", "segment"), ("p/seg-00042.m4s", "xmlhttprequest", "video/mp4", "segment"), ("p/chunk?n=3", "xmlhttprequest", "video/iso.segment", "segment"), ("p/full.mp4", "xmlhttprequest", "video/mp4", "video"), ("song.aac", "media", "audio/aac", "audio")]
    got = values(spark, [(u + a, b, c) for a, b, c, _ in rows], "u string, t string, m string", mime.classify(F.col("u"), F.col("t"), F.col("m"))["kind"])
    assert got == [r[3] for r in rows]
    heads = [(bytes.fromhex("ffd8ffe0"), "image"), (bytes.fromhex("89504e470d0a1a0a"), "image"), (b"GIF89a", "image"), (bytes.fromhex("1a45dfa301"), "av"), (b"OggS", "av"), (bytes.fromhex("fffb9000"), "audio"), (bytes.fromhex("fff15080"), "audio")]
    heads += [(b"\0\0\0\x18ftypM4A \0\0\0\0", "audio"), (b"\0\0\0\x18ftypavif\0\0\0\0", "image"), (b"\0\0\0\x18ftypmp42\0\0\0\0", "av"), (b"<!DOCTYPE html>", "notmedia"), (b'{"error": 1}', "notmedia"), (b"zzzz", None)]
    assert values(spark, [(h,) for h, _ in heads], "h binary", mime.sniff(F.col("h"))["kind"]) == [k for _, k in heads]
    headers = [([("Content-Range", "bytes 0-1048575/734003200")], 206), ([("content-length", "1048576")], 200), ([("content-length", "1048576")], 206), ([], 200)]
    assert values(spark, headers, "h array<struct<name:string,value:string>>, s int", mime.total_bytes(F.col("h"), F.col("s"))) == [734003200, 1048576, None, None]


def test_urls(spark):
    pairs = [("https://cdn.example.com/img?id=123", "https://cdn.example.com/img?id=456", False), ("https://cdn.x.com/a.jpg?id=7&X-Amz-Signature=deadbeef&Expires=99999", "https://cdn.x.com/a.jpg?id=7", True), ("https://x.com/a?b=2&a=1", "https://x.com/a?a=1&b=2", True), ("https://x.com/resize/300x200/photo.jpg", "https://x.com/photo.jpg", True), ("http://x.com/a.jpg", "https://x.com/a.jpg", True)]
    assert values(spark, [p[:2] for p in pairs], "a string, b string", urls.media_key(F.col("a")) == urls.media_key(F.col("b"))) == [p[2] for p in pairs]
    assert values(spark, [("https://images.bbc.co.uk/x",), ("https://cdn.example.com/x",)], "u string", urls.site(F.col("u"))) == ["bbc.co.uk", "example.com"]
    names = [('a<b>c:d"e/f\\g|h?i*j', "a_b_c_d_e_f_g_h_i_j"), ("CON", "_CON"), ("com1.jpg", "_com1.jpg"), ("console.jpg", "console.jpg"), ("name.  ", "name"), ("///", "___"), ("", "file"), (None, "file")]
    assert values(spark, [(n,) for n, _ in names], "n string", urls.safe_name(F.col("n"))) == [w for _, w in names]
    assert values(spark, [("My Clip (2).MP4",)], "n string", stem(F.col("n"))) == ["myclip2"]


def test_playlists(spark):
    lines = ["#EXTM3U", "#EXT-X-MEDIA-SEQUENCE:7", '#EXT-X-KEY:METHOD=AES-128,URI="k1"', "#EXTINF:9.9,", "#EXT-X-BYTERANGE:1000@0", "a.ts", "#EXTINF:10.0,", "#EXT-X-BYTERANGE:2000", "a.ts", '#EXT-X-KEY:METHOD=AES-128,URI="k2"', "#EXT-X-BYTERANGE:50@9000", "a.ts", "#EXT-X-ENDLIST"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)], "file string, line int, text string")
    got = [tuple(r) for r in playlists.hls_segments(df).orderBy("seq").select("seq", "duration", "range_start", "range_length", "key_uri").collect()]
    assert got == [(7, 9.9, 0, 1000, "k1"), (8, 10.0, 1000, 2000, "k1"), (9, None, 9000, 50, "k2")]
    master = ["#EXTM3U", '#EXT-X-STREAM-INF:BANDWIDTH=800000,RESOLUTION=640x360,CODECS="avc1.4d401f,mp4a.40.2"', "low.m3u8", "#EXT-X-STREAM-INF:BANDWIDTH=4000000,RESOLUTION=1920x1080", "high.m3u8"]
    v = playlists.hls_variants(spark.createDataFrame([("m", i, t) for i, t in enumerate(master)], "file string, line int, text string"))
    assert [r["codecs"] for r in v.orderBy("line").collect()] == ["avc1.4d401f,mp4a.40.2", None]
    assert [playlists.pick_variant(v, h).first()["resolution"] for h in (None, 720, 240)] == ["1920x1080", "640x360", "640x360"]
    e = playlists.entries(spark.createDataFrame([("p", i, t) for i, t in enumerate(["#EXTM3U", "#EXTINF:1,x", "x.mp4", "", "y.mp4", "#tail"])], "file string, line int, text string"))
    assert [(r["location"], r["comments"]) for r in e.orderBy("line").collect()] == [("x.mp4", ["#EXTINF:1,x"]), ("y.mp4", [])]
    merged = playlists.merge_entries(spark.createDataFrame([(0, 0, "x"), (0, 1, "y"), (1, 0, "Y"), (1, 1, "z")], "source int, line int, location string"))
    assert [r["location"] for r in merged.orderBy("source", "line").collect()] == ["x", "y", "z"]
