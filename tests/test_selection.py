"""Probes, markup, selection and comparison on literal rows."""

import json

from pyspark.sql import functions as F

from millrace.functions import markup
from millrace.operators import selection
from millrace.sources import probes


def one(spark, column, schema, *row):
    return spark.createDataFrame([row], schema).select(column).first()[0]


def test_probe_documents(spark):
    doc = {"format": {"duration": "10.0", "bit_rate": "9000"}, "streams": [{"codec_type": "audio", "bit_rate": "1000"}, {"codec_type": "video", "width": 640, "height": 480, "disposition": {"attached_pic": 1}}, {"index": 2, "codec_type": "video", "codec_name": "HEVC", "width": 1920, "height": 1080, "avg_frame_rate": "30000/1001", "pix_fmt": "yuv420p10le", "color_transfer": "smpte2084", "tags": {"rotate": "90"}}]}
    rows = [(0, json.dumps(doc), 100), (1, "no json", 5), (2, None, None), (3, json.dumps({"format": {"duration": "8"}, "streams": [{"codec_type": "video", "width": "100", "height": "50"}]}), 1000)]
    got = probes.read_probes(spark.createDataFrame(rows, "i int, d string, size long"), "d", "size").orderBy("i").collect()
    a, b, c, d = got
    assert (a["codec"], a["width"], a["height"], a["bitrate"], a["bitrate_source"], a["bit_depth"], a["hdr_score"], a["rotation"], a["orientation"]) == ("hevc", 1080, 1920, 8000, "estimated", 10, 2, 90, "vertical")
    assert round(a["fps"], 3) == 29.97 and b["width"] is None and c["codec"] is None
    assert (d["bitrate"], d["bitrate_source"], d["orientation"]) == (1000, "estimated", "horizontal")


def test_probe_cache(spark):
    files = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("c", 3, 3)], "path string, size long, mtime_ns long")
    cache = spark.createDataFrame([("a", 1, 1, 7, "x"), ("b", 9, 2, 7, "y"), ("c", 3, 3, 6, "z")], "path string, size long, mtime_ns long, version int, payload string")
    hits, pending = probes.split_by_cache(files, cache, 7)
    assert [r["payload"] for r in hits.collect()] == ["x"] and {r["path"] for r in pending.collect()} == {"b", "c"}
    nested = spark.createDataFrame([("n", 4, 4, "inner"), ("gone", 1, 1, "no")], "path string, size long, mtime_ns long, payload string")
    live = spark.createDataFrame([("sub/n", 4, 4)], "path string, size long, mtime_ns long")
    own = spark.createDataFrame([("sub/n", 4, 4, None), ("a", 1, 1, "x")], "path string, size long, mtime_ns long, payload string")
    assert {(r["path"], r["payload"]) for r in probes.adopt(own, nested, live, F.lit("sub/"), ["payload"]).collect()} == {("sub/n", "inner"), ("a", "x")}


def test_markup(spark):
    assert one(spark, markup.best_of_srcset(F.col("s")), "s string", "a.jpg 1x, b.jpg 2x, c.jpg 640w") == "b.jpg"
    assert one(spark, markup.full_image(F.col("t")), "t string", '<img src="s.jpg" srcset="a 10w, b 20w" data-large="L.jpg">') == "L.jpg"
    assert one(spark, markup.full_image(F.col("t")), "t string", '<img src="s.jpg" srcset="a 10w, b 20w" data-src="data:x">') == "b"
    assert one(spark, markup.tags(F.col("h"), "img"), "h string", '<p><img src="1"><IMG src="2"/></p>') == ['<img src="1">', '<IMG src="2"/>']
    values = {"site": F.lit("example.com"), "date:YYYY": F.lit("2026"), "stem": F.lit("photo"), "ext": F.lit("jpg"), "w": F.col("w"), "h": F.col("w")}
    assert one(spark, markup.rendered("{site}/{date:YYYY}/{stem}-{w}x{h}.{ext}", values), "w int", 1920) == "example.com/2026/photo-1920x1920.jpg"
    assert one(spark, markup.rendered("{stem}-{w}x{h}.{ext}", values), "w int", None) == "photo.jpg"
    long = one(spark, markup.clamped_path(F.col("p"), 100), "p string", "site/" + "x" * 400 + ".jpg")
    assert len(long) == 100 and long.startswith("site/") and long.endswith(".jpg")
    assert one(spark, markup.markdown_inline(F.col("m")), "m string", "**a** `b<c` [d](e)") == '<strong>a</strong> <code>b&lt;c</code> <a href="e">d</a>'
    assert one(spark, markup.label_matches(F.col("t"), ["load more"], ["less"]), "t string", "Load  MORE (12)") is True
    assert one(spark, markup.conversation_id(F.col("u")), "u string", "https://x/c/0F0f0f0f-1111-2222-3333-444444444444?x") == "0f0f0f0f-1111-2222-3333-444444444444"


def test_sampling(spark):
    assert one(spark, selection.sample_positions(F.col("a"), F.col("b"), 4), "a long, b long", 0, 10) == [0, 2, 5, 7]
    assert one(spark, selection.sample_positions(F.col("a"), F.col("b"), 4), "a long, b long", 3, 3) == []
    assert one(spark, selection.sample_times(F.col("d"), F.col("f")), "d double, f double", None, None) == [0.5]
    assert one(spark, selection.sample_times(F.col("d"), F.col("f")), "d double, f double", 100.0, 25.0) == [10.0, 30.0, 50.0, 70.0, 90.0]
    flags = [True, True, True, False, False, True, False, False, False, True]
    assert one(spark, selection.edge_extent(F.col("x")), "x array<boolean>", flags) == 6
    assert one(spark, selection.edge_extent(F.col("x")), "x array<boolean>", [True, False, False, True]) == 0
    got = one(spark, selection.compare_signatures(F.col("a"), F.col("b")), "a array<long>, b array<long>", [1, None, 7, -1], [1, 5, 5, 0])
    assert got is not None and (got["median"], got["votes"], got["compared"]) == (1.0, 2, 3)


def test_budget_and_names(spark):
    df = spark.createDataFrame([("g", p, i) for i, p in enumerate([3, 3, 2, 2, 2, 2, 1])], "g string, p int, i int")
    assert sorted(r["i"] for r in selection.budgeted(df, ["g"], 5, F.col("p"), F.col("i")).collect()) == [0, 1, 2, 3, 5]
    names = spark.createDataFrame([("a.jpg", 0), ("a.jpg", 1), ("a_2.jpg", 2), ("b", 3)], "n string, i int")
    got = [r["unique_name"] for r in selection.unique_names(names, "n", F.col("i")).collect()]
    assert len(set(got)) == 4 and {"a.jpg", "b"} <= set(got)


def test_joins(spark):
    paths = spark.createDataFrame([("D:/Vault/x/y.mp4",), ("d:/vault2/z",), ("e:/q",)], "path string")
    roots = spark.createDataFrame([("d:/vault", "P:"), ("d:", "Q:")], "root string, mapped string")
    assert {r["path"]: r["mapped"] for r in selection.longest_prefix(paths, roots).collect()} == {"D:/Vault/x/y.mp4": "P:/x/y.mp4", "d:/vault2/z": "Q:/vault2/z", "e:/q": None}
    boxes = [(i, (i * 137) % 1000, (i * 71) % 900, (i * 137) % 1000 + 40 + i * 9, (i * 71) % 900 + 300) for i in range(40)]
    df = spark.createDataFrame(boxes, "id int, x0 int, y0 int, x1 int, y1 int")
    want = {(a[0], b[0]) for a in boxes for b in boxes if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]}
    got = [tuple(r) for r in selection.intersecting(df, df).collect()]
    assert set(got) == want and len(got) == len(want)


def test_download_checks(spark):
    c = F.col
    expr = selection.download_failure(c("s"), c("m"), c("z"), c("e"), c("k"), F.lit(False), F.lit(True), F.lit(None).cast("string"), F.lit(True))
    rows = [("complete", "image/png", 5000, None, "image", None), ("complete", "text/html", 5000, None, "image", "html_response"), ("complete", "image/png", 100, None, "image", "implausible_size"), ("complete", "image/png", 100, 100, "image", None), ("complete", "image/png", 0, None, "image", "zero_bytes"), ("running", None, 0, None, None, "download_interrupted")]
    df = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(rows)], "i int, s string, m string, z long, e long, k string").orderBy("i")
    assert [r[0] for r in df.select(expr).collect()] == [r[5] for r in rows]
