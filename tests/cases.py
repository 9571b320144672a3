"""Small tables by functions and operators, with the rows that they must give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import entries, hashes, hls, library, markup, media, mime, names, urls
from millrace.operators import duplicates, instances, reports, selection, sets, tree
from millrace.sources import playlists, probes

#: name: (schema, rows, what makes the result, its columns, the rows it must have)
CASES: dict[str, tuple] = {}


def literal(name: str, schema: str, rows: list[tuple], make: Callable[[DataFrame], DataFrame], out: str, want: list[tuple]) -> None:
    CASES[name] = (schema, rows, make, [c.split(" ") for c in out.split(", ")], want)


def columns(made: Callable[[], dict[str, Column]]) -> Callable[[DataFrame], DataFrame]:
    """Adds columns; made when a session is there, so that this module needs none to be imported."""
    return lambda df: df.select("*", *(c.alias(n) for n, c in made().items()))
def over(name: str, kind: str, values: list, out_type: str, function: Callable[[Column], Column], want: list) -> None:
    """``function`` of each value: (value, result)."""
    literal(name, f"k int, value {kind}", list(enumerate(values)), lambda df: df.select("k", function(F.col("value")).alias("result")), f"k int, result {out_type}", list(enumerate(want)))
_MIMES = ["image/JPEG; charset=x", "video/mp4", "audio/mpegurl", "application/dash+xml", "audio/mpeg", "text/html", None, "application/octet-stream", "application/vnd.apple.mpegurl"]
over("mime_kind", "string", _MIMES, "string", mime.kind_of, ["image", "video", "stream", "stream", "audio", None, None, None, "stream"])
over("mime_extension", "string", _MIMES, "string", mime.extension_of, ["jpg", "mp4", None, None, "mp3", None, None, None, None])
over("mime_savable", "string", _MIMES, "boolean", mime.is_savable, [True, True, True, True, True, False, False, True, True])
literal(
    "segment_and_manifest", "k int, url string, type string",
    [(0, "https://a/x.ts?y=1", None), (1, "https://a/x.m3u8", None), (2, "https://a/x", "video/MP2T"), (3, "https://a/x", "application/x-mpegURL"), (4, "https://a/x.mpd#t", None), (5, "https://a/tsunami", "video/mp4"), (6, None, "video/iso.segment")],
    columns(lambda: dict(segment=mime.is_segment(F.col("url"), F.col("type")), manifest=mime.is_manifest(F.col("url"), F.col("type")))), "k int, segment boolean, manifest boolean",
    [(0, True, False), (1, False, True), (2, True, False), (3, False, True), (4, False, True), (5, False, False), (6, True, False)],
)
_HEADS = ["ffd8ffe0", "89504e470d0a1a0a", "474946383961", "424d0000", "49492a00", "00000100", "52494646000000005745425000", "0000001c66747970617669660000000061766966", "0000002066747970697361390000000069736f6d4d344120", "000000186674797069736f6d000002006d703431", "1a45dfa3", "4f676753", "49443304", "fffb9000", "fff15080", "664c6143", "524946460000000057415645", "3c21444f43545950452068746d6c3e", "7b226122", "010203", "01020304"]
over(
    "magic_bytes", "string", _HEADS, "string", lambda v: F.concat_ws(" ", mime.sniff(F.unhex(v))["mime"], mime.sniff(F.unhex(v))["kind"]),
    ["image/jpeg image", "image/png image", "image/gif image", "image/bmp image", "image/tiff image", "image/vnd.microsoft.icon image", "image/webp image", "image/avif image", "audio/mp4 audio", "video/mp4 av", "video/webm av", "audio/ogg av", "audio/mpeg audio", "audio/mpeg audio", "audio/aac audio", "audio/flac audio", "audio/wav audio", "text/html notmedia", "application/json notmedia", "", ""],
)
literal(
    "kind_agreement", "k int, seen string, expected string", [(0, "image", "image"), (1, "av", "audio"), (2, "av", "image"), (3, None, "video"), (4, "notmedia", None), (5, "video", "stream"), (6, "image", None), (7, "audio", "video")],
    columns(lambda: dict(agrees=mime.kinds_agree(F.col("seen"), F.col("expected")))), "k int, agrees boolean", [(0, True), (1, True), (2, False), (3, True), (4, False), (5, True), (6, True), (7, False)],
)
over("status_codes", "int", [401, 404, 429, 500, 503, 418, 403], "string", selection.status_failure, ["http_401", "http_404", "http_429", "http_5xx", "http_5xx", "network_error", "http_403"])
literal(
    "header_totals", "k int, status int, headers array<struct<name:string,value:string>>",
    [(0, 206, [("content-range", "bytes 0-1023/5000"), ("Content-Length", "1024")]), (1, 200, [("CONTENT-LENGTH", "77")]), (2, 206, [("Content-Range", "bytes 0-1/*")]), (3, 200, [])],
    columns(lambda: dict(total=mime.total_bytes(F.col("headers"), F.col("status")), length=mime.header(F.col("headers"), "Content-Length"))), "k int, total bigint, length string", [(0, 5000, "1024"), (1, 77, "77"), (2, None, None), (3, None, None)],
)
literal(
    "request_classes", "k int, url string, resource string, type string",
    [(0, "blob:x", None, None), (1, "https://a/pixel.gif", None, None), (2, "https://a/live.m3u8?x", None, None), (3, "https://a/1.m4s", None, None), (4, "https://a/v", "media", "audio/mp4"), (5, "https://a/v", "media", None), (6, "https://a/v", "image", None), (7, "https://a/v", None, "video/webm"), (8, "https://a/v.mkv", None, None), (9, "https://a/v.OGG?1", None, None), (10, "https://a/p.avif", None, None), (11, "https://a/page", None, "text/html")],
    lambda df: df.select("k", mime.classify(F.col("url"), F.col("resource"), F.col("type")).alias("c")).select("k", "c.*"), "k int, kind string, signal string",
    [(0, None, "non-http"), (1, None, "junk"), (2, "stream", "manifest"), (3, "segment", "segment"), (4, "audio", "resource-type-media"), (5, "video", "resource-type-media"), (6, "image", "resource-type-image"), (7, "video", "content-type"), (8, "video", "extension"), (9, "audio", "extension"), (10, "image", "extension"), (11, None, "unclassified")],
)
over("frame_rates", "string", ["30000/1001", "25", "0/0", "N/A", "24/1", "x/2", None], "double", lambda v: F.round(media.frame_rate(v), 6), [29.97003, 25.0, None, None, 24.0, None, None])
over("ratios", "string", ["16:9", "4/3", "0:1", "1:0", "-1/2", "2", "x"], "double", lambda v: F.round(media.ratio(v), 6), [1.777778, 1.333333, None, None, None, 2.0, None])
over("positive_numbers", "string", ["1.5", "0", "-2", "NaN", "Infinity", "abc", None, "7"], "double", media.positive, [1.5, None, None, None, None, None, None, 7.0])
over("clock_texts", "string", ["1:05", "12:59", "3:60", "123:10", " 0:07 ", "1:2", None], "int", media.clock_seconds, [65, 779, None, None, 7, None, None])
over("ages", "int", [5, 59, 60, 3599, 3600, 90000, 604800, None], "string", media.age, ["5s ago", "59s ago", "1m ago", "59m ago", "1h ago", "1d ago", "1w ago", None])
over("rotations", "double", [0.0, 44.0, 45.0, 135.0, -90.0, 359.0, 180.0, 450.0], "int", media.rotation, [0, 0, 0, 180, 270, 0, 180, 90])
over("orientations", "string", ["1.5", "0.5", "1", "0", None, "-3"], "string", media.orientation, ["horizontal", "vertical", "horizontal", None, None, None])
over("extinf", "double", [1.5, 2.5, 0.0, None, 3.49, -1.0], "bigint", media.extinf_seconds, [2, 2, -1, -1, 3, -1])
over("clamped", "string", ["5", "-1", "11", "x", None], "double", lambda v: media.clamp(v, 3.0, 0.0, 10.0), [5.0, 0.0, 10.0, 3.0, 3.0])
over("cooldowns", "int", [0, 1, 2, 5, 6, 20], "bigint", media.cooldown, [0, 60, 120, 960, 1800, 1800])
over("byte_texts", "bigint", [0, 1023, 1024, 1048575, 1048576, 5 * (1 << 30), None], "string", media.byte_text, ["0 B", "1023 B", "1 KB", "1024 KB", "1.0 MB", "5.00 GB", ""])
over("clock_displays", "int", [0, 59, 61, 3599, 3600, 36061, None], "string", media.clock_text, ["0:00", "0:59", "1:01", "59:59", "1:00:00", "10:01:01", ""])
literal(
    "hdr_facts", "k int, transfer string, primaries string, space string, side string", [(0, "smpte2084", "bt2020", "bt2020nc", None), (1, "arib-std-b67", None, None, None), (2, "bt709", "bt2020", None, None), (3, None, None, "bt2020nc", "Dolby Vision Metadata"), (4, None, None, None, None)],
    columns(lambda: dict(label=media.hdr_label(F.col("transfer"), F.col("side")), score=media.hdr_score(F.col("transfer"), F.col("primaries"), F.col("space")))), "k int, label string, score int",
    [(0, "HDR10", 2), (1, "HLG", 2), (2, "SDR", 1), (3, "Dolby Vision", 1), (4, "SDR", 0)],
)
literal(
    "bit_depths", "k int, raw string, sample string, fmt string", [(0, "10", None, "yuv420p"), (1, "0", "12", None), (2, None, None, "yuv420p10le"), (3, None, None, "p010le"), (4, None, None, "gray12le"), (5, None, None, "x2rgb10le"), (6, None, None, "yuv420p"), (7, None, None, None)],
    columns(lambda: dict(depth=media.bit_depth(F.col("raw"), F.col("sample"), F.col("fmt")))), "k int, depth int", [(0, 10), (1, 12), (2, 10), (3, 10), (4, 12), (5, 10), (6, 8), (7, 8)],
)
literal("analysis_sizes", "k int, w int, h int", [(0, 1920, 1080), (1, 1080, 1920), (2, 100, 1), (3, 320, 320)], lambda df: df.select("k", media.analysis_size(F.col("w"), F.col("h")).alias("s")).select("k", "s.*"), "k int, width int, height int", [(0, 320, 180), (1, 180, 320), (2, 100, 2), (3, 320, 320)])
literal("size_classes", "k int, w int, h int", [(0, 1000, 2), (1, 3, 999), (2, 499, 500), (3, 499, 499)], columns(lambda: dict(size=media.size_class(F.col("w"), F.col("h")))), "k int, size string", [(0, "large"), (1, "medium"), (2, "medium"), (3, "small")])
literal("keep_existing", "k int, np int, ns int, op int, os int", [(0, 10, 5, 20, 1), (1, 20, 5, 10, 9), (2, 10, 5, 10, 5), (3, 10, 6, 10, 5)], columns(lambda: dict(keep=media.keeps_existing(F.col("np"), F.col("ns"), F.col("op"), F.col("os")))), "k int, keep boolean", [(0, True), (1, False), (2, True), (3, False)])
literal(
    "sample_plans", "k int, duration double, fps double", [(0, 100.0, 25.0), (1, None, 25.0), (2, 0.05, None), (3, 1.0, 10.0)],
    columns(lambda: dict(times=F.array_join(F.transform(selection.sample_times(F.col("duration"), F.col("fps")), lambda t: F.format_string("%.3f", t)), ","))), "k int, times string", [(0, "10.000,30.000,50.000,70.000,90.000"), (1, "0.500"), (2, "0.025"), (3, "0.100,0.300,0.500,0.700,0.895")],
)
literal("sample_places", "k int, a bigint, b bigint", [(0, 0, 10), (1, 5, 8), (2, 3, 3), (3, 0, 100)], columns(lambda: dict(places=F.array_join(selection.sample_positions(F.col("a"), F.col("b"), 4), ","))), "k int, places string", [(0, "0,2,5,7"), (1, "5,6,7"), (2, ""), (3, "0,25,50,75")])
over("edge_runs", "array<boolean>", [[True, True, True, False, True], [False, False, True], [True, True, False, False, False, True], [], [True]], "int", selection.edge_extent, [5, 0, 0, 0, 1])
literal(
    "usable_frames", "k int, s array<int>", [(0, [0] * 20), (1, [0] * 10 + [200] * 10), (2, [30] * 20), (3, [])],
    columns(lambda: dict(usable=media.frame_usable(F.col("s")), flat=media.uniform_line(F.col("s"))["uniform"])), "k int, usable boolean, flat boolean", [(0, False, True), (1, True, False), (2, False, True), (3, False, False)],
)
literal("line_differences", "k int, a array<int>, b array<int>", [(0, [1, 2, 3], [1, 4, 9]), (1, [0], [255])], columns(lambda: dict(d=F.round(media.line_difference(F.col("a"), F.col("b")), 6))), "k int, d double", [(0, 2.666667), (1, 255.0)])
literal(
    "gradient_hashes", "k int, g array<int>", [(0, list(range(81))), (1, list(range(81, 0, -1))), (2, [7] * 81), (3, [1, 2])],
    lambda df: df.select("k", media.gradient_bits(F.col("g")).alias("h")).select("k", "h.*"), "k int, across bigint, down bigint", [(0, 0, 0), (1, -1, -1), (2, None, None), (3, None, None)],
)
literal("hash_distances", "k int, a bigint, b bigint", [(0, 0, -1), (1, 5, 5), (2, 1, 2)], columns(lambda: dict(near=hashes.hamming(F.col("a"), F.col("b")), wide=hashes.hamming_128(F.col("a"), F.col("a"), F.col("b"), F.col("b")))), "k int, near int, wide int", [(0, 64, 128), (1, 0, 0), (2, 2, 4)])
literal(
    "hex_distances", "k int, a string, b string", [(0, "00000000000000ff", "0000000000000000"), (1, "xyz", "0000000000000000"), (2, None, "0000000000000000"), (3, "FFFFFFFFFFFFFFFF", "ffffffffffffffff")],
    columns(lambda: dict(capped=hashes.hamming_hex(F.col("a"), F.col("b")), far=hashes.hamming_hex(F.col("a"), F.col("b"), None))), "k int, capped int, far int", [(0, 8, 8), (1, 64, None), (2, 64, None), (3, 0, 0)],
)
literal("best_transforms", "k int, a array<bigint>, b array<bigint>", [(0, [0, 255], [254, 1]), (1, [0], []), (2, [0], [-1])], columns(lambda: dict(d=hashes.best_distance(F.col("a"), F.col("b")), s=hashes.similarity(hashes.best_distance(F.col("a"), F.col("b"))))), "k int, d int, s double", [(0, 1, 0.984375), (1, 64, 0.0), (2, 64, 0.0)])
over("hash_radii", "int", [64, 128], "int", lambda v: F.when(v == 64, hashes.radius(0.75, 64)).otherwise(hashes.radius(0.9, 128)), [16, 12])
literal(
    "composite_scores", "k int, v string, m string, p double, ca double, cb double, n int, r double",
    [(0, "byte_exact", "identity", 0.1, 0.0, 0.0, 0, 0.0), (1, "geometry", "homography", 0.9, 0.8, 0.6, 50, 1.5), (2, "none", "none", 0.9, 0.8, 0.6, 50, 1.5), (3, "geometry", "homography", 1.0, 1.0, 1.0, 99, 0.0), (4, "geometry", "homography", None, 1.0, 1.0, 99, 0.0)],
    columns(lambda: dict(score=F.round(hashes.composite_score(F.col("v"), F.col("m"), F.col("p"), F.col("ca"), F.col("cb"), F.col("n"), F.col("r")), 6))), "k int, score double", [(0, 1.0), (1, 0.8), (2, 0.0), (3, 0.99), (4, 0.0)],
)
literal(
    "pair_labels", "k int, v string, m string, p double, n int, c double, r double, pts int", [(0, "pixel_exact", "identity", 0.0, 0, 0.0, 9.0, 0), (1, "geometry", "affine", 0.8, 30, 0.6, 1.0, 500), (2, "geometry", "affine", 0.8, 30, 0.6, 1.0, 50), (3, "geometry", "affine", 0.9, 10, 0.6, 1.0, 500), (4, "none", "none", 1.0, 99, 1.0, 0.0, 500)],
    columns(lambda: dict(label=hashes.pair_label(F.col("v"), F.col("m"), F.col("p"), F.col("n"), F.col("c"), F.col("c"), F.col("r"), F.col("pts"), F.col("pts")))), "k int, label string", [(0, "duplicate"), (1, "variant"), (2, "different"), (3, "different"), (4, "different")],
)
literal("average_hashes", "k int, v array<double>", [(0, [1.0, 3.0]), (1, [2.0, 2.0]), (2, [5.0, 1.0, 1.0, 5.0])], columns(lambda: dict(bits=hashes.mean_bits(F.col("v")))), "k int, bits bigint", [(0, 1), (1, 0), (2, 9)])
literal(
    "signature_votes", "k int, a array<bigint>, b array<bigint>", [(0, [0, 0, 0], [1, 3, 7]), (1, [0, None], [0, 5]), (2, [0, 0], [-1, -1]), (3, [], [])],
    lambda df: df.select("k", selection.compare_signatures(F.col("a"), F.col("b")).alias("c")).select("k", "c.*"), "k int, median double, votes int, compared int", [(0, 2.0, 3, 3), (1, 0.0, 1, 1), (2, None, None, None), (3, None, None, None)],
)
literal(
    "duplicate_verdicts", "k int, median double, gap double, same boolean, name double", [(0, 5.0, 0.1, False, 0.0), (1, 12.0, 0.1, True, 1.0), (2, 5.0, 0.2, True, 1.0), (3, None, 0.06, True, 1.0), (4, None, 0.01, True, 0.0), (5, None, 0.01, False, 0.95), (6, None, 0.01, False, 0.5)],
    columns(lambda: dict(verdict=selection.verdict(F.when(F.col("median").isNotNull(), F.struct("median")), F.col("gap"), F.col("same"), F.col("name")))), "k int, verdict string",
    [(0, "identical"), (1, "similar"), (2, "similar"), (3, None), (4, "identical"), (5, "similar"), (6, None)],
)
over("stems", "string", ["My Movie (2020).mkv", "a_b.c.d", "ÄÖ1.txt", ""], "string", names.stem, ["mymovie2020", "abc", "1", ""])
_FILES = ["a.tar.gz", "Photo.JPG", "app.db-wal", "README.md", ".env", "main.py", "notes", "x.unknown", "movie.mkv", "requirements-dev.txt", "data.parquet", "setup.cfg", "archive.7z", "Dockerfile", "font.woff2"]
over("file_extensions", "string", _FILES, "string", entries.extension, [".tar.gz", ".jpg", ".db-wal", ".md", "", ".py", "", ".unknown", ".mkv", ".txt", ".parquet", ".cfg", ".7z", "", ".woff2"])
over("file_categories", "string", _FILES, "string", entries.category, ["archive", "image", "database", "", "", "", "", "", "video", "", "dataset", "", "archive", "", "font"])
over("file_priorities", "string", _FILES, "int", entries.priority, [0, 0, 0, 3, 3, 2, 1, 1, 0, 3, 0, 2, 0, 3, 0])
_FOLDERS = [["src", "node_modules"], [".claude", "worktrees"], ["worktrees"], ["Build"], ["src"], ["a", ".git"], ["vendor"], ["a", "vendor", "x"], ["x", "y", "z", "w"], ["x", "y", "src"], ["x", "docs"], ["plain"], ["lib"]]
over("collapsed_folders", "array<string>", _FOLDERS, "boolean", entries.is_collapsed, [True, True, False, True, False, True, False, False, False, False, False, False, False])
over("prune_tiers", "array<string>", _FOLDERS, "int", entries.prune_tier, [4, 4, 8, 8, 9, 4, 1, 0, 2, 6, 7, 8, 9])
over("ignored_events", "string", ["/a/list.M3U8", "/a/x.mp4", "/a/probe-cache.json", "/OUT/all.txt", "/a/m3u"], "boolean", lambda v: entries.ignored_event(v, ["/out/all.txt"]), [True, False, True, True, False])
over("glob_filters", "string", ["/p/a.jpg", "/p/thumbs/a.jpg", "/p/a_small.png", "/p/b.PNG", "/p/c.txt"], "boolean", lambda v: entries.kept_by_globs(v, ["*.jpg", "*.png"], ["thumbs", "*_small.*"]), [True, False, False, True, False])
over("srcsets", "string", ["a.jpg 100w, b.jpg 300w, c.jpg 200w", "a.jpg, b.jpg 2x", "a.jpg 1x, b.jpg 1x", "only.jpg"], "string", markup.best_of_srcset, ["b.jpg", "b.jpg", "a.jpg", "only.jpg"])
over("image_tags", "string", ['<img src="s.jpg" data-original="o.jpg">', '<img src="s.jpg" srcset="a.jpg 1x, b.jpg 2x">', '<img src="s.jpg">', '<img data-src="data:image/x" src="s.jpg">'], "string", markup.full_image, ["o.jpg", "b.jpg", "s.jpg", "s.jpg"])
over("plain_labels", "string", ["Like (12)  this [x] 3", "  A   B ", None], "string", markup.plain_label, ["like this", "a b", None])
over("label_matches", "string", ["Skip ad (5)", "Skip trailer", "Watch", None], "boolean", lambda v: markup.label_matches(v, ["skip", "close"], ["trailer"]), [True, False, False, False])
over("title_keywords", "string", ["My PRIVATE window", "private", "Public", None], "boolean", lambda v: markup.mentions(v, ["private"], ["Private"]), [True, False, False, False])
over("conversation_ids", "string", ["https://x/c/0A1B2C3D-1111-2222-3333-444455556666?x", "https://x/none"], "string", markup.conversation_id, ["0a1b2c3d-1111-2222-3333-444455556666", None])
over("clamped_paths", "string", ["/a/short.txt", "/a/averyverylongname.txt", "/averyverylongfolder/x.txt"], "string", lambda v: markup.clamped_path(v, 14), ["/a/short.txt", "/a/averyve.txt", "/averyverylongfolder/x.txt"])
over("markdown_html", "string", ["**b** *i* `c<d>` [t](http://x)", "a & b"], "string", markup.markdown_inline, ['<strong>b</strong> <em>i</em> <code>c&lt;d&gt;</code> <a href="http://x">t</a>', "a &amp; b"])
over("display_texts", "string", ["ok", "a\u202eb", "x\x07y"], "string", markup.display_safe, ["ok", "a\\u202eb", "x\\u0007y"])
over("plurals", "int", [0, 1, 2], "string", lambda v: markup.plural(v, "entry", "entries"), ["0 entries", "1 entry", "2 entries"])
_LINKS = ["https://WWW.a.com/p/x-800x600.jpg?w=3&b=2&a=1", "http://a.com/resize/10x20/y.png?token=1&z=1", "https://a.com", "junk"]
over("image_keys", "string", _LINKS, "string", urls.image_key, ["https://www.a.com/p/x.jpg?a=1&b=2", "https://a.com/y.png?token=1&z=1", "https://a.com/", "junk"])
over("media_keys", "string", _LINKS, "string", urls.media_key, ["https://www.a.com/p/x-800x600.jpg?a=1&b=2&w=3", "https://a.com/y.png?z=1", "https://a.com/", "junk"])
over("history_keys", "string", _LINKS, "string", urls.history_key, ["https___www_a_com_p_x_800x600_jpg", "http___a_com_resize_10x20_y_png", "https___a_com_", "junk"])
over("safe_names", "string", ["a/b:c.txt", "CON", "  x. ", "", None, "con.txt", "fine"], "string", urls.safe_name, ["a_b_c.txt", "_CON", "x", "file", "file", "_con.txt", "fine"])
over("plain_file_names", "string", [" a/b ", None, "x\ty"], "string", urls.plain_file_name, ["a_b", "", "x_y"])
over("names_from_urls", "string", ["https://a/b/c.png?x", "https://a/b/c", "https://a/"], "string", urls.name_from_url, ["c.png", "c.jpg", "file.jpg"])
literal("renamed_by_type", "k int, name string, type string", [(0, "a.jpg", "image/png"), (1, "a", "video/mp4"), (2, "a.x", "text/html")], columns(lambda: dict(new=urls.with_extension(F.col("name"), mime.extension_of(F.col("type"))))), "k int, new string", [(0, "a.png"), (1, "a.mp4"), (2, "a.x")])
over("public_origins", "string", ["https://Ex.org/", "http://ex.org", "https://u:p@ex.org", "https://ex.org:8443", "https://10.0.0.1/", "https://localhost", "https://ex.org/path", "https://nas.local/", " https://nas.lan:443/? ", "https://x.onion", "https://old.reddit.com", "https://notreddit.com/#"], "string", urls.public_origin, ["https://ex.org", None, None, None, None, None, None, None, "https://nas.lan", None, None, "https://notreddit.com"])
over("reading_paths", "string", ["/", "/r/x/comments/1", "/user/a", "/r/x.json", "/submit", "/hot/", "/message/inbox"], "boolean", urls.is_reading_path, [True, True, True, False, False, True, False])
over("reading_urls", "string", ["https://old.reddit.com/r/x/?a=1#c", "https://redd.it/abc12", "https://www.reddit.com/gallery/zz9/", "https://reddit.com/r/x?token=1", "https://evil.com/r/x", "https://www.reddit.com/submit", "https://reddit.com"], "string", urls.reading_url, ["/r/x?a=1#c", "/comments/abc12", "/comments/zz9", None, None, None, "/"])
over("trimmed_paths", "string", ["/a/b///", "/", "", None, "/x"], "string", urls.trimmed_path, ["/a/b", "/", "/", "/", "/x"])
literal("playlist_locations", "k int, loc string, folder string", [(0, "http://x/y", "/m"), (1, "sub\\a.mp4", "D:\\lists\\"), (2, "../b.mp4", "/m/lists"), (3, "/abs/./c.mp4", "/m"), (4, "C:/d.mp4", "/m")], columns(lambda: dict(at=urls.location_of(F.col("loc"), F.regexp_replace("folder", r"\\", "/")))), "k int, at string", [(0, "http://x/y"), (1, "D:/lists/sub/a.mp4"), (2, "/m/b.mp4"), (3, "/abs/c.mp4"), (4, "C:/d.mp4")])
literal("group_keys", "k int, parent string, tab int, frame int, el string, url string", [(0, "p1", 1, 0, "e", "u"), (1, None, 1, 0, "e", "u"), (2, None, 1, 0, None, "u")], columns(lambda: dict(key=urls.group_key(F.col("parent"), F.col("tab"), F.col("frame"), F.col("el"), F.col("url")))), "k int, key string", [(0, "parent:p1"), (1, "el:1:0:e"), (2, "url:u")])
over("text_hashes", "string", ["a", "ab", "hello world", ""], "string", urls.text_hash, ["2p", "2e9", "to5x38", "0"])
_M3U = ["#EXTM3U", "", "# note", "#EXTINF:12,One", "a.mp4", "b.mp4", "#tail", "  c.mp4  "]
literal("m3u_entries", "file string, line int, text string", [("f", k, t) for k, t in enumerate(_M3U)], lambda df: playlists.entries(df).withColumn("comments", F.array_join("comments", "|")), "file string, line int, location string, comments string", [("f", 4, "a.mp4", "# note|#EXTINF:12,One"), ("f", 5, "b.mp4", ""), ("f", 7, "c.mp4", "#tail")])
literal("m3u_lines", "k int, secs double, title string, loc string", [(2, 9.5, "B", "b.mp4"), (1, None, None, "a.mp4")], lambda df: playlists.write_lines(df, F.col("k"), F.col("secs"), F.col("title"), F.col("loc")), "value string", [("#EXTM3U",), ("#EXTINF:-1,",), ("a.mp4",), ("#EXTINF:10,B",), ("b.mp4",)])
_MASTER = ["#EXTM3U", '#EXT-X-STREAM-INF:BANDWIDTH=800000,RESOLUTION=640x360,CODECS="avc1,mp4a"', "low.m3u8", "#EXT-X-STREAM-INF:BANDWIDTH=3000000,RESOLUTION=1920x1080", "high.m3u8", "#EXT-X-STREAM-INF:BANDWIDTH=1500000,RESOLUTION=1280x720", "mid.m3u8"]
_master = [("m", k, t) for k, t in enumerate(_MASTER)]
literal("hls_variants", "file string, line int, text string", _master, playlists.hls_variants, "url string, bandwidth bigint, resolution string, codecs string", [("low.m3u8", 800000, "640x360", "avc1,mp4a"), ("high.m3u8", 3000000, "1920x1080", None), ("mid.m3u8", 1500000, "1280x720", None)])
literal("hls_pick_best", "file string, line int, text string", _master, lambda df: playlists.pick_variant(playlists.hls_variants(df)), "file string, url string, bandwidth bigint", [("m", "high.m3u8", 3000000)])
literal("hls_pick_height", "file string, line int, text string", _master, lambda df: playlists.pick_variant(playlists.hls_variants(df), 720), "file string, url string, bandwidth bigint", [("m", "mid.m3u8", 1500000)])
_MEDIA = ["#EXTM3U", "#EXT-X-MEDIA-SEQUENCE:7", "#EXTINF:4.0,", "#EXT-X-BYTERANGE:100@50", "s.ts", '#EXT-X-KEY:METHOD=AES-128,URI="k1"', "#EXTINF:5.5,", "#EXT-X-BYTERANGE:200", "s.ts", "#EXT-X-KEY:METHOD=NONE", "#EXTINF:6,", "t.ts"]
_media = [("v", k, t) for k, t in enumerate(_MEDIA)]
literal("hls_segments", "file string, line int, text string", _media, playlists.hls_segments, "seq bigint, url string, duration double, range_start bigint, range_length bigint, key_uri string", [(7, "s.ts", 4.0, 50, 100, None), (8, "s.ts", 5.5, 150, 200, "k1"), (9, "t.ts", 6.0, None, None, None)])
literal("hls_durations", "file string, line int, text string", _media, lambda df: playlists.hls_segments(df).groupBy("file").agg(F.sum("duration").alias("seconds"), F.count(F.lit(1)).alias("segments")), "file string, seconds double, segments bigint", [("v", 15.5, 3)])
over("hls_attributes", "string", ['A=1,B="x,y",C-D=z', ""], "string", lambda v: F.concat_ws(";", F.transform(F.array_sort(F.map_entries(playlists.attributes(v))), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))), ["A:1;B:x,y;C-D:z", ""])
over("hls_protection", "string", ['METHOD=SAMPLE-AES,KEYFORMAT="com.apple.streamingkeydelivery"', "METHOD=AES-128", "METHOD=SAMPLE-AES-CTR", 'KEYFORMAT="URN:UUID:EDEF8BA9-79D6-4ACE-A3C8-27DCD51D21ED"'], "string", lambda v: hls.protection(playlists.attributes(v)), ["FairPlay", None, "SAMPLE-AES", "Widevine"])
literal("hls_vectors", "k int, iv string, seq bigint", [(0, "0x000102030405060708090A0B0C0D0E0F", 1), (1, None, 258), (2, None, 0)], columns(lambda: dict(hex=hls.initial_vector(F.col("iv"), F.col("seq")))), "k int, hex string", [(0, "000102030405060708090a0b0c0d0e0f"), (1, "00000000000000000000000000000102"), (2, "0" * 32)])
literal("hls_tracks", "k int, codecs string", [(0, "avc1.64001f,mp4a.40.2"), (1, "mp4a.40.2"), (2, "hvc1.1"), (3, None), (4, "stpp")], columns(lambda: dict(video=hls.has_video(F.col("codecs")), audio=hls.has_audio(F.col("codecs")))), "k int, video boolean, audio boolean", [(0, True, True), (1, False, True), (2, True, False), (3, True, True), (4, False, False)])
over("hls_ranges", "string", ["100@50", "1@0", "x", None], "string", hls.range_header, ["bytes=50-149", "bytes=0-0", None, None])
literal("hls_sizes", "k int, bps bigint, secs double", [(0, 800000, 10.0), (1, 0, 10.0), (2, 1000, None)], columns(lambda: dict(size=hls.estimated_bytes(F.col("bps"), F.col("secs")))), "k int, size bigint", [(0, 1000000), (1, None), (2, None)])
literal(
    "audio_renditions", "k int, grp string, url string, is_default boolean, ord int", [(0, "a", "x", False, 0), (1, "a", "y", True, 1), (2, "b", None, True, 0), (3, "c", "z", False, 0), (4, "c", "w", False, 1)],
    lambda df: df.where("url is not null").groupBy("grp").agg(F.min_by("url", F.struct(~F.col("is_default"), F.col("ord"))).alias("url")), "grp string, url string", [("a", "y"), ("c", "z")],
)
_PROBE = '{"format": {"duration": "10", "bit_rate": "1000000"}, "streams": [{"codec_type": "video", "codec_name": "mjpeg", "width": "1", "height": "1", "disposition": {"attached_pic": 1}}, {"codec_type": "video", "codec_name": "HEVC", "width": "1920", "height": "1080", "avg_frame_rate": "30000/1001", "pix_fmt": "yuv420p10le", "color_transfer": "smpte2084", "tags": {"rotate": "90"}}, {"codec_type": "audio", "bit_rate": "128000"}, {"codec_type": "audio", "bit_rate": "72000"}]}'
literal(
    "probe_facts", "k int, doc string, size bigint", [(0, _PROBE, 5), (1, "no json", 5)], lambda df: probes.read_probes(df, "doc", "size").withColumn("fps", F.round("fps", 3)),
    "k int, duration double, codec string, width bigint, height bigint, bitrate bigint, bitrate_source string, fps double, bit_depth int, hdr_score int, rotation int, orientation string",
    [(0, 10.0, "hevc", 1080, 1920, 800000, "estimated", 29.97, 10, 2, 90, "vertical"), (1, None, None, None, None, None, None, None, None, None, None, None)],
)
_CACHE = [("/a", 1, 1, 3, "old", 1), ("/a", 2, 2, 3, "new", 2), ("/b", 1, 1, 2, "v", 1), ("/c", 9, 9, 3, "w", 1)]
literal("cache_latest", "path string, size int, mtime_ns int, version int, payload string, written int", _CACHE, lambda df: probes.latest_rows(df, ["path"], "written"), "path string, size int, payload string", [("/a", 2, "new"), ("/b", 1, "v"), ("/c", 9, "w")])
literal(
    "cache_adopted", "path string, size int, mtime_ns int, version int, payload string, written int", _CACHE,
    lambda df: probes.adopt(df.where("path = '/c'").select("path", "size", "mtime_ns", F.lit(None).cast("string").alias("payload")), df.where("written = 1").select(F.regexp_replace("path", "^/", "").alias("path"), "size", "mtime_ns", "payload"), df.where("path <> '/b'"), F.lit("/"), ["payload"]),
    "path string, size int, payload string", [("/a", 1, "old"), ("/c", 9, "w")],
)
literal(
    "records_changed", "path string, size int, mtime_ns int, sha256 string, side string", [("/a", 1, 1, "x", "r"), ("/b", 1, 1, "x", "r"), ("/c", 1, 1, "x", "r"), ("/d", 1, 1, "x", "r"), ("/e", 1, 1, "x", "r"), ("/a", 1, 1, "x", "l"), ("/b", 2, 1, "x", "l"), ("/c", 1, 2, "x", "l"), ("/d", 1, 1, "y", "l")],
    lambda df: probes.changed_since(df.where("side = 'r'"), df.where("side = 'l'")), "path string, changed string", [("/a", None), ("/b", "size"), ("/c", "time"), ("/d", "content"), ("/e", "missing")],
)
_EVENTS = [("a", 10, 11, True), ("a", 12, 13, False), ("a", 14, 15, False), ("a", 12, 16, False), ("b", 1, 2, False), ("b", 1, 3, True), ("b", 4, 5, True), ("c", 1, 4, False)]
literal("instance_health", "key string, started int, ended int, ok boolean", _EVENTS, lambda df: instances.health(df, "key", "started", "ended", "ok"), "key string, ok_at bigint, failed_at bigint, failures bigint, retry_at bigint", [("a", 0, 15, 2, 135), ("b", 5, 0, 0, 0), ("c", 0, 4, 1, 64)])
literal(
    "instance_candidates", "key string, started int, ended int, ok boolean", _EVENTS, lambda df: instances.candidates(df.select("key", F.ascii("key").alias("score")).distinct(), instances.health(df, "key", "started", "ended", "ok"), "key", "score", 70, "c", ["z"]),
    "key string, score int", [("c", 99), ("b", 98)],
)
literal("jobs_resumed", "k int, state string, code string, drm boolean", [(0, "fetching", None, None), (1, "failed", "http_5xx", False), (2, "failed", "http_5xx", True), (3, "done", None, None), (4, "failed", "html_response", False)], lambda df: instances.retried(instances.resumed(df), ["http_5xx"]), "k int, state string", [(0, "queued"), (1, "queued"), (2, "failed"), (3, "done"), (4, "failed")])
literal("files_stable", "path string, seen int, size int", [("/a", 1, 5), ("/a", 4, 5), ("/b", 1, 5), ("/b", 4, 6), ("/c", 3, 5), ("/c", 4, 5), ("/d", 1, 1)], lambda df: instances.stable_files(df, "path", "seen", "size"), "path string, size int", [("/a", 5)])
literal("edges_merged", "a int, b int, kind string", [(1, 2, "variant"), (2, 1, "exact"), (3, 4, "pixel"), (3, 4, "variant")], lambda df: duplicates.merge_edges(*((df.where(F.col("kind") == k).select("a", "b"), k, p) for k, p in (("exact", 3), ("pixel", 2), ("variant", 1)))), "a int, b int, kind string", [(1, 2, "exact"), (3, 4, "pixel")])
literal("survivor_check", "component int, marked boolean", [(1, True), (1, True), (2, True), (2, False)], lambda df: selection.without_survivor(df, "component", "marked"), "component int", [(1,)])
literal("marks_of_copies", "sha string, path string, marked boolean", [("x", "/a", False), ("x", "/b", False), ("x", "/c", True), ("y", "/d", True)], lambda df: selection.unmarked_duplicates(df, "sha", "path", "marked"), "sha string, path string", [("x", "/b")])
literal("mapped_paths", "path string, root string, mapped string", [("/mnt/media/x.mp4", None, None), ("/mnt/other/y", None, None), ("/z", None, None), (None, "/mnt", "Z:"), (None, "/mnt/media", "M:")], lambda df: selection.longest_prefix(df.where("path is not null").select("path"), df.where("root is not null").select("root", "mapped")), "path string, mapped string", [("/mnt/media/x.mp4", "M:/x.mp4"), ("/mnt/other/y", "Z:/other/y"), ("/z", None)])
literal("rows_read", "id int, top double, lft double", [(1, 40.0, 1.0), (2, 10.0, 5.0), (3, 12.0, 2.0), (4, 100.0, 0.0)], lambda df: df.orderBy(*selection.reading_order(F.col("top"), F.col("lft"))).limit(2), "id int", [(3,), (2,)])
literal("names_unique", "id int, name string", [(1, "a.txt"), (2, "a.txt"), (3, "b"), (4, "a.txt")], lambda df: selection.unique_names(df, "name", F.col("id")), "id int, unique_name string", [(1, "a.txt"), (2, "a_2.txt"), (3, "b"), (4, "a_3.txt")])
_TREE = [("src/a.py", False), ("src/b.py", False), ("docs/img/1.png", False), ("docs/img/2.png", False), ("docs/pic/9.png", False), ("docs", True), ("docs/img", True), ("docs/pic", True), ("src", True)]
_paths = lambda df: df.select(F.split("p", "/").alias("path"), "is_folder")
literal("tree_descendants", "p string, is_folder boolean", _TREE, lambda df: tree.descendant_counts(_paths(df)).withColumn("folder", F.array_join("path", "/")), "folder string, folders bigint, files bigint", [("", 4, 5), ("src", 0, 2), ("docs", 2, 3), ("docs/img", 0, 2), ("docs/pic", 0, 1)])
literal("tree_bulk_only", "p string, is_folder boolean", _TREE, lambda df: tree.bulk_only(_paths(df).where("not is_folder")).select(F.array_join("path", "/").alias("folder"), F.array_join("categories", ",").alias("categories")), "folder string, categories string", [("docs", "image"), ("docs/img", "image"), ("docs/pic", "image")])
literal("tree_equal_layouts", "p string, is_folder boolean", _TREE, lambda df: tree.subtree_fingerprints(_paths(df).where("not is_folder")).groupBy("fingerprint").agg(F.array_join(F.array_sort(F.collect_list(F.array_join("path", "/"))), ",").alias("folders")), "folders string", [("",), ("docs",), ("docs/img,docs/pic",), ("src",)])
literal("tree_lines", "p string, is_folder boolean", _TREE, lambda df: tree.rendered_tree(_paths(df)), "text string", [("- docs/",), ("  - img/",), ("    - 1.png",), ("    - 2.png",), ("  - pic/",), ("    - 9.png",), ("- src/",), ("  - a.py",), ("  - b.py",)])
literal("tree_siblings", "p string, fingerprint bigint", [(f"m/{c}", 1) for c in "abcdefg"] + [("m/x", 2), ("m/y", 2)], lambda df: tree.equal_siblings(df.select(F.split("p", "/").alias("path"), "fingerprint")).select(F.array_join("path", "/").alias("folder"), "expanded"), "folder string, expanded boolean", [(f"m/{c}", c in "abfg") for c in "abcdefg"] + [("m/x", True), ("m/y", True)])
literal("tree_pruned", "p string, lines int", [("vendor/x", 10), ("a/b", 50), ("src", 30), ("plain", 20)], lambda df: tree.pruned(df.select(F.split("p", "/").alias("path"), "lines"), "path", "lines", 55).select(F.array_join("path", "/").alias("folder"), "tier", "cut"), "folder string, tier int, cut boolean", [("vendor/x", 0, True), ("a/b", 4, True), ("plain", 8, False), ("src", 9, False)])
literal("records_upserted", "side string, tab int, url string, mime string, size bigint, state string", [("o", 1, "u", None, 5, "candidate"), ("n", 1, "u", "video/mp4", 9, "confirmed"), ("n", 2, "w", None, None, "candidate"), ("o", 3, "x", "a", 1, "confirmed")], lambda df: sets.merged_records(df.where("side = 'o'"), df.where("side = 'n'"), ["tab", "url"], ["mime", "size"], "state", ["candidate", "confirmed"]), "tab int, url string, mime string, size bigint, state string", [(1, "u", "video/mp4", 5, "confirmed"), (2, "w", None, None, "candidate"), (3, "x", "a", 1, "confirmed")])
literal("nearest_mutual", "side string, blk int, id int, v double", [("a", 1, 1, 0.0), ("a", 1, 2, 10.0), ("b", 1, 1, 0.5), ("b", 1, 2, 9.0), ("a", 2, 3, 5.0), ("b", 2, 3, 5.0)], lambda df: sets.mutual_nearest(df.where("side = 'a'").select("blk", "id", "v"), df.where("side = 'b'").select("blk", "id", "v"), F.abs(F.col("x.v") - F.col("y.v")), 0.8, "blk"), "a int, b int, distance double", [(1, 1, 0.5), (2, 2, 1.0), (3, 3, 0.0)])
_PAIRS = [("x", "y", "duplicate", "byte", "byte_exact", 1.0, 0, 0.5, 0.25, float("inf"), "identity"), ("x", "z", "different", "none", "none", 0.33333, 3, None, 0.0, 1.25, "none")]
_PAIR_DDL = "a string, b string, label string, match_kind string, verification string, phash_similarity double, inliers int, coverage_a double, coverage_b double, residual_median_px double, model string"
literal("report_csv", _PAIR_DDL, _PAIRS, reports.pair_lines, "a string, b string, label string, phash_similarity string, inliers string, coverage_a string, coverage_b string, residual_median_px string", [("x", "y", "duplicate", "1.0000", "0", "0.5000", "0.2500", ""), ("x", "z", "different", "0.3333", "3", "", "0.0000", "1.2500")])
literal("report_json", _PAIR_DDL, _PAIRS, lambda df: reports.pair_documents(df).select(F.get_json_object("value", "$.b").alias("b"), F.get_json_object("value", "$.metrics.residual_median_px").alias("residual"), F.get_json_object("value", "$.metrics.model").alias("model")), "b string, residual string, model string", [("y", None, "identity"), ("z", "1.25", "none")])
literal("report_stats", _PAIR_DDL, _PAIRS, lambda df: reports.report_stats(df, 1), "pairs_compared bigint, clusters bigint, duplicates bigint, variants bigint, different_sampled bigint", [(2, 1, 1, 0, 1)])
_ITEMS = [(1, "image", "done", 800, 600, 10, 3, "b"), (2, "video", "queued", None, None, None, 2, "A"), (3, "image", "queued", 20, 30, 99, 1, None), (4, "audio", None, 0, 0, 50, 4, "c")]
_ITEM_DDL = "id int, kind string, state string, width int, height int, size int, added int, label string"
literal(
    "library_filter", _ITEM_DDL, _ITEMS, columns(lambda: {"shown": library.passes_filter(F.col("kind"), F.col("state"), F.col("width"), F.col("height"), "image"), "large": library.passes_filter(F.col("kind"), F.col("state"), F.col("width"), F.col("height"), "all", True, 100)}), "id int, shown boolean, large boolean",
    [(1, True, False), (2, False, True), (3, True, False), (4, False, True)],
)
for _mode, _first in (("bytes", [3, 4]), ("added", [4, 1]), ("name", [3, 2]), ("area", [1, 3])):
    literal(
        f"library_by_{_mode}", _ITEM_DDL, _ITEMS, lambda df, m=_mode: df.orderBy(*library.library_order(m, F.col("width"), F.col("height"), F.col("size"), F.col("added"), F.col("added"), F.col("label")), "id").limit(2), "id int", [(k,) for k in _first],
    )
over("escalations", "string", ["http_403", "http_404", "zero_bytes", None, "drm_protected"], "boolean", library.escalates, [True, False, True, False, False])
literal("file_locations", "k int, a boolean, b boolean", [(0, True, True), (1, True, False), (2, False, True), (3, False, False)], columns(lambda: {"location": library.location(F.col("a"), F.col("b"))}), "k int, location string", [(0, "ambiguous_both"), (1, "original"), (2, "quarantine"), (3, "missing_or_changed")])
over("id_lists", "array<int>", [[1, 2], [1, 1], [], None], "boolean", library.ids_are_sound, [True, False, False, False])
literal("recent_times", "k int, ts int", [(0, 95), (1, 90), (2, 0), (3, None)], columns(lambda: {"recent": library.is_recent(F.col("ts"), F.lit(100), 10)}), "k int, recent boolean", [(0, True), (1, False), (2, False), (3, False)])
over("monitor_ids", "string", ["MONITOR\\ABC123\\{x}", "plain-device-name-long", "short"], "string", library.monitor_id, ["ABC123", "plain-device", "short"])
literal("invocations", "k int, dir string, paths array<string>", [(0, "in", ["b", "A"]), (1, "in", ["a", "B"]), (2, "out", ["a", "b"])], lambda df: df.groupBy(library.invocation_signature(F.col("dir"), F.col("paths"))).agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n")), "first int, n bigint", [(0, 2), (2, 1)])
literal("elements_same", "k int, ai string, bi string, ad string, bd string, at string, bt string", [(0, "x", "x", None, None, "p", "q"), (1, "x", "y", "d", "d", "p", "p"), (2, None, "y", "d", "d", "p", "q"), (3, None, None, None, None, "abcdefghijklmnopqrstuv", "abcdefghijklmnopqrstXX"), (4, None, None, None, None, None, "x")], columns(lambda: {"same": library.same_element(F.col("ai"), F.col("bi"), F.col("ad"), F.col("bd"), F.col("at"), F.col("bt"))}), "k int, same boolean", [(0, True), (1, True), (2, True), (3, True), (4, False)])
literal("content_orientation", "k int, h int, v int, n int", [(0, 5, 1, 6), (1, 3, 3, 6), (2, 1, 5, 6), (3, 3, 2, 6), (4, 0, 0, 0)], columns(lambda: {"side": library.orientation_by_content(F.col("h"), F.col("v"), F.col("n"))}), "k int, side string", [(0, "horizontal"), (1, None), (2, "vertical"), (3, None), (4, None)])
literal("video_requests", "k int, url string, type string", [(0, "https://a/v.mp4", None), (1, "https://a/v", "video/webm"), (2, "https://a/l.m3u8", None), (3, "https://a/i.png", "image/png"), (4, None, None)], columns(lambda: {"video": library.is_video_request(F.col("url"), F.col("type"))}), "k int, video boolean", [(0, True), (1, True), (2, True), (3, False), (4, False)])
literal("entries_sorted", "name string, is_folder boolean", [("b.txt", False), ("A", True), ("c", True), ("a.txt", False)], lambda df: df.orderBy(~F.col("is_folder"), F.lower("name")).limit(3), "name string, is_folder boolean", [("A", True), ("c", True), ("a.txt", False)])
literal("best_sources", "tab int, url string, source string, area int, ord int", [(1, "a", "visible", 10, 0), (1, "b", "gallery", 5, 1), (1, "c", "background", 99, 2), (2, "d", "visible", 10, 0), (2, "e", "visible", 30, 1), (2, "f", "visible", 30, 2)], lambda df: df.groupBy("tab").agg(F.max_by("url", F.struct(F.when(F.col("source") == "gallery", 150).when(F.col("source") == "visible", 100).otherwise(50), "area", -F.col("ord"))).alias("url")), "tab int, url string", [(1, "b"), (2, "e")])
literal("summaries_of_clusters", "a int, b int, kind string", [(1, 2, "duplicate"), (2, 3, "variant"), (7, 8, "variant")], lambda df: sets.cluster_summary(df, duplicates.components(df), "kind"), "component int, members bigint, n_duplicate bigint, n_variant bigint, kinds string", [(1, 3, 1, 1, "duplicate,variant"), (7, 2, 0, 1, "variant")])
literal("links_of_members", "a int, b int", [(1, 2), (2, 3), (3, 4)], lambda df: sets.membership(duplicates.components(df), df, duplicates.representatives(df, duplicates.components(df))), "component int, node int, link string", [(1, 1, "direct"), (1, 2, "representative"), (1, 3, "direct"), (1, 4, "indirect")])
literal("capped_children", "parent string, name string", [("p", n) for n in ["src", ".git", "zz", "yy", "aa", "bb", "cc", "docs"]], lambda df: tree.capped_folders(df, "parent", "name", 5), "parent string, name string", [("p", n) for n in ["src", ".git", "docs", "aa", "zz"]])
