"""The query catalogue: each query over the driver tables with the DuckDB SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import hashes, markup, media, mime, urls
from millrace.operators import alike, duplicates, events, graph, inventory, ledgers, selection, variants
from millrace.operators.collection import Collection
from millrace.operators.hamming import links
from millrace.operators.order import exact_median
from millrace.plans.materialize import materialize, new_path
from millrace.sources import probes
from millrace.sources.tables import load, order_files

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _case(column: str, bounds, unknown="Unknown") -> str:
    parts = [f"WHEN {column} IS NULL OR {column} < 0 THEN '{unknown}'", *(f"WHEN {column} < {upper} THEN '{name}'" for name, upper in bounds if upper is not None)]
    last = next(name for name, upper in bounds if upper is None)
    return f"CASE {' '.join(parts)} ELSE '{last}' END"


def _n(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


# Folder roll-ups and leaderboards -------------------------------------------------------------------------------------

_FILES = """
files AS (
  SELECT [r_name, n_name, 'c' || c_custkey] AS folders, 'o' || o_orderkey AS name, CAST(round(o_totalprice * 100) AS BIGINT) AS size
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
rolled AS (
  SELECT '/' || array_to_string(folders[1:k], '/') AS folder, CAST(k AS INT) AS depth, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes
  FROM files, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY 1, 2)"""


@query(f"WITH {_FILES} SELECT * FROM rolled")
def folder_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.roll_up(order_files(spark, sf))


@query(f"""WITH {_FILES}, t AS (SELECT bytes AS all_bytes, files AS all_files FROM rolled WHERE depth = 0)
SELECT folder, depth, files, bytes, round(bytes * 100.0 / all_bytes, 6) AS percent,
  CASE WHEN bytes / files >= 2 * (all_bytes / all_files) THEN 'red' WHEN bytes / files >= 1.5 * (all_bytes / all_files) THEN 'orange' ELSE 'none' END AS flag
FROM rolled, t""")
def folder_shares(spark: SparkSession, sf: str) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    totals = load(spark, sf, "orders").agg(F.coalesce(F.sum(cents), F.lit(0)).alias("all_bytes"), F.count(F.lit(1)).alias("all_files"))
    return inventory.with_share(inventory.roll_up(order_files(spark, sf)), totals)


@query(f"WITH {_FILES} SELECT folder, files, bytes, row_number() OVER (ORDER BY bytes DESC, folder) AS rank FROM rolled WHERE depth = 3 ORDER BY rank LIMIT 25")
def top_folders(spark: SparkSession, sf: str) -> DataFrame:
    rolled = inventory.roll_up(order_files(spark, sf)).where("depth = 3").select("folder", "files", "bytes")
    return inventory.top(rolled, 25, F.desc("bytes"), F.asc("folder"))


@query(f"WITH {_FILES} SELECT folder, files, bytes, row_number() OVER (ORDER BY files DESC, folder) AS rank FROM rolled WHERE depth = 2 ORDER BY rank LIMIT 25")
def top_folders_by_count(spark: SparkSession, sf: str) -> DataFrame:
    rolled = inventory.roll_up(order_files(spark, sf)).where("depth = 2").select("folder", "files", "bytes")
    return inventory.top(rolled, 25, F.desc("files"), F.asc("folder"))


@query(f"WITH {_FILES} SELECT name, size, row_number() OVER (ORDER BY size DESC, name DESC) AS rank FROM files ORDER BY rank LIMIT 25")
def top_files(spark: SparkSession, sf: str) -> DataFrame:
    # folders do not matter here, so orders are read alone
    files = load(spark, sf, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("name"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("size"))
    return inventory.top(files, 25, F.desc("size"), F.desc("name"))


# Histograms and medians -------------------------------------------------------------------------------------------------

_SIZED = [(name, None if upper is None else upper) for name, upper in media.IMAGE_SIZES]


@query(f"SELECT {_case('n_chars * 1024', _SIZED)} AS bucket, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
def size_histogram(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("n_chars")
    return docs.groupBy(media.image_size_bucket(F.col("n_chars") * 1024).alias("bucket")).agg(_n(), F.sum("n_chars").alias("chars"))


@query(f"SELECT {_case('l_extendedprice * 1048576 / 100', media.VIDEO_SIZES)} AS bucket, count(*) AS n FROM lineitem GROUP BY 1")
def video_size_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.histogram(load(spark, sf, "lineitem"), media.video_size_bucket(F.col("l_extendedprice") * 1048576 / 100))


@query(f"SELECT {_case('value * 60', media.DURATIONS)} AS bucket, count(*) AS n FROM events GROUP BY 1")
def duration_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.histogram(load(spark, sf, "events"), media.duration_bucket(F.col("value") * 60))


_POINTS = ", ".join(f"({k}, '{name}', {w}, {h})" for k, (name, w, h) in enumerate(media.RESOLUTIONS))
_NEAREST = f"""
sized AS (SELECT p_partkey, CAST(p_size AS DOUBLE) * 80 AS w, p_retailprice AS h FROM part),
points(k, name, pw, ph) AS (VALUES {_POINTS}),
near AS (SELECT p_partkey, w, h, CASE WHEN min(sqrt((w - pw) ** 2 + (h - ph) ** 2)) <= 400 THEN arg_min(name, sqrt((w - pw) ** 2 + (h - ph) ** 2) + k * 1e-9) ELSE 'Other' END AS bucket FROM sized, points GROUP BY 1, 2, 3)"""


def _resolutions(spark: SparkSession, sf: str) -> DataFrame:
    part = load(spark, sf, "part").select("p_partkey", (F.col("p_size").cast("double") * 80).alias("w"), F.col("p_retailprice").alias("h"))
    return part.withColumn("bucket", media.nearest_resolution(F.col("w"), F.col("h")))


@query(f"WITH {_NEAREST} SELECT bucket, count(*) AS n FROM near GROUP BY 1")
def nearest_resolution(spark: SparkSession, sf: str) -> DataFrame:
    return _resolutions(spark, sf).groupBy("bucket").agg(_n())


@query(f"""WITH {_NEAREST} SELECT replace(bucket, ' vertical', '') AS base, count(*) FILTER (bucket NOT LIKE '% vertical') AS landscape, count(*) FILTER (bucket LIKE '% vertical') AS portrait
FROM near GROUP BY 1""")
def resolution_sides(spark: SparkSession, sf: str) -> DataFrame:
    tall = F.col("bucket").endswith(" vertical")
    return _resolutions(spark, sf).groupBy(F.regexp_replace("bucket", " vertical$", "").alias("base")).agg(F.count_if(~tall).alias("landscape"), F.count_if(tall).alias("portrait"))


@query(f"WITH {_NEAREST} SELECT CAST(w AS BIGINT) AS w, CAST(floor(h) AS BIGINT) AS h, count(*) AS n FROM near WHERE bucket = 'Other' GROUP BY 1, 2 ORDER BY n DESC, w, h LIMIT 10")
def other_resolutions(spark: SparkSession, sf: str) -> DataFrame:
    raw = _resolutions(spark, sf).where("bucket = 'Other'").groupBy(F.col("w").cast("bigint").alias("w"), F.floor("h").cast("bigint").alias("h")).agg(_n())
    return raw.orderBy(F.desc("n"), "w", "h").limit(10)


@query("SELECT o_orderpriority AS bucket, CAST(round_even(median(o_totalprice / 1000), 0) AS BIGINT) AS median_kbps, count(*) AS n FROM orders GROUP BY 1")
def median_by_bucket(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "orders").select(F.col("o_orderpriority").alias("bucket"), media.kbps(F.col("o_totalprice")).alias("kbps"))
    return exact_median(rows, "bucket", "kbps").select("bucket", F.bround("median").cast("bigint").alias("median_kbps"), "n")


_BIN = "CASE WHEN l_quantity IS NULL THEN 'Unknown' " + " ".join(f"WHEN abs(l_quantity - {rate}) < 0.1 THEN '{name}'" for name, rate in media.FRAME_RATES) + " ELSE 'Other' END"


@query(f"SELECT {_BIN} AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def fps_bins(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.histogram(load(spark, sf, "lineitem"), media.frame_rate_bin(F.col("l_quantity")), "bin")


@query("SELECT upper(p_type) AS codec, count(*) AS n FROM part GROUP BY 1")
def codec_counts(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.histogram(load(spark, sf, "part"), F.upper("p_type"), "codec")


@query("""SELECT doc_id,
  CASE WHEN n_chars >= 1048576 THEN format('{:.2f} MB', n_chars / 1048576) WHEN n_chars >= 1024 THEN format('{:.2f} KB', n_chars / 1024) ELSE n_chars || ' bytes' END AS size_text,
  CASE WHEN n_chars >= 1048576 THEN format('{} MB', n_chars // 1048576) WHEN n_chars >= 1024 THEN format('{} KB', n_chars // 1024) ELSE n_chars || ' bytes' END AS short_text,
  CASE WHEN n_chars >= 3600 THEN format('{}h {}m {}s', n_chars // 3600, n_chars % 3600 // 60, n_chars % 60) WHEN n_chars >= 60 THEN format('{}m {}s', n_chars // 60, n_chars % 60) ELSE format('{}s', n_chars) END AS duration_text
FROM documents""")
def human_texts(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("n_chars")
    return load(spark, sf, "documents").select("doc_id", media.human_size(m).alias("size_text"), media.human_size_short(m).alias("short_text"), media.human_duration(m).alias("duration_text"))


@query("""WITH m AS (SELECT user_id, median(value) AS mc FROM events GROUP BY 1),
d AS (SELECT e.user_id, median(abs(value - mc)) AS mad FROM events e JOIN m USING (user_id) GROUP BY 1)
SELECT user_id, round(mad, 6) AS centre_mad, round(least(1, greatest(0, 1 - 0.5 * mad / 0.07 - 0.5 * mad / 0.09)), 6) AS stability FROM d""")
def mad_stability(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events").select("user_id", F.col("value").alias("c"), F.col("value").alias("s"))
    return inventory.stability(rows, ["user_id"], "c", "s").select("user_id", F.round("centre_mad", 6).alias("centre_mad"), F.round("stability", 6).alias("stability"))


# Quality, duplicates, graphs ----------------------------------------------------------------------------------------------

_TIER = "CASE " + " ".join(f"WHEN px >= {least} THEN {tier}" for least, tier in media.TIERS) + " WHEN px >= 0 THEN 1 ELSE 0 END"


@query(f"""WITH f AS (
  SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * 80 AS w, CAST(l_linenumber AS BIGINT) * 400 AS h, CAST(l_extendedprice * 100 AS BIGINT) AS bitrate, CAST(l_partkey AS BIGINT) AS size FROM lineitem),
g AS (SELECT *, w * h AS px FROM f),
q AS (SELECT *, {_TIER} AS tier, round(least(10, bitrate * 1.5 / (px * 30)), 9) AS bppf FROM g)
SELECT l_orderkey AS k, l_linenumber AS best_line, tier, CAST(floor(bppf * 1000000) AS BIGINT) AS ppm FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY tier DESC, px DESC, bppf DESC, bitrate DESC, size DESC, l_linenumber) AS r FROM q) WHERE r = 1""")
def quality_rank(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity").cast("bigint") * 80).alias("w"), (F.col("l_linenumber").cast("bigint") * 400).alias("h"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("bitrate"), F.col("l_partkey").alias("size")
    )
    none = F.lit(None).cast("double")
    key = media.quality_key(F.col("w"), F.col("h"), F.lit(0), F.lit(8), F.col("bitrate"), F.lit("stream"), none, F.lit("hevc"), none, F.col("size"))
    best = rows.groupBy(F.col("l_orderkey").alias("k")).agg(F.max(F.struct(key.alias("q"), (-F.col("l_linenumber")).alias("line"))).alias("b"))
    return best.select("k", (-F.col("b.line")).alias("best_line"), F.col("b.q.tier").alias("tier"), F.floor(F.col("b.q.bppf") * 1_000_000).alias("ppm"))


_EXACT = "g AS (SELECT doc_id, sha256(text) AS identity, count(*) OVER w AS n, min(doc_id) OVER w AS first FROM documents WINDOW w AS (PARTITION BY sha256(text)))"


def _identity(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.exact_groups(load(spark, sf, "documents"), F.sha2(F.col("text").cast("binary"), 256), "doc_id")


@query(f"WITH {_EXACT} SELECT doc_id, identity, n, first FROM g WHERE n > 1")
def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return _identity(spark, sf).select("doc_id", "identity", "n", "first")


@query(f"WITH {_EXACT} SELECT doc_id, n - 1 AS peers, doc_id = first AS survives FROM g WHERE n > 1")
def survivors(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.survivors(_identity(spark, sf), "doc_id").select("doc_id", (F.col("n") - 1).alias("peers"), "survives")


_RADIUS = 16
_MASK = "m AS (SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') :: BIT AS bits FROM embeddings)"
_PAIRS = f"{_MASK}, p AS (SELECT l.vec_id AS a, r.vec_id AS b, CAST(bit_count(xor(l.bits, r.bits)) AS INT) AS distance FROM m l JOIN m r ON l.vec_id < r.vec_id WHERE bit_count(xor(l.bits, r.bits)) <= {_RADIUS})"


def _near(spark: SparkSession, sf: str) -> DataFrame:
    bits = load(spark, sf, "embeddings").select("vec_id", hashes.sign_bits(F.col("embedding")).alias("bits"))
    return duplicates.hamming_pairs(bits, "vec_id", "bits", _RADIUS)


@query(f"WITH {_PAIRS} SELECT a, b, distance, 1 - distance / 64 AS similarity FROM p")
def near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return _near(spark, sf).select("a", "b", "distance", hashes.similarity(F.col("distance")).alias("similarity"))


_REACH = f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a), c AS (SELECT node, min(seen) AS component FROM r GROUP BY 1)"""


@query(f"{_REACH} SELECT node, component FROM c")
def duplicate_components(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.components(_near(spark, sf)).select("node", "component")


@query(f"""{_REACH}, d AS (SELECT a AS node, count(*) AS degree FROM e GROUP BY 1),
k AS (SELECT component, node, degree, count(*) OVER (PARTITION BY component) AS size, row_number() OVER (PARTITION BY component ORDER BY degree DESC, node) AS n FROM c JOIN d USING (node))
SELECT component, node AS representative, size, degree FROM k WHERE n = 1""")
def representatives(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _near(spark, sf)
    return duplicates.representatives(pairs, duplicates.components(pairs))


@query(f"""{_REACH}, h AS (SELECT a AS source, a AS node, 0 AS hops FROM e UNION SELECT h.source, e.b, hops + 1 FROM h JOIN e ON h.node = e.a WHERE hops < 24),
n AS (SELECT source, node, min(hops) AS hops FROM h GROUP BY 1, 2), s AS (SELECT source AS node, CAST(sum(hops) AS BIGINT) AS hops FROM n GROUP BY 1),
d AS (SELECT x AS node, count(*) AS degree, sum(1 - distance / 64) AS weight FROM (SELECT a AS x, distance FROM p UNION ALL SELECT b, distance FROM p) GROUP BY 1),
k AS (SELECT component, node, hops, row_number() OVER (PARTITION BY component ORDER BY hops, degree DESC, weight DESC, node) AS r FROM c JOIN s USING (node) JOIN d USING (node))
SELECT component, node AS representative, hops FROM k WHERE r = 1""")
def closeness_representatives(spark: SparkSession, sf: str) -> DataFrame:
    pairs = materialize(_near(spark, sf).withColumn("similarity", hashes.similarity(F.col("distance"))), "pairs")
    return duplicates.closeness_representatives(pairs, duplicates.components(pairs), "similarity")


_LINKED = f"{_MASK}, e AS (SELECT l.vec_id AS a, r.vec_id AS b FROM m l JOIN m r ON l.vec_id <> r.vec_id WHERE bit_count(xor(l.bits, r.bits)) <= 20)"


@query(f"""WITH RECURSIVE {_LINKED}, h AS (SELECT a AS source, a AS node, 0 AS hops FROM e UNION SELECT h.source, e.b, hops + 1 FROM h JOIN e ON h.node = e.a WHERE hops < 30)
SELECT source, node, min(hops) AS hops FROM h GROUP BY 1, 2""")
def hop_distances(spark: SparkSession, sf: str) -> DataFrame:
    bits = load(spark, sf, "embeddings").select("vec_id", hashes.sign_bits(F.col("embedding")).alias("bits"))
    near, _ = links(bits, "vec_id", "bits", 20)
    return graph.hop_distances(near, "a", "b")


@query(f"""WITH RECURSIVE m AS (SELECT vec_id, label, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') :: BIT AS bits, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
r AS (SELECT DISTINCT label, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(id BIGINT, bits BIT)[]) AS leads FROM m
  UNION ALL SELECT r.label, r.n + 1, CASE WHEN len(list_filter(leads, lambda l: bit_count(xor(l.bits, m.bits)) <= {_RADIUS + 8})) = 0 THEN list_append(leads, {{'id': m.vec_id, 'bits': m.bits}}) ELSE leads END FROM r JOIN m ON m.label = r.label AND m.n = r.n + 1),
f AS (SELECT label, unnest(arg_max(leads, n)) AS l FROM r GROUP BY 1)
SELECT m.label, m.vec_id, min(f.l.id) AS leader FROM m JOIN f ON m.label = f.label AND bit_count(xor(m.bits, f.l.bits)) <= {_RADIUS + 8} GROUP BY 1, 2""")
def leader_stacks(spark: SparkSession, sf: str) -> DataFrame:
    bits = load(spark, sf, "embeddings").select("vec_id", "label", hashes.sign_bits(F.col("embedding")).alias("bits"))
    return duplicates.leaders(bits, "vec_id", "bits", ["label"], _RADIUS + 8)


@query(f"""WITH RECURSIVE m AS (SELECT vec_id, label, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') :: BIT AS bits, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
r AS (SELECT DISTINCT label, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(id BIGINT, bits BIT)[]) AS leads FROM m
  UNION ALL SELECT r.label, r.n + 1, CASE WHEN len(list_filter(leads, lambda l: bit_count(xor(l.bits, m.bits)) <= {_RADIUS})) = 0 THEN list_append(leads, {{'id': m.vec_id, 'bits': m.bits}}) ELSE leads END FROM r JOIN m ON m.label = r.label AND m.n = r.n + 1),
f AS (SELECT label, unnest(arg_max(leads, n)) AS l FROM r GROUP BY 1)
SELECT m.label, m.vec_id, min(f.l.id) AS leader FROM m JOIN f ON m.label = f.label AND bit_count(xor(m.bits, f.l.bits)) <= {_RADIUS} GROUP BY 1, 2""")
def leader_clusters(spark: SparkSession, sf: str) -> DataFrame:
    bits = load(spark, sf, "embeddings").select("vec_id", "label", hashes.sign_bits(F.col("embedding")).alias("bits"))
    return duplicates.leaders(bits, "vec_id", "bits", ["label"], _RADIUS)


_TURNS = str(hashes.turns(8))
_TURNED = f"""t AS (SELECT {_TURNS} AS turns),
v AS (SELECT vec_id, embedding AS g, list_transform(turns, lambda t: array_to_string(list_transform(t, lambda i: CASE WHEN embedding[i + 1] > 0 THEN '1' ELSE '0' END), '') :: BIT) AS h FROM embeddings, t)"""


@query(f"""WITH {_TURNED}, o AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY g ORDER BY vec_id) = 1),
c AS (SELECT l.vec_id AS a, r.vec_id AS b, l.g AS ga, r.g AS gb, list_transform(r.h, lambda y: CAST(bit_count(xor(l.h[1], y)) AS INT)) AS ds FROM o l JOIN o r ON l.vec_id < r.vec_id),
p AS (SELECT a, b, ga, gb, list_min(ds) AS distance, CAST(list_position(ds, list_min(ds)) - 1 AS INT) AS turn FROM c WHERE list_min(ds) <= 20),
z AS (SELECT a, b, distance, turn, list_transform(range(64), lambda i: {{'a': CAST(ga[i + 1] AS DOUBLE), 'b': CAST(gb[turns[turn + 1][i + 1] + 1] AS DOUBLE)}}) AS cells FROM p, t),
f AS (SELECT *, list_filter(cells, lambda c: abs(c.a - c.b) <= 0.15) AS inside FROM z),
q AS (SELECT a, b, distance, turn, CAST(len(inside) AS INT) AS inliers, len(list_filter(inside, lambda c: c.a > 0)) / len(list_filter(cells, lambda c: c.a > 0)) AS coverage_a,
  len(list_filter(inside, lambda c: c.b > 0)) / len(list_filter(cells, lambda c: c.b > 0)) AS coverage_b, list_sum(list_transform(inside, lambda c: abs(c.a - c.b))) / (len(inside) * 0.15) AS residual FROM f),
s AS (SELECT *, least(0.99, 0.5 * (1 - distance / 64) + 0.25 * least(coverage_a, coverage_b) + 0.15 * least(1.0, inliers / 50) + 0.1 * greatest(0.0, 1 - residual / 3)) AS score FROM q WHERE inliers >= 25 AND coverage_a >= 0.5 AND coverage_b >= 0.5 AND residual <= 3)
SELECT a, b, distance, turn, inliers, round(coverage_a, 6) AS coverage_a, round(coverage_b, 6) AS coverage_b, round(residual, 6) AS residual, round(score, 6) AS score FROM s WHERE score >= 0.6""")
def variant_pairs(spark: SparkSession, sf: str) -> DataFrame:
    found = variants.variant_pairs(load(spark, sf, "embeddings"), "vec_id", "embedding", 8, 20, 0.6, 0.15)
    return found.select("a", "b", "distance", "turn", "inliers", *(F.round(c, 6).alias(c) for c in ("coverage_a", "coverage_b", "residual", "score")))


@query(f"""WITH {_TURNED},
k AS (SELECT vec_id, h, vec_id % 4 = 3 AS new, 100 + vec_id % 60 AS points, 640 + 10 * (vec_id % 7) AS w, 480 + 10 * (vec_id % 5) AS ht, vec_id * 37 % 1000 AS bytes FROM v),
c AS (SELECT n.vec_id AS vec_id, s.vec_id AS match_id, n.points AS pn, s.points AS ps, n.w AS wn, n.ht AS hn, s.w AS ws, s.ht AS hs, n.bytes AS bn, s.bytes AS bs, list_min(list_transform(s.h, lambda y: CAST(bit_count(xor(n.h[1], y)) AS INT))) AS distance FROM k n JOIN k s ON n.new AND NOT s.new),
d AS (SELECT *, 1 - distance / 64 AS sim FROM c WHERE distance <= 20), e AS (SELECT *, sim AS score FROM d WHERE sim < 0.99 UNION ALL
  SELECT *, CASE WHEN pn < 120 OR ps < 120 THEN 0.98 WHEN abs(wn / hn - ws / hs) <= 0.15 THEN 1.0 ELSE 0.99 END FROM d WHERE sim >= 0.99),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY match_id) AS r FROM e WHERE score >= 0.7)
SELECT vec_id, match_id, distance, score, CASE WHEN score >= 0.98 THEN 'exact_dupe' WHEN score >= 0.75 THEN 'quality_dupe' END AS verdict, ws * hs > wn * hn OR (ws * hs = wn * hn AND bs >= bn) AS keep_existing FROM r WHERE r = 1""")
def stored_matches(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("vec_id")
    facts = {"points": 100 + k % 60, "width": 640 + 10 * (k % 7), "height": 480 + 10 * (k % 5), "bytes": k * 37 % 1000}
    rows = load(spark, sf, "embeddings").select(k.alias("id"), k.alias("place"), hashes.turned_bits(F.col("embedding"), 8).alias("hashes"), *(c.alias(n) for n, c in facts.items()))
    stored = Collection.create(spark, new_path(spark, "collection"), 20, rows.count())
    for batch in (0, 1):  # two generations in scan order
        stored.add(rows.where("id % 4 <> 3").where((F.col("id") < 300) == (batch == 0)))
    score = lambda p: hashes.safe_similarity(hashes.similarity(F.col("distance")), F.lit(0), F.lit(0.0), F.lit(0.0), F.lit(None).cast("double"), F.lit(None).cast("string"), F.col("points"), p["stored"]["points"], F.col("width"), F.col("height"), p["stored"]["width"], p["stored"]["height"])
    new = rows.where("id % 4 = 3").withColumn("hashes", F.slice("hashes", 1, 1))
    found = stored.first_matches(new, lambda p: score(p) >= 0.7)
    old = rows.select(F.col("id").alias("match_id"), F.struct("points", "width", "height", "bytes").alias("stored"))
    both = found.join(old, "match_id")
    keeps = media.keeps_existing(F.col("width") * F.col("height"), F.col("bytes"), F.col("stored.width") * F.col("stored.height"), F.col("stored.bytes"))
    return both.select(F.col("id").alias("vec_id"), "match_id", "distance", score(both).alias("score"), hashes.match_verdict(score(both)).alias("verdict"), keeps.alias("keep_existing"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS g, o_totalprice / 100 AS v FROM orders),
p AS (SELECT l.g, l.k AS a, r.k AS b, row_number() OVER (PARTITION BY l.g, l.k ORDER BY r.v, r.k) AS n FROM o l JOIN o r
  ON l.g = r.g AND r.v BETWEEN l.v AND l.v + greatest(0.35, l.v * 0.015) AND (r.v > l.v OR r.k > l.k) AND r.v - l.v <= greatest(0.35, l.v * 0.015))
SELECT g, a, b FROM p WHERE n <= 60""")
def duration_band_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("g"), (F.col("o_totalprice") / 100).alias("v"))
    return duplicates.band_pairs(rows, "v", "k", ["g"]).select("g", "a", "b")


# Events -------------------------------------------------------------------------------------------------------------------


@query("""WITH x AS (SELECT user_id, ts, event_id, event_type = 'click' AS c FROM events WHERE event_type IN ('click', 'purchase')),
y AS (SELECT *, max(CASE WHEN c THEN (ts, event_id) END) OVER (PARTITION BY user_id ORDER BY ts, c DESC, event_id ROWS UNBOUNDED PRECEDING) AS l FROM x)
SELECT user_id AS key, l[2] AS cause, min((ts, event_id))[2] AS effect FROM y WHERE NOT c AND l IS NOT NULL AND ts <= l[1] + INTERVAL 60 MINUTE GROUP BY 1, 2""")
def correlate_after_play(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    return events.first_within(load(spark, sf, "events"), "user_id", "ts", "event_id", kind == "click", kind == "purchase", 3600).select("key", "cause", "effect")


@query("""WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
y AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM x)
SELECT user_id, CAST(run AS BIGINT) AS run, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS events FROM y GROUP BY 1, 2""")
def debounce_runs(spark: SparkSession, sf: str) -> DataFrame:
    runs = events.gap_sessions(load(spark, sf, "events"), ["user_id"], "ts", 12 * 3600)
    return runs.select("user_id", "run", F.unix_micros(F.col("first_ts").cast("timestamp")).alias("first_us"), F.unix_micros(F.col("last_ts").cast("timestamp")).alias("last_us"), "events")


@query("""SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER w AS ps, lag(ts) OVER w AS pt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE ps = event_type AND ts - pt <= INTERVAL 2 HOUR""")
def dup_invocation(spark: SparkSession, sf: str) -> DataFrame:
    return events.repeated_within(load(spark, sf, "events"), ["user_id"], "event_type", "ts", "event_id", 7_200_000).select("event_id", "user_id", "event_type")


@query("""WITH RECURSIVE x AS (SELECT user_id AS key, epoch_us(ts) // 1000000 AS e, epoch_us(ts) // 1000000 - CAST(floor(value) AS BIGINT) * 300 AS s, event_type <> 'error' AS ok FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY e, s, ok) AS n FROM x),
r AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS ok_at, CAST(0 AS BIGINT) AS failed_at, CAST(0 AS BIGINT) AS failures, CAST(0 AS BIGINT) AS retry_at FROM x
  UNION ALL SELECT r.key, o.n, CASE WHEN stale THEN ok_at WHEN ok THEN e ELSE 0 END, CASE WHEN stale THEN failed_at WHEN ok THEN 0 ELSE e END, CASE WHEN stale THEN failures WHEN ok THEN 0 ELSE least(failures + 1, 10) END,
    CASE WHEN stale THEN retry_at WHEN ok THEN 0 ELSE e + least(60 * CAST(2 ** least(failures, 9) AS BIGINT), 1800) END
  FROM r JOIN (SELECT * FROM o) o ON o.key = r.key AND o.n = r.n + 1, LATERAL (SELECT failed_at > s OR (NOT ok AND ok_at > s) AS stale))
SELECT key AS user_id, CASE WHEN ok_at > 0 THEN 'healthy' ELSE 'failing' END AS event, ok_at, failed_at, failures, retry_at FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1""")
def health_states(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream of checks: state by user after the last one."""
    from millrace.streaming import health

    events_at, out = f"{sf}/events.parquet", new_path(spark, "health")
    # a pattern, since a stream reads folders and patterns but no single file
    checks = spark.readStream.schema(spark.read.parquet(events_at).schema).parquet(f"{sf}/events.parque[t]")
    ts = F.col("ts").cast("timestamp")
    checks = checks.select("user_id", F.timestamp_seconds(F.unix_seconds(ts) - F.floor("value") * 300).alias("began"), ts.alias("ended"), (F.col("event_type") != "error").alias("ok"))
    health.keep_state_in_rocksdb(spark)
    found = health.states(checks, "user_id", "began", "ended", "ok")
    run = found.writeStream.outputMode("update").option("checkpointLocation", f"{out}-mark").trigger(availableNow=True)
    run.foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/part={n}")).start().awaitTermination()
    rows = spark.read.parquet(out).where("event IN ('healthy', 'failing')")
    last = rows.groupBy("key").agg(F.max_by(F.struct("event", "ok_at", "failed_at", "failures", "retry_at"), "batch").alias("s"))
    return last.select(F.col("key").alias("user_id"), "s.*")


_POINTS_OF = {"click": 40, "view": 25, "purchase": 35, "signup": 20, "error": -30}


@query("WITH k AS (SELECT DISTINCT user_id, event_type FROM events) SELECT user_id, count(*) AS kinds, CAST(least(100, greatest(0, sum(CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _POINTS_OF.items()) + " ELSE 0 END))) AS BIGINT) AS confidence FROM k GROUP BY 1")
def evidence_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return events.confidence(load(spark, sf, "events"), "user_id", "event_type", _POINTS_OF)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_state(spark: SparkSession, sf: str) -> DataFrame:
    return events.latest(load(spark, sf, "events"), ["user_id"], "ts", "event_id", "event_type").select("user_id", "event_id", "event_type")


@query("SELECT o_orderpriority AS job, count(*) AS items, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS bytes FROM orders GROUP BY 1")
def job_ledger(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").withColumnRenamed("o_orderpriority", "job")
    return events.ledger(orders, "job", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("bigint"), ["F", "O", "P"])


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS n_a, count(*) FILTER (event_type = 'view') AS n_b, CASE WHEN n_a > n_b THEN 'click' WHEN n_b > n_a THEN 'view' END AS majority FROM events GROUP BY 1")
def vote_majority(spark: SparkSession, sf: str) -> DataFrame:
    return events.majority(load(spark, sf, "events"), "user_id", F.col("event_type"), "click", "view")


_LINES = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query(f"""WITH x AS (SELECT *, CAST(l_quantity AS BIGINT) AS n, CASE WHEN l_linenumber % 3 = 1 THEN l_partkey END AS o FROM lineitem),
y AS (SELECT *, count(o) OVER (PARTITION BY l_orderkey ORDER BY {_LINES} ROWS UNBOUNDED PRECEDING) AS run FROM x)
SELECT l_orderkey, l_linenumber, CAST(coalesce(first_value(o) OVER w, 0) + sum(n) OVER w - n AS BIGINT) AS range_start, CAST(coalesce(first_value(o) OVER w, 0) + sum(n) OVER w AS BIGINT) AS range_end
FROM y WINDOW w AS (PARTITION BY l_orderkey, run ORDER BY {_LINES} ROWS UNBOUNDED PRECEDING)""")
def byte_ranges(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("bigint").alias("length"), F.struct(*_LINES.split(", ")).alias("place"))
    out = events.running_offsets(rows, ["l_orderkey"], "place", "length", F.when(F.col("l_linenumber") % 3 == 1, F.col("l_partkey")))
    return out.select("l_orderkey", "l_linenumber", "range_start", "range_end")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked_at FROM conversations")
def carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "conversations").select("conv_id", "turn", "role")
    return events.carried(rows, ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("turn")), "asked_at").select("conv_id", "turn", "asked_at")


@query("SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns, CAST(sum(length(text)) AS BIGINT) AS chars, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations GROUP BY 1")
def conversation_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return ledgers.conversations(load(spark, sf, "conversations"), "conv_id", "turn", "role", "text")


# Pages, playlists, caches, samples ------------------------------------------------------------------------------------------

_URL = r"'^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$'"
_LINK = rf"""u AS (SELECT page_id, url, regexp_extract(url, '^([A-Za-z]+)://', 1) AS s, lower(regexp_extract(url, {_URL}, 1)) AS h, regexp_extract(url, {_URL}, 2) AS p,
  list_filter(string_split(substr(regexp_extract(url, {_URL}, 3), 2), '&'), lambda x: x <> '' AND NOT list_contains([{", ".join(f"'{t}'" for t in urls.TRACKING)}], string_split(x, '=')[1])) AS q, regexp_extract(url, {_URL}, 4) AS f FROM pages),
k AS (SELECT page_id, h, s || '://' || h || CASE WHEN length(p) > 1 AND p LIKE '%/' THEN regexp_replace(p, '/$', '') WHEN p = '' THEN '/' ELSE p END
  || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END || CASE WHEN regexp_matches(f, '^#[/!]') THEN f ELSE '' END AS key FROM u)"""


@query(f"WITH {_LINK} SELECT page_id, key FROM k")
def url_keys(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", urls.link_key(F.col("url")).alias("key"))


@query(f"WITH {_LINK} SELECT key, count(*) AS n, min(page_id) AS first_page FROM k GROUP BY 1")
def url_groups(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").groupBy(urls.link_key(F.col("url")).alias("key")).agg(_n(), F.min("page_id").alias("first_page"))


@query(f"WITH {_LINK} SELECT regexp_extract(h, '([^.]+\\.[^.]+)$', 1) AS site, count(*) AS n FROM k GROUP BY 1")
def site_counts(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").groupBy(urls.site(F.col("url")).alias("site")).agg(_n())


@query(
    rf"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1)) AS link FROM pages)
SELECT page_id, CASE WHEN regexp_matches(link, '^https?://') THEN link ELSE regexp_extract(url, '^([A-Za-z]+)://', 1) || '://' || regexp_extract(url, {_URL}, 1) || link END AS link, count(*) AS n
FROM l WHERE regexp_matches(link, '^(https?://|/[^/])') GROUP BY 1, 2"""
)
def html_links(spark: SparkSession, sf: str) -> DataFrame:
    links = load(spark, sf, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(r'<a[^>]*href="([^"]*)"'), F.lit(1))).alias("raw"))
    absolute = links.where(F.col("raw").rlike("^(https?://|/[^/])")).select("page_id", urls.resolve(F.col("raw"), F.col("url")).alias("link"))
    return absolute.groupBy("page_id", "link").agg(_n())


@query(f"""SELECT CASE WHEN regexp_matches(url, '(?i)\\.(mp4|webm|mov)(?:$|[?#])') THEN 'video' WHEN regexp_matches(url, '(?i)\\.(jpe?g|png|gif)(?:$|[?#])') THEN 'image' END AS kind,
  CASE WHEN regexp_matches(url, '(?i)\\.(mp4|webm|mov|jpe?g|png|gif)(?:$|[?#])') THEN 'extension' ELSE 'unclassified' END AS signal, count(*) AS n FROM pages GROUP BY 1, 2""")
def media_classes(spark: SparkSession, sf: str) -> DataFrame:
    kind = mime.classify(F.col("url"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return load(spark, sf, "pages").select(kind.alias("c")).groupBy(F.col("c.kind").alias("kind"), F.col("c.signal").alias("signal")).agg(_n())


@query("""WITH e AS (SELECT page_id % 3 AS source, page_id AS line, regexp_replace(url, '[?#].*$', '') AS location FROM pages),
f AS (SELECT *, row_number() OVER (PARTITION BY lower(location) ORDER BY source, line) AS r FROM e)
SELECT source, line, location FROM f WHERE r = 1""")
def playlist_merge(spark: SparkSession, sf: str) -> DataFrame:
    from millrace.sources.playlists import merge_entries

    entries = load(spark, sf, "pages").select((F.col("page_id") % 3).alias("source"), F.col("page_id").alias("line"), F.regexp_replace("url", r"[?#].*$", "").alias("location"))
    return merge_entries(entries)


@query("SELECT d.doc_id, l.quality, l.doc_id IS NULL AS pending FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def cache_join(spark: SparkSession, sf: str) -> DataFrame:
    docs, version = load(spark, sf, "documents").select("doc_id"), F.lit(1).alias("version")
    hits, pending = probes.split_by_cache(docs, load(spark, sf, "labels").select("doc_id", "quality", version), 1, ("doc_id",))
    return hits.select("doc_id", "quality", F.lit(False).alias("pending")).unionByName(pending.select("doc_id", F.lit(None).cast("int").alias("quality"), F.lit(True).alias("pending")))


@query("SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE n_chars >= 1000)")
def cache_prune(spark: SparkSession, sf: str) -> DataFrame:
    return probes.prune(load(spark, sf, "labels"), load(spark, sf, "documents").where("n_chars >= 1000"), "doc_id").select("doc_id", "quality")


@query("SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents WHERE lang = 'en'")
def stale_keys(spark: SparkSession, sf: str) -> DataFrame:
    return ledgers.not_done(load(spark, sf, "labels").select("doc_id"), load(spark, sf, "documents").where("lang = 'en'"), "doc_id").distinct()


@query("SELECT source, sha256(CAST(sum(CAST('0x' || substr(sha256(doc_id || '|' || n_chars), 1, 15) AS BIGINT)) AS VARCHAR) || '|' || count(*)) AS digest, count(*) AS n FROM documents GROUP BY 1")
def snapshot_digest(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.snapshot_digest(load(spark, sf, "documents"), ["source"], "doc_id", "n_chars")


@query("""SELECT lang, source, doc_id FROM (SELECT *, row_number() OVER w AS a, count(*) OVER (PARTITION BY lang, source) AS n FROM documents WINDOW w AS (PARTITION BY lang, source ORDER BY doc_id)) WHERE n <= 7 OR a <= 4 OR a > n - 3""")
def head_tail_sample(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.head_and_tail(load(spark, sf, "documents").select("lang", "source", "doc_id"), 7, ["lang", "source"], F.col("doc_id"))


@query("""WITH c AS (SELECT *, CASE WHEN n_chars >= 4000 THEN 2 WHEN n_chars >= 1000 THEN 1 ELSE 0 END AS p FROM documents),
d AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY p DESC, doc_id) AS a FROM c),
e AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY p DESC, doc_id) AS b FROM d WHERE a <= 20) SELECT lang, source, doc_id FROM e WHERE b <= 80""")
def category_cap(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("lang", "source", "doc_id", "n_chars")
    priority = F.when(F.col("n_chars") >= 4000, 2).when(F.col("n_chars") >= 1000, 1).otherwise(0)
    return inventory.capped_selection(docs, ["lang"], "source", 20, 80, priority, F.col("doc_id")).select("lang", "source", "doc_id")


@query("""SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 0 THEN 'review' WHEN n_chars < 200 THEN 'short' WHEN lang = 'en' THEN 'main' ELSE 'other' END AS class, n_chars >= 10000 AS large
FROM documents d LEFT JOIN labels USING (doc_id)""")
def rule_classify(spark: SparkSession, sf: str) -> DataFrame:
    from millrace.operators.rules import Rule, apply_rules

    docs = load(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(load(spark, sf, "labels"), "doc_id", "left")
    rules = [Rule("reject", F.col("toxic") == 1), Rule("review", F.col("quality") == 0), Rule("short", F.col("n_chars") < 200), Rule("main", F.col("lang") == "en"), Rule("large", F.col("n_chars") >= 10000, goes_on=True)]
    return apply_rules(docs, rules, "other").select("doc_id", "class", "large")


@query(r"SELECT page_id, regexp_replace(url, '(https?://[^\s?#]+)\?[^\s#]*', '\1?…') AS redacted FROM pages")
def redact_urls(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", urls.redact_queries(F.col("url")).alias("redacted"))


@query()
def name_similarity(spark: SparkSession, sf: str) -> DataFrame:
    from millrace.functions.names import similarity

    part = load(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    order = W.partitionBy("p_brand").orderBy("p_partkey")
    pairs = part.select("p_partkey", "p_name", F.lag("p_name").over(order).alias("other")).where("other is not null")
    return pairs.select("p_partkey", similarity("p_name", "other").alias("similarity"))


@query()
def similar_names(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of distinct names within a brand."""
    return alike.similar_names(load(spark, sf, "part"), "p_partkey", "p_name", ["p_brand"])


@query("""WITH p AS (SELECT lang, source, doc_id, CASE WHEN n_chars >= 4000 THEN 2 WHEN n_chars >= 1000 THEN 1 ELSE 0 END AS p FROM documents),
n AS (SELECT lang, p, count(*) AS n FROM p GROUP BY 1, 2), r AS (SELECT lang, p, n, greatest(0, 60 - coalesce(sum(n) OVER (PARTITION BY lang ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS room FROM n),
a AS (SELECT p.*, n, room, row_number() OVER (PARTITION BY lang, p.p ORDER BY doc_id) AS i FROM p JOIN r USING (lang, p))
SELECT lang, doc_id FROM a WHERE n <= room OR i <= ceil(room / 2) OR i > n - floor(room / 2)""")
def budget_selection(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("lang", "doc_id", "n_chars")
    priority = F.when(F.col("n_chars") >= 4000, 2).when(F.col("n_chars") >= 1000, 1).otherwise(0)
    return selection.budgeted(docs, ["lang"], 60, priority, F.col("doc_id")).select("lang", "doc_id")


@query("""WITH d AS (SELECT p_partkey AS id, p_partkey * 3 AS x0, CAST(round(p_retailprice * 10) AS BIGINT) AS y0, p_partkey * 3 + p_size * 20 AS x1, CAST(round(p_retailprice * 10) AS BIGINT) + 400 AS y1 FROM part)
SELECT a.id AS a, count(*) AS n FROM d a JOIN d b ON a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 GROUP BY 1""")
def rectangle_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    x, y = F.col("p_partkey") * 3, F.round(F.col("p_retailprice") * 10).cast("bigint")
    boxes = load(spark, sf, "part").select(F.col("p_partkey").alias("id"), x.alias("x0"), y.alias("y0"), (x + F.col("p_size") * 20).alias("x1"), (y + 400).alias("y1"))
    return selection.intersecting(boxes, boxes, cell=512).groupBy("a").agg(_n())


@query("""SELECT c_custkey, 4 * CAST(c_acctbal >= 0 AS INT) + 2 * CAST(c_mktsegment <> 'AUTOMOBILE' AS INT) AS score FROM customer ORDER BY score DESC, c_custkey LIMIT 64""")
def instance_ranking(spark: SparkSession, sf: str) -> DataFrame:
    score = selection.instance_score(F.col("c_acctbal") < 0, F.col("c_mktsegment") == "AUTOMOBILE")
    return load(spark, sf, "customer").select("c_custkey", score.alias("score")).orderBy(F.desc("score"), "c_custkey").limit(64)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def viewport_page(spark: SparkSession, sf: str) -> DataFrame:
    return selection.page(load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 101, 150, F.desc("o_totalprice"), F.col("o_orderkey"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 1 THEN 'download_interrupted' WHEN s_nationkey < 3 THEN 'html_response' WHEN s_acctbal < 0 THEN 'zero_bytes' WHEN s_acctbal * 10 < 2048 THEN 'implausible_size' END AS failure FROM supplier""")
def download_checks(spark: SparkSession, sf: str) -> DataFrame:
    size = F.when(F.col("s_acctbal") < 0, 0).otherwise(F.col("s_acctbal") * 10)
    state = F.when(F.col("s_suppkey") % 2 == 1, "in_progress").otherwise("complete")
    kind = F.when(F.col("s_nationkey") < 3, "text/html").otherwise("image/png")
    failure = selection.download_failure(state, kind, size, F.lit(None).cast("double"), F.lit("image"), F.lit(False), F.lit(True), F.lit(None).cast("string"), F.lit(True))
    return load(spark, sf, "supplier").select("s_suppkey", failure.alias("failure"))


@query("SELECT n_nationkey, r_name || '/' || n_name || '-' || n_nationkey || '.txt' AS name FROM nation JOIN region ON n_regionkey = r_regionkey")
def rendered_names(spark: SparkSession, sf: str) -> DataFrame:
    both = load(spark, sf, "nation").join(F.broadcast(load(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select("n_nationkey", markup.rendered("{region}/{nation}-{k}.txt", {"region": F.col("r_name"), "nation": F.col("n_name"), "k": F.col("n_nationkey")}).alias("name"))


@query("""WITH w AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_type <> 'error'), a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 150)
SELECT w.user_id, count(*) AS kinds FROM w LEFT JOIN a ON w.user_id = a.user_id WHERE a.user_id IS NULL GROUP BY 1""")
def protected_cards(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events").select("user_id", "event_type", "value")
    kept = rows.where("event_type <> 'error'").select("user_id", "event_type").distinct().join(rows.where("event_type = 'error' AND value > 150"), "user_id", "left_anti")
    return kept.groupBy("user_id").agg(_n(name="kinds"))


@query("""WITH e AS (SELECT o_custkey, o_orderdate, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) SELECT o_custkey, count(*) AS kept FROM e WHERE r <= 20 GROUP BY 1""")
def bounded_retention(spark: SparkSession, sf: str) -> DataFrame:
    kept = ledgers.newest(load(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], 20, F.desc("o_orderdate"), F.desc("o_orderkey"))
    return kept.groupBy("o_custkey").agg(_n(name="kept"))


@query("""WITH e AS (SELECT user_id, event_type, count(*) AS n, min(ts) AS t FROM events GROUP BY 1, 2) SELECT user_id, arg_max(event_type, (n, -epoch_us(t))) AS method FROM e GROUP BY 1""")
def mode_of_methods(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "events").groupBy("user_id", "event_type").agg(_n(), F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"))
    return n.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", -F.col("t"))).alias("method"))


@query("""WITH f AS (SELECT o_orderstatus AS code, count(*) AS n, list(o_orderkey ORDER BY o_orderkey)[1:3] AS s FROM orders GROUP BY 1) SELECT code, n, array_to_string(s, ',') AS samples FROM f""")
def failure_causes(spark: SparkSession, sf: str) -> DataFrame:
    return ledgers.causes(load(spark, sf, "orders").select(F.col("o_orderstatus").alias("code"), "o_orderkey"), "code", "o_orderkey")