"""More queries of the catalogue over the driver tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import hashes, pixels, urls
from millrace.operators import instances, inventory, ledgers, selection, sets, tree
from millrace.plans.catalogue import query
from millrace.sources.tables import load
from millrace.streaming import events


@query("""SELECT id, first_page, pages FROM (SELECT lower(regexp_extract(url, '://([^/?#]*)', 1)) AS id, min(page_id) AS first_page, count(*) AS pages FROM pages GROUP BY 1)""")
def first_seen_hosts(spark: SparkSession, sf: str) -> DataFrame:
    pages = load(spark, sf, "pages").select("page_id", F.lower(urls.part(F.col("url"), 2)).alias("id"))
    first = sets.first_seen([pages.where("page_id % 2 = 0"), pages.where("page_id % 2 = 1")], F.struct("id", F.col("page_id") % 2), "page_id")
    counts = pages.groupBy("id").agg(F.count(F.lit(1)).alias("pages"))
    return first.groupBy("id").agg(F.min("page_id").alias("first_page")).join(counts, "id")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_custkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def pairs_unchanged(spark: SparkSession, sf: str) -> DataFrame:
    pairs = load(spark, sf, "orders").select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b"))
    changed = load(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    return sets.without_changed(pairs, changed, "l_orderkey").select(F.col("a").alias("o_custkey"), F.col("b").alias("o_orderkey"))


@query("""WITH v AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click'), s AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')
SELECT user_id FROM ((SELECT user_id FROM s EXCEPT SELECT user_id FROM v) UNION ALL (SELECT user_id FROM v EXCEPT SELECT user_id FROM s))""")
def selection_inverted(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").select("user_id", "event_type")
    return sets.inverted(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), "user_id")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS primary_order, count(*) AS members FROM orders GROUP BY 1")
def group_primaries(spark: SparkSession, sf: str) -> DataFrame:
    return sets.primaries(load(spark, sf, "orders"), "o_custkey", "o_orderkey", F.col("o_totalprice")).withColumnRenamed("primary", "primary_order")


@query("SELECT l_returnflag AS code, count(*) FILTER (l_quantity >= 25) AS ok, count(*) FILTER (l_quantity < 25) AS failed, CAST(sum(CASE WHEN l_quantity >= 25 THEN l_linenumber ELSE 0 END) AS BIGINT) AS selected FROM lineitem GROUP BY 1")
def success_split(spark: SparkSession, sf: str) -> DataFrame:
    return ledgers.outcomes(load(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "code"), ["code"], F.col("l_quantity") >= 25, F.col("l_linenumber"))


@query("""SELECT o_orderkey, o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM orders""")
def prefix_sums(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint"))
    return ledgers.running_totals(rows, ["o_custkey"], "cents", "o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey", "cents", "running")


@query("SELECT user_id, min(ts) AS due FROM events WHERE event_type <> 'error' GROUP BY 1")
def next_due(spark: SparkSession, sf: str) -> DataFrame:
    return instances.earliest_due(load(spark, sf, "events").where("event_type <> 'error'"), "user_id", "ts").withColumnRenamed("ts", "due")


@query("""WITH m AS (SELECT max(ts) AS now FROM events), closed AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup')
SELECT event_id, user_id FROM events, m WHERE epoch_us(now) // 1000000 - epoch_us(ts) // 1000000 <= 2592000 AND user_id NOT IN (SELECT user_id FROM closed)""")
def state_alive(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    now = e.agg(F.max("ts").alias("now"))
    rows = e.join(F.broadcast(now))
    return instances.alive(rows, "user_id", F.col("ts"), F.col("now").cast("timestamp"), 30 * 86400, e.where("event_type = 'signup'").select("user_id").distinct()).select("event_id", "user_id")


@query("""WITH d AS (SELECT *, CASE WHEN n_chars >= 4000 THEN 'large' WHEN n_chars >= 1000 THEN 'medium' ELSE 'small' END AS class FROM documents)
SELECT lang, class, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, min(doc_id) AS first, max(doc_id) AS last FROM d GROUP BY 1, 2""")
def kind_counts(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_chars")
    docs = load(spark, sf, "documents").select("lang", "doc_id", n.alias("chars"), F.when(n >= 4000, "large").when(n >= 1000, "medium").otherwise("small").alias("class"))
    return ledgers.kind_counts(docs, ["lang", "class"], "doc_id", "chars")


@query("""SELECT doc_id, text_md5 FROM (SELECT doc_id, md5(text) AS text_md5, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents) WHERE r > 1""")
def repeated_visits(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))
    return ledgers.repeats(docs, "text_md5", "doc_id").select("doc_id", "text_md5")


@query("SELECT c_custkey, substr(sha256('s' || chr(10) || c_custkey || chr(10) || c_nationkey), 1, 24) AS id FROM customer")
def cluster_ids(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").select("c_custkey", hashes.cluster_id(F.lit("s"), F.col("c_custkey"), F.col("c_nationkey")).alias("id"))


@query("SELECT p_partkey, p_name, CAST(p_size AS BIGINT) AS size FROM part ORDER BY p_size DESC, lower(p_name), p_partkey LIMIT 50")
def playlist_by_size(spark: SparkSession, sf: str) -> DataFrame:
    part = load(spark, sf, "part")
    order = selection.playlist_order("size", F.lower("p_name"), F.col("p_size"), F.lit(0), F.lit(None).cast("double"))
    return part.orderBy(*order, "p_partkey").limit(50).select("p_partkey", "p_name", F.col("p_size").cast("bigint").alias("size"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS duration FROM orders ORDER BY CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END DESC NULLS LAST, o_orderkey DESC LIMIT 40")
def playlist_by_duration(spark: SparkSession, sf: str) -> DataFrame:
    duration = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice"))
    order = selection.playlist_order("duration", F.lit(""), F.col("o_orderkey"), F.lit(0), duration)
    return load(spark, sf, "orders").orderBy(*order).limit(40).select("o_orderkey", duration.alias("duration"))


@query("SELECT p_partkey FROM part ORDER BY lower(p_brand), lower(p_name), p_partkey LIMIT 60")
def playlist_by_name(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat_ws("/", "p_brand", "p_name")
    order = selection.playlist_order("name", path, F.lit(0), F.lit(0), F.lit(None).cast("double"))
    return load(spark, sf, "part").orderBy(*order[:2], "p_partkey").limit(60).select("p_partkey")


@query("""WITH s AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) SELECT source, sum(n) AS docs, arg_max(lang, (n, lang)) AS main_lang, count(*) AS langs FROM s GROUP BY 1""")
def source_summary(spark: SparkSession, sf: str) -> DataFrame:
    found = ledgers.main_value(load(spark, sf, "documents"), "source", "lang")
    return found.select("source", F.col("rows").cast("decimal(38,0)").alias("docs"), F.col("main").alias("main_lang"), F.col("values").alias("langs"))


@query("""WITH p AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS a, count(*) OVER (PARTITION BY lang, source) AS n FROM documents) SELECT lang, source, doc_id FROM p WHERE n <= 9 OR a <= 5 OR a > n - 4""")
def sampled_names(spark: SparkSession, sf: str) -> DataFrame:
    return tree.sampled_names(load(spark, sf, "documents").select("lang", "source", "doc_id"), ["lang", "source"], 9, F.col("doc_id"))


@query("""WITH s AS (SELECT page_id, html LIKE '%<html%' AS h FROM pages ORDER BY page_id LIMIT 24) SELECT count(*) AS sampled, count(*) FILTER (h) AS html, count(*) FILTER (h) * 2 > count(*) AS warn FROM s""")
def preflight_warning(spark: SparkSession, sf: str) -> DataFrame:
    return ledgers.preflight(load(spark, sf, "pages"), F.contains("html", F.lit("<html")), 24, F.col("page_id"))


@query("""SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A')""")
def history_misses(spark: SparkSession, sf: str) -> DataFrame:
    done = load(spark, sf, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    fresh = ledgers.not_done(load(spark, sf, "orders"), done, "o_orderkey")
    return fresh.join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey", "o_totalprice")


@query()
def pixel_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """The first 64 numbers of each embedding as an image of 8 x 8."""
    image = load(spark, sf, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 64), lambda x: x.cast("double")).alias("p"), F.lit(8).alias("w"))
    return image.select("vec_id", pixels.phash64("p", "w").alias("phash"), pixels.dhash_hex("p", "w").alias("dhash"), pixels.content_signature("p", "w").alias("signature"), F.array_min(pixels.transform_hashes("p", "w")).alias("least_turned"))


@query("""WITH f AS (SELECT ts, event_id, user_id, event_type FROM events WHERE event_type <> 'error'), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM f) SELECT event_id, user_id, event_type FROM r WHERE n = 1""")
def once_per_key(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events").where("event_type <> 'error'").select("event_id", "user_id", "event_type", "ts")
    return sets.first_seen([rows], F.struct("user_id", "event_type"), "ts", "event_id").select("event_id", "user_id", "event_type")


@query("""WITH d AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), o AS (SELECT source, count(*) AS n FROM documents WHERE n_chars > 100 GROUP BY 1) SELECT d.source FROM d LEFT JOIN o USING (source) WHERE d.n IS DISTINCT FROM o.n""")
def changed_roots(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents")
    digest = lambda df: inventory.snapshot_digest(df, ["source"], "doc_id").select("source", "digest")
    return events.changed_keys(digest(docs), digest(docs.where("n_chars > 100")), "source")


@query("""WITH h AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_type = 'purchase'), k AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup')
SELECT DISTINCT e.user_id, CASE WHEN h.user_id IS NOT NULL THEN 'url' WHEN k.user_id IS NOT NULL THEN 'content' END AS reason FROM events e LEFT JOIN h USING (user_id) LEFT JOIN k ON e.user_id = k.user_id""")
def history_reasons(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").select("user_id", "event_type")
    return ledgers.reasons(e, "user_id", (e.where("event_type = 'purchase'"), "url"), (e.where("event_type = 'signup'"), "content"))


@query("""SELECT lang, source, count(*) FILTER (n_chars < 1000) AS omitted, count(*) AS n FROM documents GROUP BY 1, 2""")
def omitted_by_category(spark: SparkSession, sf: str) -> DataFrame:
    return ledgers.omitted(load(spark, sf, "documents"), ["lang", "source"], F.col("n_chars") < 1000)


@query("""SELECT l_orderkey, count(*) AS files, count(DISTINCT l_suppkey) AS folders, count(*) FILTER (l_linenumber > 1) AS moved FROM lineitem GROUP BY 1""")
def move_plan_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ledgers.plan_counts(load(spark, sf, "lineitem"), "l_orderkey", "l_suppkey", F.col("l_linenumber") > 1)


@query("""SELECT sha256(array_to_string(list_sort(list(coalesce(name, '') || '|' || n)), chr(10))) AS signature FROM (SELECT source AS name, count(*) AS n FROM documents GROUP BY 1)""")
def source_signature(spark: SparkSession, sf: str) -> DataFrame:
    """Of the few sources of a table."""
    n = load(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return ledgers.set_signature(n, "source", "n")


@query("""WITH c AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END AS tier FROM events WHERE event_type IN ('purchase', 'click')) SELECT user_id, arg_min(event_id, (tier, -epoch_us(ts), event_id)) AS event_id FROM c GROUP BY 1""")
def tiered_union(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").select("user_id", "event_id", "event_type", (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("age"))
    tiers = [e.where(F.col("event_type") == kind) for kind in ("purchase", "click")]
    return sets.first_seen(tiers, F.col("user_id"), "age", "event_id").select("user_id", "event_id")