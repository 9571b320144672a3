"""The queries of this subpackage: each applies an operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontaminate, fim, langid, rules, runs, sharding, simhash, suffix, tokencount, toxicity, urlfilter, warc

BPE_FILE, PIECES_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Rules that come before what is learnt: (verdict, host/path).
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
SHARDS = 8


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = warc.record_digests(warc.write_archives(pages, "page_id", "url", "html"))
    kind = pages.schema["page_id"].dataType
    return found.select(F.expr("nullif(id, 'null')").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("position").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.with_score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(BPE_FILE))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(PIECES_FILE))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return fim.restore(cut).select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def looped(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every tenth text, by h = CRC-32 of the key, with its words from number a on replaced by a loop over the first p of
    them: with g = h // 10 and n words a is g % n, p is 1 + (n - a) // (3 + g % 8). A text without words stays as it is."""
    words = F.filter(F.split(F.coalesce(F.col("_text"), F.lit("")), r"[ \t-\r]+"), lambda w: w != "")
    loop = F.transform("_words", lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.get("_words", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))))
    h, g = F.crc32(F.col(key).cast("string").cast("binary")), F.floor(F.col("_h") / 10)
    found = docs.select(*(c for c in docs.columns if c != text), F.col(text).alias("_text")).withColumn("_h", h)
    found = found.withColumn("_words", F.when(F.col("_h") % 10 == 0, words)).withColumn("_n", F.size("_words"))
    found = found.withColumn("_a", F.try_mod(g, F.col("_n"))).withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8)))
    return found.select(*(c for c in docs.columns if c != text), F.when(F.col("_n") > 0, F.array_join(loop, " ")).otherwise(F.col("_text")).alias(text))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.with_runs(looped(table(spark, sf_dir, "documents").select("doc_id", "text")))
    # the greatest length, then the smallest start and period: the least of these triples
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("short"), r["start"].alias("start"), r["period"].alias("period"))))
    length = -best["short"]
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), length.alias("length"), best["period"].alias("period"), F.floor(1000 * length / best["period"]).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.with_language(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_warc": op2_warc,
    "op3_quality_rules": op3_quality_rules,
    "op4_simhash": op4_simhash,
    "op5_decontaminate": op5_decontaminate,
    "op6_sharding": op6_sharding,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_bpe": op9_bpe,
    "op10_token_counts": op10_token_counts,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_language_id": op13_language_id,
}
#: DuckDB SQL of the queries that SQL can express; the others are tested against brute-force versions.
ORACLE_SQL: dict[str, str] = {
    "op2_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS hex, CAST(CAST(unhex(sha1(body)) AS BIT) AS VARCHAR) AS bits FROM p),
b AS (SELECT page_id, n, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(5), lambda k: CASE WHEN substr(bits, CAST(5 * i + k + 1 AS BIGINT), 1) = '1' THEN 1 << CAST(4 - k AS INT) ELSE 0 END)) AS BIGINT), 1)), '') AS digest FROM d),
t AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS top FROM b)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM t""",
    "op5_decontaminate": r"""
WITH texts AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT side, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM texts),
s AS (SELECT DISTINCT side, id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT id AS item_id, count(*) AS n_shingles FROM s WHERE side = 1 GROUP BY 1),
f AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_found FROM s d JOIN s i ON d.shingle = i.shingle AND d.side = 0 AND i.side = 1 GROUP BY 1, 2)
SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment FROM f JOIN n USING (item_id) WHERE n_found >= 0.8 * n_shingles""",
    "op11_fill_in_middle": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents),
h AS (SELECT doc_id, x, regexp_extract_all(x, '[^\n]*\n|[^\n]+') AS u, list_transform(range(4), lambda k: CAST('0x' || substr(hex, CAST(8 * k + 1 AS BIGINT), 8) AS BIGINT)) AS h FROM t),
c AS (SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle, coalesce(array_to_string(u[b + 1:n], ''), '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN x WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256, sha256(x) AS restored_sha256 FROM p""",
}
