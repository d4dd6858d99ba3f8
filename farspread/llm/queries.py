"""The operators applied to their whole tables with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compression_rules, jaccard_join, language_id, mixing, packing, rule_ensemble, substring_dedup, topk_search, toxicity, warc_revisits
from .common import documents, fold

DAY = 86_400_000_000
#: The URL that a seventh of the pages share, and other spellings of parts of URLs.
HOT_URL = "http://Hot.example.com/list?b=2&a=1"
SPELT = {"/en/": "/./%65n/", "/de/": "/x/../%64e/", "/fr/": "/%66r/", "b=2&a=1": "a=1&b=%32"}


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_rules.compression_rules(documents(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what is left of its text; digest columns say how much went."""
    out = substring_dedup.dedup_substrings(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "text", "n_chunks", "n_repeated_chunks", "bytes_cut", "cut_spans")


#: Target weights of the mixture, by key and category, and the weight of every category that isn't named.
MIXTURE = {
    "source": {"src0": 1.5},
    "lang": {"en": 12.0, "de": 3.0, "fr": 3.0, "es": 2.0},
    "topic": {"prose": 25.0, "table": 0.9, "markup": 0.9, "list": 0.2},
}
OTHERS = 1.0


def op3_ipf_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(documents(spark, sf_dir), mixing.target_tables(spark, MIXTURE), others=OTHERS)
    return out.select("doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("tokens"), F.round("mix_probability", 6).alias("probability"), F.col("mix_kept").alias("kept"))


def warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures made from every page: a full response, for a third of the pages a later one, and two revisits, one in nine of
    which saw another version. A seventh of the pages share one URL, where many responses have the same time. The second
    revisit spells its URL in another way."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.md5(F.col("html").cast("binary")).alias("digest"))
    hot = F.pmod(F.col("page_id"), F.lit(7)) == 0
    pages = pages.withColumn("url", F.when(hot, F.lit(HOT_URL)).otherwise(F.col("url")))
    day = F.pmod(F.col("page_id") * 7919, F.lit(365))
    at = day * F.lit(DAY) + F.when(hot, F.pmod(F.col("page_id"), F.lit(24)) * (DAY // 24)).otherwise(F.pmod(F.col("page_id") * 104729, F.lit(86400)) * 1_000_000)
    date = F.concat(F.lit("day "), day.cast("string"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))

    def record(number, url, ts, kind, **headers):
        named = F.create_map(*[x for k, v in headers.items() for x in (F.lit(k.replace("_", "-")), v)])
        return pages.select((F.col("page_id") * 4 + number).alias("record_id"), url.alias("url"), ts.alias("ts"), F.lit(kind).alias("kind"), named.alias("headers"), "page_id")

    own, text = F.col("url"), F.lit("text/html")
    response = record(0, own, at, "response", ETag=quoted(F.col("digest")), Last_Modified=date, Content_Type=text, Date=date)
    later = F.concat(date, F.lit(" + 2"))
    second = record(3, own, at + 2 * DAY, "response", ETag=quoted(F.concat("digest", F.lit("-2"))), Last_Modified=later, Content_Type=text, Date=later).where(F.col("page_id") % 3 == 0)
    tag = F.when(F.pmod(F.col("page_id"), F.lit(9)) == 4, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), quoted(F.col("digest"))))
    first_check = record(1, own, at + 3 * DAY, "revisit", etag=tag, Date=F.concat(date, F.lit(" + 3")), Content_Length=F.lit("0"))
    spelt = own
    for plain, other in SPELT.items():
        spelt = F.replace(spelt, F.lit(plain), F.lit(other))
    next_check = record(2, spelt, at - DAY + F.pmod(F.col("page_id"), F.lit(5)) * DAY, "revisit", last_modified=date, Expires=F.lit("never"))
    return response.unionByName(second).unionByName(first_check).unionByName(next_check).drop("page_id")


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc_revisits.resolve_revisits(warc_records(spark, sf_dir))
    text = F.concat_ws("; ", F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    none = F.lit(-1).cast("long")
    return out.select("record_id", "url", "ts", F.coalesce("response_id", none).alias("response_id"), F.coalesce("response_ts", none).alias("response_ts"), "verdict", F.when(F.col("headers").isNotNull(), text).alias("headers"))


_HOST = r"""regexp_replace(lower(regexp_replace(regexp_extract(u, '^([^/?]*)', 1), '^[^@]*@', '')), ':(80|443)$', '')"""
_QUERY = r"""array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '')), '&')"""
_SPELT = "url"
for _plain, _other in SPELT.items():
    _SPELT = f"replace({_SPELT}, '{_plain}', '{_other}')"
OP4_SQL = rf"""
WITH p AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '{HOT_URL}' ELSE url END AS url, md5(html) AS digest, (page_id * 7919) % 365 AS day,
    ((page_id * 7919) % 365) * {DAY} + CASE WHEN page_id % 7 = 0 THEN (page_id % 24) * {DAY // 24} ELSE ((page_id * 104729) % 86400) * 1000000 END AS seen FROM pages),
pages_at AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^https?://', '', 'i') AS u FROM p),
keyed AS (SELECT *, {_HOST} AS host, regexp_replace(regexp_extract(regexp_replace(u, '^[^/?]*', ''), '^([^?]*)', 1), '/+$', '') AS path, {_QUERY} AS asked FROM pages_at),
c AS (SELECT *, host || path || CASE WHEN asked <> '' THEN '?' || asked ELSE '' END AS key, 'day ' || day AS date FROM keyed),
resp AS (SELECT page_id * 4 AS record_id, key, seen AS ts, digest, date FROM c UNION ALL SELECT page_id * 4 + 3, key, seen + 2 * {DAY}, digest || '-2', date || ' + 2' FROM c WHERE page_id % 3 = 0),
rev AS (SELECT page_id * 4 + 1 AS record_id, url, key, seen + 3 * {DAY} AS ts, CASE WHEN page_id % 9 = 4 THEN 'other' ELSE digest END AS etag, CASE WHEN page_id % 9 = 4 THEN '"other"' ELSE 'W/"' || digest || '"' END AS raw, NULL AS modified, date FROM c
    UNION ALL SELECT page_id * 4 + 2, {_SPELT}, key, seen - {DAY} + (page_id % 5) * {DAY}, NULL, NULL, date, date FROM c),
found AS (SELECT v.record_id, max(struct_pack(ts := r.ts, id := r.record_id, digest := r.digest, date := r.date)) AS r FROM rev v JOIN resp r ON v.key = r.key AND r.ts < v.ts GROUP BY v.record_id),
j AS (SELECT v.*, f.r, CASE WHEN f.r IS NULL THEN 'orphan' WHEN v.etag IS NOT NULL THEN CASE WHEN v.etag = f.r.digest THEN 'matched' ELSE 'mismatch' END WHEN v.modified = f.r.date THEN 'matched' ELSE 'mismatch' END AS verdict FROM rev v LEFT JOIN found f USING (record_id))
SELECT record_id, url, ts, coalesce(r.id, -1) AS response_id, coalesce(r.ts, -1) AS response_ts, verdict,
    CASE WHEN verdict <> 'matched' THEN NULL WHEN etag IS NOT NULL THEN 'content-type=text/html; date=' || date || ' + 3; etag=' || raw || '; last-modified=' || r.date
        ELSE 'content-type=text/html; date=' || r.date || '; etag="' || r.digest || '"; expires=never; last-modified=' || modified END AS headers
FROM j"""


def op5_linear_grouping_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op6_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    profiles = language_id.fit_profiles(docs.where(fold(F.col("doc_id"), 4) != 2))
    out = language_id.predict_languages(docs.select("doc_id", "text"), profiles)
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op7_multi_order_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_join.jaccard_components(documents(spark, sf_dir), n=3, threshold="0.9", per_bucket=50)
    return out.select("doc_id", "n_shingles", "component_id", "n_links")


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.where(fold(F.col("doc_id"), 5) != 0)


def op8_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rules = rule_ensemble.fit_quality(docs, training_labels(spark, sf_dir))
    out = rule_ensemble.score_quality(docs, rules)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    weights = toxicity.fit_toxicity(docs, training_labels(spark, sf_dir))
    out = toxicity.score_toxicity(docs, weights)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = topk_search.search(documents(spark, sf_dir), F.col("doc_id") % 20 == 0, k=10)
    return out.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_compression_bands, op2_substring_dedup, op3_ipf_mix, op4_warc_revisits, op5_linear_grouping_pack, op6_rank_order_language, op7_multi_order_jaccard, op8_rule_ensemble, op9_nnpu_toxicity, op10_block_max_wand, pipeline)}
SQL = {"op3_ipf_mix": mixing.mix_sql(MIXTURE, OTHERS), "op4_warc_revisits": OP4_SQL}
