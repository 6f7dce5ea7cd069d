"""One query for each training-data operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, kneser_ney, langid, packing, paragraph_dedup, simhash, token_count, url_filter, weighted_minhash
from .common import table


def vocabulary() -> str:
    """Path of the tokenizer file; resolved where it is called."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    learned = langid.learn(docs.where(~F.coalesce(held_out, F.lit(False))).select("text", "lang"))
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    return langid.predict(rows, learned).drop("text")


def op3_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_minhash.fingerprint_chain(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, radius=2)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())


#: The fixed rules: host, path, verdict.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return got.select("page_id", "host", "path", "rule", "verdict")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())


def op10_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction, op2_language_id, op3_weighted_minhash, op4_decontamination, op5_substring_dedup, op6_simhash,
        op7_packing, op8_url_filter, op9_token_counts, op10_quality_perplexity, pipeline,
    )
}

_HOST = "translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's')"
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE: dict[str, str] = {
    "op8_url_filter": f"""
        WITH u AS (SELECT row_number() OVER () AS i, page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
        r(h, p, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
        f AS (SELECT u.i, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
              FROM u JOIN r ON (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p) GROUP BY u.i)
        SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN f USING (i)""",
    "op4_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS i, doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
        win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') AS g
                FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS k FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM win),
        runs AS (SELECT i, n, k, array_to_string(w[k : k + n - 1], ' ') AS g
                 FROM (SELECT i, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, sizes WHERE len(w) >= n)),
        hits AS (SELECT i, k, n, item_id FROM runs JOIN win USING (n, g)),
        words AS (SELECT i, count(DISTINCT x) AS n_hit FROM (SELECT i, unnest(generate_series(k, k + n - 1)) AS x FROM (SELECT DISTINCT i, k, n FROM hits)) GROUP BY i),
        found AS (SELECT i, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT i, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY i)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words USING (i) LEFT JOIN found USING (i)""",
}
