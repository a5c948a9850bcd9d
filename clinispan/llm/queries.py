"""The numbered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinispan.llm import ann, delta_lloyd, embedding_join, fingerprints, language_id, line_dedup, merkle, mixing, ngram_join, packing, statements, substring_dedup, url_filter, warc

#: The rules of the URL query: fixed values.
URL_RULES = (
    url_filter.UrlRule("allow", "com", "/"),
    url_filter.UrlRule("block", "example.com", "/en/"),
    url_filter.UrlRule("allow", "www.example.com", "/en/"),
    url_filter.UrlRule("block", "net", "/es/"),
    url_filter.UrlRule("block", "net", "/fr/"),
)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op2_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_and_read(_read(spark, sf_dir, "pages"))
    return records.select(F.col("key").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "n_tokens", "weight", "epoch", "block", "position")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(_read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return kept.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_versions(_read(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))
    learned = language_id.train(docs.where(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return language_id.identify(docs.select("doc_id", "held_out", "text"), learned).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicate_classes(_read(spark, sf_dir, "documents"))


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.near_duplicate_vectors(_read(spark, sf_dir, "embeddings"))


def op12_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta_lloyd.cluster(_read(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    original, tampered = (merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text")) for n in (F.col("n_chars"), more))
    found = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, tampered).otherwise(original)
    return merkle.manifest(docs, original, found)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_nearest_neighbours, op2_warc_packages, op3_best_fit_packing, op4_line_dedup, op5_source_mixing, op6_substring_dedup, op7_url_filter, op8_document_fingerprints, op9_language_id, op10_ngram_jaccard_join, op11_embedding_near_dedup, op12_delta_lloyd, op13_merkle_manifest)
    return {f.__name__: f for f in ops}


#: What DuckDB gives for op7: every rule tried on every page.
_OP7_SQL = """
with parts as (
  select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
rules(verdict, h, p) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits as (
  select page_id, h || p as rule, verdict, row_number() over (partition by page_id order by length(h || p) desc) as n
  from parts join rules on (host = h or host like '%.' || h) and starts_with(path, p))
select parts.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from parts left join (select * from fits where n = 1) f on parts.page_id = f.page_id
"""

#: What DuckDB gives for op2: groups of equal payloads; base 32 from the digest's bits.
_OP2_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, cast(strlen(html) as bigint) as payload_bytes, sha1(html) as hex, max(page_id) over (partition by html) as last from p),
nibbles as (select *, list_transform(range(0, 40), lambda i: instr('0123456789abcdef', hex[i + 1]) - 1) as v from d),
coded as (select *, array_to_string(list_transform(range(0, 32), lambda k:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((v[1 + (5 * k) // 4] * 256 + coalesce(v[2 + (5 * k) // 4], 0) * 16 + coalesce(v[3 + (5 * k) // 4], 0)) // power(2, 7 - (5 * k) % 4)::bigint) % 32]), '') as payload_digest from nibbles)
select page_id, payload_bytes, payload_digest, case when page_id = last then 'response' else 'revisit' end as record_type, case when page_id = last then null else last end as refers_to from coded
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_packages": _OP2_SQL, "op7_url_filter": _OP7_SQL, "op11_embedding_near_dedup": statements.OP11, "op12_delta_lloyd": statements.op12(), "op13_merkle_manifest": statements.OP13}
