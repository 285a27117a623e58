"""The queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, codes, decontam, html, jaccard, language, licenses, mixing, pii, quality, sharding, suffix, topk
from .common import table


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", "lang", language.held_out(5, 0).alias("held_out"))
    model = language.fit(docs.filter(~F.col("held_out")))
    return language.identify(docs, model, ["doc_id", "held_out"])


def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(table(spark, sf_dir, "documents"))


def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), words=3, percent=90)


def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mixing.mix(docs).select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "kept")


def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"), ["doc_id"])


def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.filter(F.col("vec_id") % 50 == 0), k=5, scale=256.0)


def external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shuffled(docs, shards=40, seed=1, carry=["doc_id"]).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", language.held_out(3, 1).alias("held_out"))
    model = quality.fit(docs.filter(~F.col("held_out")), table(spark, sf_dir, "labels"))
    return quality.score(docs, model, ["doc_id", "held_out"])


def filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(audit.marked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), "ABCDE")


def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": language_id,
    "op2_suffix_dedup": suffix_dedup,
    "op3_pii_anchors": pii_spans,
    "op4_exact_top_k": exact_top_k,
    "op5_ngram_jaccard": jaccard_join,
    "op6_source_mixing": source_mixing,
    "op7_external_shuffle": external_shuffle,
    "op8_html_text": html_text,
    "op9_benchmark_leaks": benchmark_leaks,
    "op10_quality_mil": quality_score,
    "op11_filter_audit": filter_audit,
    "op12_vector_codes": vector_codes,
    "op13_license_scan": license_scan,
}
#: The other queries can't be said in SQL; tests hold them against brute force.
ORACLE: dict[str, str] = {"op6_source_mixing": mixing.mix_sql(), "op11_filter_audit": audit.audit_sql(), "op12_vector_codes": codes.compress_sql(), "op13_license_scan": licenses.scan_sql()}
