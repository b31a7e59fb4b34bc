"""The registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .backoff_scores import score_documents
from .collision_search import nearest_neighbours
from .filter_audit import audit_filters
from .jaccard_join import near_duplicates
from .kd_search import exact_top_k
from .merge_dropout import encode_documents
from .mixing import mix_sources
from .oracles import ORACLES
from .quality_model import quality
from .runtime import read
from .secret_scans import RULES, findings_by_path, scan, span_text
from .toxicity import toxicity
from .url_filters import UrlRule, judge_urls
from .vector_codes import vector_codes
from .warc import archive_pages

__all__ = ["ORACLES", "QUERIES", "URL_RULES"]

URL_RULES = [
    UrlRule.parse("block", "com/en/"),
    UrlRule.parse("allow", "example.com/en/7"),
    UrlRule.parse("allow", "net/de/"),
    UrlRule.parse("block", "example.net/de/8"),
    UrlRule.parse("block", "org/es/"),
]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"), URL_RULES).drop("url")


#: A SentencePiece model file with byte fallback, read on the driver.
MODEL_FILE = os.environ.get("LEXORIA_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(read(spark, sf_dir, "documents"), alpha=0.4, min_count=2)
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op3_sentencepiece_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"), MODEL_FILE, dropout=0.1, seed=0)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), threshold=0.3)


def op5_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(read(spark, sf_dir, "embeddings"), k=20, every=20)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), k=5, percent=75)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(read(spark, sf_dir, "embeddings"), k=5, every=50, scale=256.0)


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return _secret_digests(docs, scan(docs)[1])


def secret_scans_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows in two runs: a first version that holds about half of the texts, then all
    documents against the ledger and findings of the first."""
    docs = read(spark, sf_dir, "documents")
    ledger, findings = scan(docs.filter(F.pmod(F.xxhash64("text"), F.lit(2)) == 0))
    return _secret_digests(docs, scan(docs, ledger, findings)[1])


def _secret_digests(docs: DataFrame, findings: DataFrame) -> DataFrame:
    found = findings_by_path(docs, findings)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in RULES if r.base]))
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(read(spark, sf_dir, "pages")).drop("url")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(read(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096.0)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), threshold=0.3)


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_sentencepiece_merge_dropout": op3_sentencepiece_merge_dropout,
    "op4_toxicity": op4_toxicity,
    "op5_approximate_nearest_neighbours": op5_approximate_nearest_neighbours,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_source_mixing": op7_source_mixing,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_secret_scans": op9_secret_scans,
    "op10_warc": op10_warc,
    "op11_vector_codes": op11_vector_codes,
    "op12_filter_audit": op12_filter_audit,
    "op13_quality_classifier": op13_quality_classifier,
    "secret_scans_incremental": secret_scans_incremental,
}
