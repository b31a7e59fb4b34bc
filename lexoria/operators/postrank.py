"""Operators over ranked candidates: dedupe, diversity, interleaving, reranking, abstention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexoria.functions.text import content_hash


def chunk_key() -> Column:
    """content hash + index + content where an index is known, else the id, else file and hash."""
    full = F.concat_ws("|", content_hash(F.col("content")), F.col("chunk_index").cast("string"), F.col("content"))
    return F.coalesce(F.when(F.col("chunk_index").isNotNull() & F.col("content").isNotNull(), full), F.col("id").cast("string"), F.concat_ws("|", "filename", content_hash(F.coalesce("content", F.lit("")))))


def first_of(rows: DataFrame, key: Column, group: list[str], order: list[str]) -> DataFrame:
    """The first row, by ``order``, of each key in each group."""
    w = Window.partitionBy(*group, "_key").orderBy(*order)
    return rows.withColumn("_key", key).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_key", "_n")


def dedupe_chunks(rows: DataFrame, order: list[str]) -> DataFrame:
    return first_of(rows, chunk_key(), ["query_id"], order)


def ordered_distinct(rows: DataFrame, value: str, order: str, limit: int | None = None) -> DataFrame:
    """(query_id, value, place): distinct values by first occurrence."""
    first = rows.groupBy("query_id", value).agg(F.min(order).alias("_at"))
    out = first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("_at", value))).drop("_at")
    return out if limit is None else out.filter(F.col("place") <= limit)


def limit_diversity(rows: DataFrame, order: str = "position", per_section: int = 3, per_document: int = 6, limit: int | None = None) -> DataFrame:
    """Greedy caps in rank order: rejected rows use no quota. Two windows are exact because a
    section lies in one document; a null section is not capped. A document's cap is at least a
    section's."""
    per_document = max(per_section, per_document)
    s = Window.partitionBy("query_id", "section_id").orderBy(order)
    kept = rows.withColumn("_s", F.when(F.col("section_id").isNotNull(), F.row_number().over(s)).otherwise(F.lit(1))).filter(F.col("_s") <= per_section)
    d = Window.partitionBy("query_id", "document_id").orderBy(order)
    kept = kept.withColumn("_d", F.row_number().over(d)).filter(F.col("_d") <= per_document).drop("_s", "_d")
    if limit is not None:
        q = Window.partitionBy("query_id").orderBy(order)
        kept = kept.withColumn("_q", F.row_number().over(q)).filter(F.col("_q") <= limit).drop("_q")
    return kept


def interleave(preferred: DataFrame, challengers: DataFrame, order: str = "position") -> DataFrame:
    """Two preferred rows, then one challenger, until a side ends; (.., slot). The slots are
    arithmetic on each side's own rank and the other side's size."""
    w = Window.partitionBy("query_id").orderBy(order)
    n = preferred.groupBy("query_id").agg(F.count("*").alias("_n"))
    m = challengers.groupBy("query_id").agg(F.count("*").alias("_m"))
    p = preferred.withColumn("_p", F.row_number().over(w)).join(m, "query_id", "left").withColumn("slot", F.col("_p") + F.least(F.floor((F.col("_p") - 1) / 2), F.coalesce("_m", F.lit(0)))).drop("_p", "_m")
    c = challengers.withColumn("_c", F.row_number().over(w)).join(n, "query_id", "left").withColumn("slot", F.col("_c") + F.least(2 * F.col("_c"), F.coalesce("_n", F.lit(0)))).drop("_c", "_n")
    return p.unionByName(c, allowMissingColumns=True)


def should_rerank(rows: DataFrame, order: str = "position", low: float = 0.55, high: float = 0.82) -> DataFrame:
    """(query_id, rerank): more than two rows, the first one's similarity between the bounds, and
    several documents or sections or at least four rows."""
    a = rows.groupBy("query_id").agg(F.count("*").alias("n"), F.min_by("similarity", order).alias("first"), F.countDistinct("document_id").alias("docs"), F.countDistinct("section_id").alias("sections"))
    return a.select("query_id", ((F.col("n") > 2) & F.col("first").between(low, high) & ((F.col("docs") > 1) | (F.col("sections") > 1) | (F.col("n") >= 4))).alias("rerank"))


def rerank(rows: DataFrame, scores: DataFrame, order: str = "position", cap: int = 20) -> DataFrame:
    """The first ``cap`` rows by external score (query_id, id, score), highest first, ties as they
    were; rows without a score and the tail keep their order behind. (.., new_position)"""
    head = F.col(order) <= cap
    joined = rows.join(scores, ["query_id", "id"], "left")
    w = Window.partitionBy("query_id").orderBy(F.when(head & F.col("score").isNotNull(), 0).when(head, 1).otherwise(2), F.when(head, F.col("score")).desc_nulls_last(), order)
    return joined.withColumn("new_position", F.row_number().over(w))


def abstain_reasons(questions: DataFrame, rows: DataFrame, strong: float = 0.62, least: int = 2, margin: float = 0.05, operational: str | None = None) -> DataFrame:
    """(query_id, reason): no_chunks, few_chunks, low_similarity or low_similarity_operational, the
    first that holds; null where the question can be answered."""
    a = rows.groupBy("query_id").agg(F.count("*").alias("n"), F.max("similarity").alias("best"))
    j = questions.select("query_id", "query_text").join(a, "query_id", "left")
    op = F.lower("query_text").rlike(operational) if operational else F.lit(False)
    n, best = F.coalesce("n", F.lit(0)), F.coalesce("best", F.lit(0.0))
    return j.select("query_id", F.when(n == 0, "no_chunks").when(n < least, "few_chunks").when(best < strong, "low_similarity").when(op & (best < strong + margin), "low_similarity_operational").alias("reason"))


def trace_summary(rows: DataFrame) -> DataFrame:
    """One row a question: counts, maxima and distinct origins, documents and sections."""
    return rows.groupBy("query_id").agg(F.count("*").alias("n"), F.max("similarity").alias("max_similarity"), F.max("lexical_score").alias("max_lexical"), F.max("fusion_score").alias("max_fusion"), F.array_join(F.array_sort(F.collect_set("origin")), ",").alias("origins"), F.countDistinct("document_id").alias("documents"), F.countDistinct("section_id").alias("sections"), F.count_if("is_neighbor").alias("neighbors"))
