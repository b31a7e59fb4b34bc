"""The retrieval corpus as views over tables: documents, sections, chunks, and question batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_folder

DIMENSIONS = 64

#: Question batches of the registered queries: (query_id, vector taken from this vec_id, words, doc_types, modules).
QUESTIONS = [
    (1, 0, "that this", [], []),
    (2, 7, "are with", ["en"], []),
    (3, 42, "", [], ["1", "2"]),
    (4, 101, "und die", ["de", "fr"], []),
    (5, 150, "token or password -the", [], ["3"]),
    (6, 63, '"of the"', [], []),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    joined = e.join(d, e.vec_id == d.doc_id)
    module = F.when(F.col("label") == 9, F.lit("")).otherwise(F.col("label").cast("string"))
    doc = F.expr("vec_id div 5")
    index = (F.col("vec_id") % 5).cast("int")
    return joined.select(
        F.col("vec_id").alias("id"), doc.alias("document_id"), index.alias("chunk_index"), F.col("text").alias("content"),
        F.col("lang").alias("doc_type"), F.col("source").alias("filename"), module.alias("module"),
        (doc * 10 + F.expr("(vec_id % 5) div 2")).alias("section_id"), F.expr("cast((vec_id % 5) div 2 as int)").alias("section_index"), "embedding",
    )


def stored(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written once to the shared folder, for searches that scan them several times: what makes
    them is not made again, and each scan reads the columns it needs. They go when the JVM ends."""
    path = f"{fresh_folder(rows.sparkSession, name)}/rows"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def sections(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """One row a section (of the chunks ``of``): the vector, text and module of its first chunk."""
    c = chunks(spark, sf_dir) if of is None else of
    first = F.struct("chunk_index", "content", "doc_type", "filename", "module", "embedding")
    s = c.groupBy("section_id", "document_id", "section_index").agg(F.min_by(first, "chunk_index").alias("f"), F.count("*").alias("n_chunks"))
    return s.select(F.col("section_id").alias("id"), "document_id", "section_index", F.col("f.content").alias("content"), F.col("f.doc_type").alias("doc_type"), F.col("f.filename").alias("filename"), F.col("f.module").alias("module"), F.col("f.embedding").alias("embedding"), "n_chunks")


def questions(spark: SparkSession, sf_dir: str, rows: list | None = None) -> DataFrame:
    """(query_id, query_text, doc_types, modules, section_ids, query_embedding)."""
    schema = "query_id int, vec_id long, query_text string, doc_types array<string>, modules array<string>"
    asked = spark.createDataFrame(rows or QUESTIONS, schema)
    vectors = table(spark, sf_dir, "embeddings").filter(F.col("vec_id").isin([r[1] for r in rows or QUESTIONS])).select("vec_id", F.col("embedding").alias("query_embedding"))
    return asked.join(vectors, "vec_id").select("query_id", "query_text", "doc_types", "modules", F.array().cast("array<bigint>").alias("section_ids"), "query_embedding")
