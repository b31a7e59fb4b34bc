"""Directory ingestion, resumed evaluation runs and the vector cache, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexoria.operators import runner
from lexoria.operators.publishing import Publication
from lexoria.sources import corpus
from lexoria.sources.shared import checkpoints, fresh_folder
from lexoria.streaming.directory import DirectoryIngest, ingest_directory

from .q_evaluation import _CASES, cases


def directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files made of the documents, a folder a source, ingested in two runs and published."""
    folder = fresh_folder(spark, "files")
    d = corpus.table(spark, sf_dir, "documents").select("source", "doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]+", " ").alias("value"))
    write = lambda rows, name: rows.select("source", "value").write.partitionBy("source").option("compression", "none").text(f"{folder}/in/{name}")
    ingest, publication = DirectoryIngest(spark, f"{folder}/in", f"{folder}/state"), Publication(spark, f"{folder}/published")
    write(d.filter("doc_id % 2 = 0"), "a")
    ingest_directory(ingest, publication, "first")
    write(d.filter("doc_id % 2 = 1"), "b")
    ingest_directory(ingest, publication, "second")
    lines = publication.read().select(F.regexp_extract("path", "source=([^/]+)", 1).alias("source"), F.explode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).alias("line"))
    return lines.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.length("line")).alias("chars"))


def resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over all cases, stopped after three of its rounds, and resumed by another."""
    from lexoria.operators import evaluation as ev

    score = lambda c: c.select("doc_id", "split", ev.behavior_match().alias("behavior_match"))
    folder = fresh_folder(spark, "run")
    runner.EvaluationRun(cases(spark, sf_dir), folder, id_col="doc_id").advance(score, 3)
    done = runner.EvaluationRun(cases(spark, sf_dir), folder, id_col="doc_id").advance(score)
    return done.groupBy("split").agg(F.count("*").alias("cases"), F.count_if("behavior_match").alias("matched"))


CAPACITY, TTL_DAYS = 100, 3


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache after the questions of each of the last days: users are keys, the vector of a key is
    made on the day on which it is asked and missing."""
    checkpoints(spark)
    e = corpus.table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("key"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day"))
    last = e.agg(F.max("day")).first()[0]
    held = spark.createDataFrame([], "key long, embedding array<double>, created_at timestamp, used_at timestamp")
    for back in range(4, -1, -1):
        now = F.lit(last) - F.make_dt_interval(F.lit(back))
        asked = e.filter(F.col("day") == now).select("key")
        missing = runner.cached(held, asked, now, TTL_DAYS * 86_400).filter("embedding IS NULL")
        made = missing.select("key", F.array(F.col("key") * 1.0, F.lit(float(back))).alias("embedding"))
        held = runner.cache_after(held, asked, made, now, TTL_DAYS * 86_400, CAPACITY).checkpoint()
    return held.select("key", F.col("embedding")[1].alias("made_back"), F.date_diff(F.lit(last).cast("date"), F.col("used_at").cast("date")).alias("used_back"))


QUERIES = {"ingest_directory": directory, "evaluation_runner": resumed, "query_embedding_cache": cache}


def _cache_sql() -> str:
    steps = ["c5 AS (SELECT 0::BIGINT AS key, 0 AS made, 0 AS used WHERE FALSE)"]
    for back in range(4, -1, -1):
        steps.append(f"""a{back} AS MATERIALIZED (SELECT DISTINCT user_id::BIGINT AS key FROM events, m WHERE date_trunc('day', ts) = m.last - INTERVAL {back} DAY),
c{back} AS MATERIALIZED (SELECT key, coalesce(CASE WHEN c.made - {back} < {TTL_DAYS} THEN c.made END, {back}) AS made, CASE WHEN a.k IS NOT NULL THEN {back} ELSE c.used END AS used FROM c{back + 1} c FULL JOIN (SELECT key, key AS k FROM a{back}) a USING (key)
  WHERE a.k IS NOT NULL OR c.made - {back} < {TTL_DAYS} ORDER BY used, key LIMIT {CAPACITY})""")
    return "WITH m AS (SELECT max(date_trunc('day', ts)) AS last FROM events),\n" + ",\n".join(steps) + "\nSELECT key, made::DOUBLE AS made_back, used::INTEGER AS used_back FROM c0"


ORACLES = {
    "ingest_directory": "SELECT source, count(*) AS documents, sum(length(regexp_replace(coalesce(text, ''), '[\\r\\n]+', ' ', 'g')))::BIGINT AS chars FROM documents GROUP BY source",
    "evaluation_runner": f"WITH {_CASES} SELECT split, count(*) AS cases, count_if(behavior_match)::BIGINT AS matched FROM judged GROUP BY split",
    "query_embedding_cache": _cache_sql(),
}
