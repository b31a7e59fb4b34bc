"""Record files: evaluation datasets, and append-only logs of runs, traces, failures and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of an evaluation dataset that are read as text; whatever else a record has stays in ``record``.
CASE_COLUMNS = ("id", "question", "expected_behavior", "expected_intent", "source", "split", "answerability")


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark finds it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at))


def read_cases(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """(position, the case columns, record) of a dataset: a JSON object a line, or, without
    ``lines``, one array in a file (such files are small). A record that is no JSON object raises."""
    if lines:
        rows = spark.read.text(path).filter(F.trim("value") != "").select(F.col("value").alias("record"))
    else:
        files = spark.read.text(path, wholetext=True)
        rows = files.select(F.explode(F.from_json("value", "array<string>")).alias("record"))
    entries = rows.withColumn("entries", F.from_json("record", "map<string,string>"))
    checked = entries.withColumn("entries", F.when(F.col("entries").isNull(), F.raise_error(F.concat(F.lit("not a JSON object: "), F.left("record", F.lit(80))))).otherwise(F.col("entries")))
    # Positions rise in the order of the files; they need not be without gaps.
    return checked.select((F.monotonically_increasing_id() + 1).alias("position"), *[F.element_at("entries", c).alias(c) for c in CASE_COLUMNS], "record")


def append(rows: DataFrame, path: str, run_id: str, at: str | Column) -> None:
    """Append rows to a log, under their run. A run that is written again replaces its own rows, so
    that a repeated job leaves no rows twice."""
    moment = F.lit(at).cast("timestamp") if isinstance(at, str) else at
    stamped = rows.withColumn("run_id", F.lit(run_id)).withColumn("written_at", moment)
    stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def read_log(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """A log's rows, of one run or of all; only the run's files are read."""
    rows = spark.read.parquet(path).withColumn("run_id", F.col("run_id").cast("string"))
    return rows if run_id is None else rows.filter(F.col("run_id") == run_id)


def open_failures(spark: SparkSession, path: str, key: str = "filename", count: str = "failed_chunks") -> DataFrame:
    """Of each key the latest report of a log, if it still counts failures."""
    log = read_log(spark, path)
    last = log.groupBy(key).agg(F.max_by(F.col(count), F.struct("written_at", "run_id")).alias(count))
    return last.filter(F.col(count) > 0)
