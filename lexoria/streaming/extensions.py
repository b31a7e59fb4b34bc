"""Streaming forms of the stateful pieces. Extensions: the reference itself has no streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def gap_rollup(log: DataFrame) -> DataFrame:
    """Knowledge gaps as a streaming aggregation, for the update mode."""
    return log.groupBy("query").agg(F.count("*").alias("occurrences"), F.max("similarity").alias("max_similarity"), F.max("ts").alias("last_seen"))


def windowed_counts(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """Counts and sums in event-time windows; rows later than the watermark are left out."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "2 days") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def cooldown(questions: DataFrame, seconds: float = 10.0) -> DataFrame:
    """(user_id, event_id, admitted): a question is admitted if the user's last admitted one is at
    least ``seconds`` ago. State: one timestamp a user."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        pdf = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        admitted = []
        for ts in pdf["ts"]:
            now = ts.timestamp()
            ok = last is None or now - last >= seconds
            last = now if ok else last
            admitted.append(ok)
        state.update((last,))
        yield pd.DataFrame({"user_id": pdf["user_id"], "event_id": pdf["event_id"], "admitted": admitted})

    return questions.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, admitted boolean", "last double", "append", GroupStateTimeout.NoTimeout)


def last_turns(turns: DataFrame, keep: int = 4) -> DataFrame:
    """(conv_id, turns): the last ``keep`` turn numbers of each conversation after each batch."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        have = list(state.get[0]) if state.exists else []
        have = sorted({*have, *(int(t) for p in parts for t in p["turn"])})[-keep:]
        state.update((have,))
        yield pd.DataFrame({"conv_id": [key[0]], "turns": [",".join(map(str, have))]})

    return turns.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, turns string", "turns array<long>", "update", GroupStateTimeout.NoTimeout)


def drain(df: DataFrame, mode: str, folder: str) -> DataFrame:
    """Run a bounded stream to its end into a folder that all executors share, and read it back: all
    rows of its batches, in complete mode those of the last. A batch that runs twice replaces its own
    rows."""
    spark, kept = df.sparkSession, f"{folder.rstrip('/')}/rows"

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{kept}/batch={batch}")

    q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder.rstrip('/')}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    try:
        rows = spark.read.parquet(kept)
    except AnalysisException:  # no batch had rows
        return spark.createDataFrame([], df.schema)
    if mode == "complete":
        rows = rows.filter(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    return rows.drop("batch")
