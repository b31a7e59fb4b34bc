"""Evaluation runs that can be stopped and resumed, and a cache of question vectors with expiry and
eviction."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexoria.sources.shared import CommitLog


class EvaluationRun:
    """A run over cases in rounds, in a folder that all executors share. A round's results count once
    they are committed; a run that was stopped goes on with the cases that no committed round has, and
    its summary is that of a run that was never stopped."""

    def __init__(self, cases: DataFrame, folder: str, rounds: int = 8, id_col: str = "case_id"):
        self.cases, self.folder, self.rounds, self.id_col = cases, folder.rstrip("/"), rounds, id_col
        self.spark = cases.sparkSession
        self.log = CommitLog(self.spark, f"{self.folder}/commits")

    def results(self) -> DataFrame | None:
        """The results of all committed rounds; None before the first."""
        paths = [f"{self.folder}/{entry['rows']}" for _, entry in self.log.entries()]
        return self.spark.read.parquet(*paths) if paths else None

    def pending(self) -> DataFrame:
        """The cases without a result."""
        done = self.results()
        return self.cases if done is None else self.cases.join(done.select(self.id_col).distinct(), self.id_col, "left_anti")

    def advance(self, step: Callable[[DataFrame], DataFrame], most_rounds: int | None = None) -> DataFrame | None:
        """Run rounds of pending cases, all of them or ``most_rounds``. ``step`` gives for cases their
        results, with the id; two runs at once on one folder: one commits a round, the other gets Taken."""
        place = F.pmod(F.xxhash64(self.id_col), F.lit(self.rounds))
        made = {entry["round"] for _, entry in self.log.entries()}
        for r in [r for r in range(self.rounds) if r not in made][:most_rounds]:
            number, _ = self.log.newest()
            rows = f"round-{r}-{uuid.uuid4().hex}"
            step(self.pending().filter(place == r)).write.parquet(f"{self.folder}/{rows}")
            self.log.commit(number, {"round": r, "rows": rows})
        return self.results()


def cached(cache: DataFrame, asked: DataFrame, now: Column, ttl_seconds: float) -> DataFrame:
    """(key, embedding) of each distinct key of ``asked``; the embedding is null where the cache
    (key, embedding, created_at, used_at) has none that is younger than the time to live."""
    fresh = cache.filter(F.unix_micros("created_at") > F.unix_micros(now) - F.lit(int(ttl_seconds * 1_000_000)))
    return asked.select("key").filter("key IS NOT NULL").distinct().join(fresh.select("key", "embedding"), "key", "left")


def cache_after(cache: DataFrame, asked: DataFrame, computed: DataFrame, now: Column, ttl_seconds: float, capacity: int) -> DataFrame:
    """The cache after a batch: expired entries are gone, asked ones were used now, computed ones
    (key, embedding) were made now, and of all the ``capacity`` last used stay, ties to the smaller
    key. ``capacity`` rows are ranked in one task: a million at most."""
    if not 0 <= capacity <= 1_000_000:
        raise ValueError("a cache of at most a million entries")
    fresh = cache.filter(F.unix_micros("created_at") > F.unix_micros(now) - F.lit(int(ttl_seconds * 1_000_000)))
    made = computed.filter("key IS NOT NULL").groupBy("key").agg(F.first("embedding").alias("embedding"))
    old = fresh.join(made.select("key"), "key", "left_anti").join(asked.select("key", F.lit(True).alias("_asked")).distinct(), "key", "left")
    kept = old.select("key", "embedding", "created_at", F.when(F.col("_asked"), now).otherwise(F.col("used_at")).alias("used_at"))
    return kept.unionByName(made.select("key", "embedding", now.alias("created_at"), now.alias("used_at"))).orderBy(F.desc("used_at"), "key").limit(capacity)
