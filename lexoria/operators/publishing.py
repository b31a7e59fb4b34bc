"""Versioned publication of corpora: replacement, cloning, promotion plans, rollback."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexoria.sources.shared import CommitLog

from .lifecycle import fingerprint


def replace_documents(current: DataFrame, incoming: DataFrame, key: str = "document_id") -> DataFrame:
    """The corpus with every incoming document's rows in place of its old ones: whole documents, so
    that no half-replaced one can be seen once the version is published."""
    return current.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def clone_rows(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows of documents with an equal processing hash under new ids; vectors are reused. mapping:
    (source_document_id, document_id)."""
    j = rows.withColumnRenamed("document_id", "source_document_id").join(mapping, "source_document_id")
    return j.withColumn("id", F.concat_ws("-", F.col("document_id").cast("string"), F.col("chunk_index").cast("string")))


def promotion_plan(before: DataFrame, after: DataFrame) -> DataFrame:
    """(canonical_id, action): retire, introduce, replace or keep. Both: (canonical_id,
    content_hash)."""
    j = before.select("canonical_id", F.col("content_hash").alias("_old")).join(after.select("canonical_id", F.col("content_hash").alias("_new")), "canonical_id", "full_outer")
    return j.select("canonical_id", F.when(F.col("_new").isNull(), "retire").when(F.col("_old").isNull(), "introduce").when(F.col("_old") != F.col("_new"), "replace").otherwise("keep").alias("action"))


class Publication:
    """Versions of a corpus under a folder, and a pointer to the published one.

    ``apply`` writes a version and moves the pointer last; applying the same plan again does nothing.
    ``rollback`` moves the pointer back and verifies the fingerprint. Of two writers at once the second
    to create the next pointer gets Taken, and nothing of what it wrote is published.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.pointers = CommitLog(spark, f"{self.folder}/pointers")

    def state(self) -> dict:
        return self._newest()[1]

    def _newest(self) -> tuple[int, dict]:
        number, entry = self.pointers.newest()
        return number, entry or {"version": None, "history": []}

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{self.state()['version']}")

    def apply(self, rows: DataFrame, plan_id: str, expected: str | None = None) -> dict:
        """expected: the fingerprint that the published version must still have."""
        number, state = self._newest()
        if plan_id in [h["plan"] for h in state["history"]]:
            return state
        last = state["history"][-1]["fingerprint"] if state["history"] else None
        if expected is not None and expected != last:
            raise ValueError("the published corpus is not the one that the plan was made for")
        version = f"v{len(state['history']) + 1:06d}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.folder}/{version}")
        made = self.spark.read.parquet(f"{self.folder}/{version}")
        mark = fingerprint(made, made.columns).first()["fingerprint"]
        state["history"].append({"plan": plan_id, "version": version, "fingerprint": mark})
        state["version"] = version
        self.pointers.commit(number, state)
        return state

    def rollback(self) -> dict:
        number, state = self._newest()
        if len(state["history"]) < 2:
            raise ValueError("nothing to go back to")
        state["history"].pop()
        target = state["history"][-1]
        old = self.spark.read.parquet(f"{self.folder}/{target['version']}")
        if fingerprint(old, old.columns).first()["fingerprint"] != target["fingerprint"]:
            raise ValueError("the version to go back to has changed")
        state["version"] = target["version"]
        self.pointers.commit(number, state)
        return state
