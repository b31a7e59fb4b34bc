"""A stored table of rows by id that is changed by adding segments, and published by a commit log."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import CommitLog


class Segments:
    """A folder of segments. A segment has ``rows`` (by folders of one column, sorted within files) and
    ``dead``: the ids whose rows in all earlier segments are replaced or gone.

    A writer adds its segment and then commits the state that names it; of two writers at once one
    gets Taken, and what it wrote is never read. A crash before the commit changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.log = CommitLog(spark, f"{self.folder}/commits")

    def state(self) -> tuple[int, dict]:
        number, entry = self.log.newest()
        if entry is None:
            raise ValueError("nothing has been built in the folder")
        return number, entry

    def begin(self, state: dict, rows: DataFrame, by: str, order: list[str]) -> None:
        """Start anew with ``rows``, whatever the folder holds."""
        number, _ = self.log.newest()
        self.log.commit(number, state | {"by": by, "order": order, "segments": [self._write(rows, None, by, order)]})

    def change(self, rows: DataFrame | None, dead: DataFrame) -> None:
        """Add ``rows``; those of the ids of ``dead`` in earlier segments no longer count."""
        number, state = self.state()
        added = self._write(rows, dead.filter("id IS NOT NULL").select("id").distinct(), state["by"], state["order"])
        self.log.commit(number, state | {"segments": [*state["segments"], added]})

    def compact(self) -> None:
        """One segment of all live rows."""
        number, state = self.state()
        self.log.commit(number, state | {"segments": [self._write(self.live(state), None, state["by"], state["order"])]})

    def _write(self, rows: DataFrame | None, dead: DataFrame | None, by: str, order: list[str]) -> dict:
        name = f"segment-{uuid.uuid4().hex}"
        if rows is not None:
            # Rebalanced, not ranged: ranges are sampled, which makes all rows twice. A value of ``by`` that
            # holds many rows is split among tasks.
            rows.hint("rebalance", by).sortWithinPartitions(by, *order).write.partitionBy(by).parquet(f"{self.folder}/{name}/rows")
        if dead is not None:
            dead.write.parquet(f"{self.folder}/{name}/dead")
        return {"name": name, "rows": None if rows is None else rows.schema.jsonValue(), "dead": dead is not None}

    def paths(self, state: dict) -> list[str]:
        """The row folders of the live segments."""
        return [f"{self.folder}/{s['name']}/rows" for s in state["segments"] if s["rows"]]

    def live(self, state: dict, wanted: Column | None = None) -> DataFrame:
        """The rows that no later segment replaces, and for which ``wanted`` holds."""
        live, dead = None, None
        for s in reversed(state["segments"]):  # newest first: ``dead`` has the ids of all later ones
            if s["rows"]:
                kind = StructType.fromJson(s["rows"])
                rows = self.spark.read.schema(kind).parquet(f"{self.folder}/{s['name']}/rows").select(*kind.names)
                rows = rows if wanted is None else rows.filter(wanted)
                rows = rows if dead is None else rows.join(dead, "id", "left_anti")
                live = rows if live is None else live.unionByName(rows)
            if s["dead"]:
                ids = self.spark.read.parquet(f"{self.folder}/{s['name']}/dead")
                dead = ids if dead is None else dead.unionByName(ids)
        if live is None:
            raise ValueError("the folder has no rows")
        return live


def bucket(column: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")
