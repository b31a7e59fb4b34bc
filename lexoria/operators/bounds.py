"""Broadcasts of frames that are small by contract, held to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def small(rows: DataFrame, most: int, what: str) -> DataFrame:
    """``rows`` for a broadcast join; an error where there are more than ``most``."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} {what}")
    return F.broadcast(rows)
