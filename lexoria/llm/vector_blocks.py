"""Vectors dealt as streams of queries against shards of candidates.

Each task holds one shard of candidates, builds its index once, and answers the queries that are
streamed to it in batches; only the shard and one batch are in memory at a time. Partial results,
k rows a query and shard, are merged by a ranked window.

Every shard gets every query: rows moved are candidates * blocks + queries * shards. A block holds
up to QUERY_ROWS queries; there are more blocks than that asks for only where there are too few
tasks for the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import lean

#: Queries that one task answers at most, and at least where blocks are made for parallelism.
QUERY_ROWS, LEAST_QUERIES = 1 << 22, 512


class Index(Protocol):
    def search(self, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, vec_id, score) of what was found. bounds: a score that each query's k-th best
        reaches at least; NaN or the least integer where none is known."""


def valid_vectors(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding", nonzero: bool = False) -> DataFrame:
    """(vec_id, v) of the rows with an id whose vector is neither null nor empty and has only
    finite components, as doubles; with ``nonzero`` zero vectors are left out too."""
    v = F.col(col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    keep = vectors.filter(F.col(id_col).isNotNull() & F.col(col).isNotNull() & (F.size(col) > 0) & ~bad)
    if nonzero:
        keep = keep.filter(F.exists(v, lambda x: x != 0))
    return keep.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def shard_of(shards: int) -> Column:
    return F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)


def _answer(build: Callable[[np.ndarray, np.ndarray], Index], none: float | int):
    """One task: rows sorted by dimension, candidates (role 0) before queries (role 1)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        dim, ids, rows, index = -1, [], [], None
        for batch in batches:
            dims, roles = batch.column("dim").to_numpy(), batch.column("role").to_numpy()
            cuts = np.flatnonzero((np.diff(dims) != 0) | (np.diff(roles) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                if a == b:
                    continue
                piece = batch.slice(a, b - a)
                if dims[a] != dim:
                    dim, ids, rows, index = int(dims[a]), [], [], None
                own, x = piece.column("vec_id").to_numpy(), _matrix(piece, dim)
                if roles[a] == 0:
                    ids.append(own)
                    rows.append(x)
                    continue
                if index is None:
                    if not ids:
                        continue
                    index = build(np.concatenate(ids), np.concatenate(rows))
                    ids, rows = [np.zeros(0, np.int64)], []
                bounds = piece.column("bound").fill_null(none).to_numpy(zero_copy_only=False)
                q, c, s = index.search(own, x, bounds)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(c, pa.int64()), pa.array(s)], names=["query_id", "vec_id", "score"])

    return lean(run)


def deal(candidates: DataFrame, queries: DataFrame, build: Callable[[np.ndarray, np.ndarray], Index], score: str, shards: int, n_queries: int) -> DataFrame:
    """(query_id, vec_id, score) of every shard's answers to every query.

    candidates: (vec_id, v, shard) with shards from 0; queries: (vec_id, v, bound), the bound a
    ``score`` or null. Where shards are few, more tasks share one, by blocks of queries.
    """
    cores = candidates.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n_queries // QUERY_ROWS), min(-(-n_queries // LEAST_QUERIES), -(-cores // shards)))
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
    c = candidates.select("vec_id", "v", F.lit(None).cast(score).alias("bound"), F.lit(0).alias("role"), "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    q = queries.select("vec_id", "v", F.col("bound").cast(score).alias("bound"), F.lit(1).alias("role"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), block.alias("block"))
    rows = c.unionByName(q).select("vec_id", "v", "bound", "role", F.size("v").alias("dim"), (F.col("shard") * blocks + F.col("block")).alias("task"))
    dealt = rows.repartitionById(shards * blocks, F.col("task")).sortWithinPartitions("dim", "role", "vec_id")
    none = float("nan") if score == "double" else np.iinfo(np.int64).min
    return dealt.mapInArrow(_answer(build, none), f"query_id long, vec_id long, score {score}")


def best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of each query, ties to the smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def bounded(queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """queries (vec_id, v) with the k-th best score found so far as their bound, null without."""
    kth = best(found, k).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    return queries.join(kth, "vec_id", "left")


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, best first."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= kth)
    else:
        at = np.arange(len(scores))
    if scores.dtype.kind == "i":  # the bitwise complement falls as the integer rises, without overflow
        return at[np.lexsort((ids[at], ~scores[at]))[:k]]
    return at[np.lexsort((ids[at], -scores[at]))[:k]]
