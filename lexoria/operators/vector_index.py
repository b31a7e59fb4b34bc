"""A stored vector index by inverted lists, for searches by cosine similarity.

Vectors lie in folders by the nearest of the trained centroids; a search reads only the folders of the
lists that it probes. The approximate way probes each question's nearest lists. The exact way goes on
from there: by the triangle inequality a list whose centroid is at angle a from the question, and
whose members lie within angle r of the centroid, has no similarity above cos(a - r), so that only
lists that might reach the k-th similarity found are read as well.

Candidates are found by matrix products in Arrow batches and ranked again by exact similarities.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexoria.functions.vectors import cosine_similarity, norm
from lexoria.sources.segments import Segments

#: Vectors that centroids are trained on, about (those of smallest hash of the id), and most lists.
TRAIN_ROWS, MOST_LISTS = 131_072, 4_096
#: Questions in one batch at most: their products with a block of vectors are held in memory.
BATCH, BLOCK = 1_024, 2_048
#: Candidates this much below a block's k-th similarity are ranked again too: products are rounded.
SLACK = 1e-9


def _finite(v: str):
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (norm(F.col(v)) > 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _nearest_list(shared):
    """Rows with the list of their vector and their angle to its centroid."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        for batch in batches:
            cos = _unit(_matrix(batch.column("embedding"), centroids.shape[1])) @ centroids.T
            at = cos.argmax(axis=1)
            angle = np.arccos(np.clip(cos[np.arange(len(at)), at], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(angle)], names=[*batch.schema.names, "list", "angle"])

    return run


@dataclass
class Asked:
    """A batch of questions: unit vectors, filters (empty: none), and which lists each one probes."""

    ids: list
    vectors: np.ndarray
    doc_types: list[list]
    modules: list[list]
    probes: np.ndarray | None = None


def _passes(asked: Asked, q: int, doc_type: pa.Array, module: pa.Array) -> np.ndarray | None:
    """Which rows a question's filters admit; a row without a module passes every module filter."""
    ok = None
    if asked.doc_types[q]:
        ok = pc.is_in(doc_type, pa.array(asked.doc_types[q], pa.string())).to_numpy(zero_copy_only=False)
    if asked.modules[q]:
        fits = pc.is_in(module, pa.array([*asked.modules[q], ""], pa.string())).to_numpy(zero_copy_only=False)
        ok = fits if ok is None else ok & fits
    return ok


def _candidates(shared, k: int, floor: float, fields: list[str]):
    """(query_id, *fields) of each block's k nearest to each question that probes its list."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        asked: Asked = shared.value
        for batch in batches:
            lists = batch.column("list").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(lists)) + 1), len(lists)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                probing = np.flatnonzero(asked.probes[:, lists[a]]) if a < b else []
                for start in range(a, b if len(probing) else a, BLOCK):
                    piece = batch.slice(start, min(BLOCK, b - start))
                    doc_type, module = (pc.fill_null(piece.column(c).cast(pa.string()), "") for c in ("doc_type", "module"))
                    cos = _unit(_matrix(piece.column("embedding"), asked.vectors.shape[1])) @ asked.vectors[probing].T
                    owner, rows = [], []
                    for j, q in enumerate(probing):
                        mine, ok = cos[:, j], _passes(asked, q, doc_type, module)
                        at = np.flatnonzero((mine >= floor - SLACK) if ok is None else ok & (mine >= floor - SLACK))
                        if len(at) > k:
                            at = at[mine[at] >= np.partition(mine[at], len(at) - k)[len(at) - k] - SLACK]
                        owner.append(np.full(len(at), q))
                        rows.append(at)
                    owner, rows = np.concatenate(owner), np.concatenate(rows)
                    if len(rows):
                        kept = piece.take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays([pa.array([asked.ids[q] for q in owner], pa.int32()), *(kept.column(f) for f in fields)], names=["query_id", *fields])

    return run


class VectorIndex:
    """An index in a folder that all executors share, of rows (id, embedding, doc_type, module, ...).

    ``build`` trains it and writes all rows, ``replace`` changes some by id, ``search`` asks it. Rows
    whose vector is null, empty, zero or not finite are left out; all vectors have one length.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.segments = spark, folder.rstrip("/"), Segments(spark, folder)

    def build(self, rows: DataFrame, lists: int | None = None, seed: int = 1) -> None:
        """``lists``: by default the root of the number of rows, MOST_LISTS at most."""
        kept = rows.filter(_finite("embedding"))
        n = kept.count()
        if not n:
            raise ValueError("no vectors to index")
        lists = min(MOST_LISTS, max(1, lists or round(math.sqrt(n))), n)
        share = min(1.0, TRAIN_ROWS / n)
        sample = kept.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 32)) < int(share * (1 << 32)) + 1).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
        model = KMeans(k=max(2, lists), seed=seed, featuresCol="v", distanceMeasure="cosine", maxIter=10).fit(sample)
        centroids = _unit(np.array(model.clusterCenters()))
        self._write_centroids(centroids)
        self.segments.begin({"dim": int(centroids.shape[1]), "columns": rows.columns}, self._listed(kept, centroids), "list", ["id"])

    def replace(self, rows: DataFrame | None, ids: DataFrame | None = None) -> None:
        """Index ``rows`` in place of what their ids had; ``ids`` (id) go without replacement."""
        gone = [d.select("id") for d in (rows, ids) if d is not None]
        if gone:
            listed = None if rows is None else self._listed(rows.filter(_finite("embedding")), self._centroids())
            self.segments.change(listed, gone[0] if len(gone) == 1 else gone[0].unionByName(gone[1]))

    def compact(self) -> None:
        self.segments.compact()

    def _write_centroids(self, centroids: np.ndarray) -> None:
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(centroids)]
        self.spark.createDataFrame(rows, "list int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/centroids")

    def _centroids(self) -> np.ndarray:
        return np.array([r["centroid"] for r in self.spark.read.parquet(f"{self.folder}/centroids").orderBy("list").collect()])

    def _listed(self, rows: DataFrame, centroids: np.ndarray) -> DataFrame:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInArrow(_nearest_list(self.spark.sparkContext.broadcast(centroids)), f"{schema}, list int, angle double")

    def _asked(self, questions: DataFrame) -> Asked:
        rows = questions.select("query_id", "query_embedding", "doc_types", "modules").filter(_finite("query_embedding")).orderBy("query_id").limit(BATCH + 1).collect()
        if len(rows) > BATCH:
            raise ValueError(f"more than {BATCH} questions in a batch")
        vectors = np.array([r["query_embedding"] for r in rows], np.float64)
        return Asked([r["query_id"] for r in rows], _unit(vectors) if len(rows) else vectors, [r["doc_types"] for r in rows], [r["modules"] for r in rows])

    def search(self, questions: DataFrame, k: int = 10, probes: int = 8, exact: bool = False, floor: float = -1.0) -> DataFrame:
        """(query_id, *columns of the rows, similarity, rank): each question's k nearest rows of at
        least ``floor`` that pass its filters; questions: (query_id, query_embedding, doc_types,
        modules). ``probes`` lists a question are read; with ``exact`` also all others that might hold
        one of the k nearest. Columns list and angle of the index are left out."""
        asked, centroids = self._asked(questions), self._centroids()
        _, state = self.segments.state()
        cos = asked.vectors @ centroids.T if len(asked.ids) else np.zeros((0, len(centroids)))
        order = np.argsort(-cos, axis=1, kind="stable")
        first = np.zeros(cos.shape, bool)
        np.put_along_axis(first, order[:, :probes], True, axis=1)
        if exact and len(asked.ids):
            asked.probes = first
            kth = {r["query_id"]: r["similarity"] for r in self._ranked(asked, questions, state, k, floor).filter(F.col("rank") == k).select("query_id", "similarity").collect()}
            least = np.array([max(floor, kth.get(q, floor)) for q in asked.ids])
            reach = {r["list"]: r["angle"] for r in self._reach(state).collect()}
            r = np.array([reach.get(i, -1.0) for i in range(len(centroids))])
            bound = np.cos(np.maximum(0.0, np.arccos(np.clip(cos, -1, 1)) - r[None, :]))
            first |= (bound >= least[:, None] - SLACK) & (r[None, :] >= 0)
        asked.probes = first
        return self._ranked(asked, questions, state, k, floor)

    def _reach(self, state: dict) -> DataFrame:
        """The largest angle of each list, from all its rows, live or not: a bound all the same."""
        rows = [self.spark.read.parquet(p).select("list", "angle") for p in self.segments.paths(state)]
        every = rows[0]
        for more in rows[1:]:
            every = every.unionByName(more)
        return every.groupBy("list").agg(F.max("angle").alias("angle"))

    def _ranked(self, asked: Asked, questions: DataFrame, state: dict, k: int, floor: float) -> DataFrame:
        from .retrieval import top

        probed = [int(i) for i in np.flatnonzero(asked.probes.any(axis=0))]
        rows = self.segments.live(state, F.col("list").isin(probed))
        fields = state["columns"]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in fields)
        fields = [f.name for f in rows.schema if f.name in fields]
        found = rows.select(*fields, "list").mapInArrow(_candidates(self.spark.sparkContext.broadcast(asked), k, floor, fields), f"query_id int, {schema}")
        near = found.join(F.broadcast(questions.select("query_id", "query_embedding")), "query_id").withColumn("similarity", cosine_similarity(F.col("embedding"), F.col("query_embedding"))).drop("query_embedding")
        return top(near.filter(F.col("similarity") >= floor), "rank", [F.col("similarity").desc(), F.col("id")], k)
