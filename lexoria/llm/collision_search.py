"""Approximate nearest neighbours by collision counting over single projections.

Every shard keeps, for each of m random lines, its vectors' projections in sorted order. A query's
own projection is the centre of a window on each line; virtual rehashing widens all windows by a
factor a round, so that only the newly covered ends are counted. A vector collides with the query
on a line whose window holds it; what is counted are the lines that still miss it, as fewer vectors
lie outside. Vectors missed by few enough lines are verified by the exact measure.

A query ends once its k-th verified distance is within the round's radius: a vector at that radius
then was verified with a chance of about 80 %, and nearer ones a higher one. One shard is searched
first; the k-th distances found there bound the radius in all others.

Inner products are searched as distances: queries are scaled to length 1, and vectors by the
largest length, with one more component that fills them up to 1.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut
from .vector_blocks import best, bounded, deal, shard_of, top, valid_vectors

#: Lines; windows of half-width WIDTH * radius; widening a round; standard deviations by which the
#: threshold lies below the count of collisions expected at the radius.
LINES, WIDTH, WIDEN, MARGIN = 192, 2.2, 1.02, 1.0
#: Candidates in a shard, at most about.
SHARD_ROWS = 32_768
#: The first radius, as a part of the estimated or known k-th distance.
START = 0.97


def most_misses(lines: int = LINES, width: float = WIDTH, margin: float = MARGIN) -> int:
    """The lines that may miss a vector that is verified."""
    p = math.erf(width / math.sqrt(2))
    return int(lines * (1 - p) + margin * math.sqrt(lines * p * (1 - p)))


class CollisionIndex:
    """Sorted projections of one shard. longest: the largest vector length of the whole table."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, longest: float, k: int, lines: int = LINES, seed: int = 0):
        # Candidates are compared in single precision; whatever may be among the k best, in double.
        self.ids, self.x, self.single = ids, x, np.ascontiguousarray(x, dtype=np.float32)
        self.k, self.lines, self.longest, self.misses = k, lines, longest, most_misses(lines)
        a = np.random.default_rng(seed).standard_normal((x.shape[1] + 1, lines))
        self.a = a[:-1]
        fill = np.sqrt(np.maximum(0.0, 1.0 - (x**2).sum(1) / longest**2))
        self.order = np.empty((lines, len(x)), np.int32)
        self.sorted = np.empty((lines, len(x)), np.float32)
        for line in range(lines):
            p = (x @ (a[:-1, line] / longest) + fill * a[-1, line]).astype(np.float32)
            self.order[line] = np.argsort(p, kind="stable")
            self.sorted[line] = p[self.order[line]]
        self.verified = self.asked = 0

    def distance(self, inner):
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * inner / self.longest))

    def _windows(self, centre: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place in and first place after the window, lines x queries."""
        low, high = (centre - half[:, None]).T.astype(np.float32), (centre + half[:, None]).T.astype(np.float32)
        lo = [s.searchsorted(x) for s, x in zip(self.sorted, low, strict=True)]
        hi = [s.searchsorted(x, side="right") for s, x in zip(self.sorted, high, strict=True)]
        return np.array(lo), np.array(hi)

    def _count(self, ranges: list[tuple[list[int], list[int]]]) -> np.ndarray:
        """How often each vector lies in places (starts, ends) of the lines."""
        parts = [o[a:b] for starts, ends in ranges for o, a, b in zip(self.order, starts, ends, strict=True) if a < b]
        return np.bincount(np.concatenate(parts), minlength=len(self.x)) if parts else np.zeros(len(self.x), np.int64)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray):
        """(query id, vec_id, score) of each query's k best verified candidates that reach its bound."""
        q, c, s = [], [], []
        for a in range(0, len(queries), 64):
            for i, at, exact in self._block(query_ids[a : a + 64], queries[a : a + 64], bounds[a : a + 64]):
                q.append(np.full(len(at), query_ids[a + i]))
                c.append(self.ids[at])
                s.append(exact)
        cat = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
        return cat(q, np.int64), cat(c, np.int64), cat(s, np.float64)

    def _block(self, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray):
        n, k = self.x.shape[0], self.k
        length = np.sqrt((queries**2).sum(1))
        unit = queries / length[:, None]
        centre = unit @ self.a
        # The nearest of n / k spread rows is about as far as the k-th of all.
        near = unit @ self.x[::k].T
        near[query_ids[:, None] == self.ids[None, ::k]] = -self.longest
        limit = self.distance(bounds / length)  # NaN without a bound
        radius = START * np.fmin(self.distance(near.max(axis=1)), limit)
        zero, all_rows = [0] * self.lines, [n] * self.lines
        lo, hi = self._windows(centre, WIDTH * radius)
        missed, found, seen = [], [], []
        for i in range(len(queries)):
            missed.append(self._count([(zero, lo[:, i].tolist()), (hi[:, i].tolist(), all_rows)]))
            found.append(np.zeros(0, np.int64))
            seen.append(np.zeros(0, np.float32))
        active = np.arange(len(queries))
        fresh = [np.flatnonzero(m <= self.misses) for m in missed]
        while len(active):
            going = []
            for i in active:
                new = fresh[i]
                if radius[i] > 2.0 or n <= k:
                    new = np.setdiff1d(np.arange(n), found[i])
                new = new[self.ids[new] != query_ids[i]]
                found[i] = np.concatenate([found[i], new])
                seen[i] = np.concatenate([seen[i], self.single[new] @ unit[i].astype(np.float32)])
                enough = len(seen[i]) >= k and self.distance(np.partition(seen[i], len(seen[i]) - k)[len(seen[i]) - k]) <= radius[i]
                if not (enough or radius[i] > 2.0 or n <= k or radius[i] >= limit[i]):
                    going.append(i)
            active = np.array(going, np.int64)
            if not len(active):
                break
            radius[active] = np.fmin(np.maximum(radius[active] * WIDEN, 0.1), np.where(radius[active] < limit[active], limit[active], np.inf))
            lo2, hi2 = self._windows(centre[active], WIDTH * radius[active])
            for j, i in enumerate(active):
                before = missed[i]
                missed[i] = before - self._count([(lo2[:, j].tolist(), lo[:, i].tolist()), (hi[:, i].tolist(), hi2[:, j].tolist())])
                fresh[i] = np.flatnonzero((before > self.misses) & (missed[i] <= self.misses))
                lo[:, i], hi[:, i] = lo2[:, j], hi2[:, j]
        for i in range(len(queries)):
            at = found[i]
            self.verified, self.asked = self.verified + len(at), self.asked + n
            if len(at) > 4 * k:
                at = at[seen[i] >= np.partition(seen[i], len(at) - k)[len(at) - k] - 1e-4 * self.longest]
            exact = (self.x[at] * queries[i]).sum(axis=1)
            pick = top(exact, self.ids[at], k)
            yield i, at[pick], exact[pick]


def nearest_neighbours(vectors: DataFrame, k: int = 20, every: int = 20, seed: int = 0) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose vec_id is divisible by ``every``, the k
    rows of largest inner product that were found, itself left out, nearest first, ties to the
    smaller vec_id. score is exact, in double precision.

    Vectors that are null, empty, zero or hold null or non-finite components take no part; vectors
    of different dimensions are not compared. A repeated vec_id is a candidate each time (never of
    itself). With k candidates or fewer all are returned. Other columns are ignored.
    """
    v = valid_vectors(vectors, nonzero=True)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    n, n_queries, longest = v.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0), F.max(length)).first()
    queries = v.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    shards = max(1, -(-n // SHARD_ROWS))
    candidates = v.withColumn("shard", shard_of(shards))

    def build(ids: np.ndarray, x: np.ndarray) -> CollisionIndex:
        return CollisionIndex(ids, x, longest, k, seed=seed)

    first = deal(candidates.filter("shard = 0"), queries.withColumn("bound", F.lit(None).cast("double")), build, "double", 1, n_queries)
    if shards == 1:
        return best(first, k)
    first = cut(first)
    rest = deal(candidates.filter("shard > 0").withColumn("shard", F.col("shard") - 1), bounded(queries, first, k), build, "double", shards - 1, n_queries)
    return best(first.unionByName(rest), k)
