"""Exact top-k inner products by KD-trees per shard.

Each shard is cut at medians of its widest dimension; every node has the tight box of its rows.
The largest inner product a query can have inside a box bounds a node. A query visits leaves best
bound first and stops below its k-th score, which passes on from tree to tree; the k-th scores of
one seed shard, found first, are the start everywhere else.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut
from .vector_blocks import best, bounded, deal, shard_of, top, valid_vectors

#: Rows in a leaf, in a tree, and in a shard, which is several trees.
LEAF_ROWS, TREE_ROWS, SHARD_ROWS = 128, 4_096, 16_384
#: Sums of integers below this are exact in doubles, in any order.
_EXACT = float(2**53)


class KdTree:
    def __init__(self, x: np.ndarray, leaf: int = LEAF_ROWS):
        self.order = np.arange(len(x))
        self.start, self.end, self.left, self.right, lo, hi = [], [], [], [], [], []
        stack = [(0, len(x), -1, False)]
        while stack:
            a, b, parent, is_right = stack.pop()
            me = len(self.start)
            rows = x[self.order[a:b]]
            low, high = rows.min(0), rows.max(0)
            self.start.append(a)
            self.end.append(b)
            self.left.append(-1)
            self.right.append(-1)
            lo.append(low)
            hi.append(high)
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = me
            if b - a > leaf and (high > low).any():
                axis = int(np.argmax(high - low))
                mid = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(rows[:, axis], mid)]
                stack += [(a, a + mid, me, False), (a + mid, b, me, True)]
        self.lo, self.hi = np.array(lo), np.array(hi)
        self.rows = x[self.order]  # integers, as doubles

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The largest inner product possible in each node: queries x nodes."""
        return np.maximum(q, 0) @ self.hi.T + np.minimum(q, 0) @ self.lo.T


def tree_top(tree: KdTree, ids: np.ndarray, query_id: int, q: np.ndarray, bounds: np.ndarray, k: int, have: tuple[np.ndarray, np.ndarray], floor: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(scores, ids) of the k best of ``have`` and the tree, and the leaves visited. Nodes below
    the k-th score, or below ``floor``, are not opened; equal ones are (ties go to smaller ids).
    tree.rows and q are doubles where all sums are exact in them, else integers of 64 bits."""
    scores, found = have
    heap, visited = [(-bounds[0], 0)], 0
    while heap:
        bound, node = heapq.heappop(heap)
        kth = max(floor, int(scores[k - 1])) if len(scores) >= k else floor
        if -bound < kth:
            break
        if tree.left[node] >= 0:
            for child in (tree.left[node], tree.right[node]):
                if bounds[child] >= kth:
                    heapq.heappush(heap, (-bounds[child], child))
            continue
        visited += 1
        a, b = tree.start[node], tree.end[node]
        s = (tree.rows[a:b] @ q).astype(np.int64)
        at = np.flatnonzero(s >= kth)
        at = at[ids[tree.order[a + at]] != query_id]
        if len(at):
            scores, found = np.concatenate([scores, s[at]]), np.concatenate([found, ids[tree.order[a + at]]])
            pick = top(scores, found, k)
            scores, found = scores[pick], found[pick]
    return scores, found, visited


class TreeIndex:
    """The KD-trees of one shard, over floor(scale * x)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, scale: float):
        self.k, self.scale = k, scale
        x = np.floor(scale * x)
        self.largest = float(np.abs(x).max())
        self.trees = [(KdTree(x[a : a + TREE_ROWS]), ids[a : a + TREE_ROWS]) for a in range(0, len(x), TREE_ROWS)]
        self.visited = self.leaves = 0

    def search(self, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray):
        """(query id, vec_id, score) of each query's k best that reach its bound."""
        queries = np.floor(self.scale * queries)
        exact = self.largest * float(np.abs(queries).max()) * queries.shape[1] < _EXACT
        have = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in query_ids]
        for tree, ids in self.trees:
            if not exact and tree.rows.dtype != np.int64:
                tree.rows = tree.rows.astype(np.int64)
            for a in range(0, len(queries), 512):
                block = queries[a : a + 512]
                most = tree.bounds(block)
                asked = block
                if not exact or tree.rows.dtype == np.int64:
                    most = most + np.abs(most) * 1e-9 + 1  # what rounding may have taken off
                    asked = block.astype(np.int64)
                for j, q in enumerate(asked):
                    *have[a + j], visited = tree_top(tree, ids, query_ids[a + j], q, most[j], self.k, have[a + j], int(bounds[a + j]))
                    self.visited += visited
            self.leaves += sum(left < 0 for left in tree.left) * len(queries)
        cat = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
        return cat([np.full(len(c), query_ids[i]) for i, (_, c) in enumerate(have)]), cat([c for _, c in have]), cat([s for s, _ in have])


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose vec_id is divisible by ``every``, the k
    highest integer inner products of floor(scale * x) with all other rows, ties to the smaller
    vec_id.

    Vectors that are null, empty or hold null or non-finite components take no part; vectors of
    different dimensions are not compared. A repeated vec_id is a candidate each time (never of
    itself). With k candidates or fewer all are returned. Other columns are ignored. Scores are
    exact while they and their terms fit 64 bits.
    """
    v = valid_vectors(vectors)
    n, n_queries = v.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    queries = v.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))

    def build(ids: np.ndarray, x: np.ndarray) -> TreeIndex:
        return TreeIndex(ids, x, k, scale)

    # The seed shard: about TREE_ROWS rows by hash, for the first k-th scores.
    parts = max(1, -(-n // TREE_ROWS))
    seed = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)) == 0
    none = queries.withColumn("bound", F.lit(None).cast("long"))
    first = deal(v.filter(seed).withColumn("shard", F.lit(0)), none, build, "long", 1, n_queries)
    if parts == 1:
        return best(first, k)
    first = cut(first)
    shards = max(1, -(-n // SHARD_ROWS))
    rest = deal(v.filter(~seed).withColumn("shard", shard_of(shards)), bounded(queries, first, k), build, "long", shards, n_queries)
    return best(first.unionByName(rest), k)
