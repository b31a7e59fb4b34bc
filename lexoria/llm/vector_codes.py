"""Vector codes by product quantisation, its codebooks found by the filtering form of Lloyd's rounds.

Vectors become integers, floor(scale * x), and are cut into equal consecutive parts, each with a
codebook of its own. Every partition keeps its vectors in blocks; a block holds one kd-tree for each
part, whose nodes cache bounding box, sum and count. A round walks the trees from the roots with the
list of the entries that may still be nearest: an entry goes where the corner of the box that lies
farthest in its direction is no nearer to it than to another entry. A node left with one entry is
assigned whole, by its cached sum and count; only leaves left with several look at their parts. All
of this is exact, ties to the lower index included.

The trees are built once and persisted on the executors' disks; Spark makes lost ones again from the
vectors. What a round sends to the driver is the sums and counts of the entries alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .packing import pack, unpack
from .runtime import cut, lean

#: Vectors in a block, and parts in a leaf of a tree.
BLOCK, LEAF = 1 << 14, 16
#: Bits of the largest sums that longs and doubles hold exactly; numpy multiplies doubles faster.
_LONG, _DOUBLE = 62, 52


# --- one kd-tree


@dataclass
class Tree:
    """A kd-tree over integer points, by levels: level k has 2**k nodes (fewer points than nodes make
    empty ones), and node i holds the points order[start[k][i]:start[k][i + 1]]."""

    order: np.ndarray
    start: list[np.ndarray]
    low: list[np.ndarray]
    high: list[np.ndarray]
    total: list[np.ndarray]


def build_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """Median splits of the widest side of each node's tight box, all nodes of a level at once."""
    n = len(points)
    order, start = np.arange(n), np.array([0, n])
    tree = Tree(order, [], [], [], [])
    while True:
        at = points[order]
        low, high, total = _boxes(at, start)
        tree.start.append(start)
        tree.low.append(low)
        tree.high.append(high)
        tree.total.append(total)
        if n <= leaf * (len(start) - 1):
            break
        size = np.diff(start)
        node = np.repeat(np.arange(len(size)), size)
        side = np.argmax(high - low, axis=1)
        order = order[np.lexsort((at[np.arange(n), side[node]], node))]
        start = np.append(np.stack([start[:-1], start[:-1] + size // 2], axis=1).reshape(-1), n)
    tree.order = order
    return tree


def _boxes(at: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smallest and largest components and sums of each node's points; zeros for an empty node."""
    full = np.flatnonzero(np.diff(start))
    out = [np.zeros((len(start) - 1, at.shape[1]), np.int64) for _ in range(3)]
    if len(full):
        for o, f in zip(out, (np.minimum, np.maximum, np.add), strict=True):
            o[full] = f.reduceat(at, start[full], axis=0)
    return out[0], out[1], out[2]


def filter_tree(tree: Tree, points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of the nearest entry of each point, sums, counts, points looked at one by one): ``book``
    holds the entries, ties go to the lower index."""
    k, dim = book.shape
    label = np.zeros(len(points), np.int64)  # by place in tree.order
    sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
    largest = max(_largest(points), _largest(book))
    kind = np.float64 if 16 * dim * largest**2 < 1 << _DOUBLE else np.int64
    z, norm = book.astype(kind), (book.astype(kind) ** 2).sum(axis=1)
    index = np.arange(k)
    node, may = np.array([0]), np.ones((1, k), bool)
    looked = 0
    for level in range(len(tree.start)):
        start = tree.start[level]
        filled = start[node + 1] > start[node]
        node, may = node[filled], may[filled]
        if not len(node):
            break
        low, high = tree.low[level][node], tree.high[level][node]
        # The entry nearest to the middle of the box, in distances times four (middles may be halves).
        middle = (low + high).astype(kind)
        far = np.where(may, 4 * norm - 4 * (middle @ z.T), np.inf if kind is np.float64 else np.iinfo(np.int64).max)
        star = far.argmin(axis=1)
        # |z - v|^2 - |z* - v|^2 at the corner v farthest towards z; there it is least over the box.
        step = book[None, :, :] - book[star][:, None, :]
        corner = np.where(step > 0, high[:, None, :], low[:, None, :])
        gap = (step * (book[None, :, :] + book[star][:, None, :] - 2 * corner)).sum(axis=2)
        may &= ~((gap > 0) | ((gap == 0) & (star[:, None] < index)))
        may[np.arange(len(node)), star] = True
        one = may.sum(axis=1) == 1
        if one.any():
            got, whole = may[one].argmax(axis=1), node[one]
            np.add.at(sums, got, tree.total[level][whole])
            np.add.at(counts, got, start[whole + 1] - start[whole])
            at, owner = _ranges(start[whole], start[whole + 1])
            label[at] = got[owner]
            node, may = node[~one], may[~one]
        if level + 1 < len(tree.start):
            node, may = np.stack([2 * node, 2 * node + 1], axis=1).reshape(-1), np.repeat(may, 2, axis=0)
        elif len(node):
            at, owner = _ranges(start[node], start[node + 1])
            looked = len(at)
            mine = points[tree.order[at]]
            far = np.where(may[owner], norm - 2 * (mine.astype(kind) @ z.T), np.inf if kind is np.float64 else np.iinfo(np.int64).max)
            got = far.argmin(axis=1)
            label[at] = got
            np.add.at(sums, got, mine)
            counts += np.bincount(got, minlength=k)
    out = np.empty(len(points), np.int64)
    out[tree.order] = label
    return out, sums, counts, np.int64(looked)


def _largest(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges, and the range of each."""
    size = end - start
    owner = np.repeat(np.arange(len(size)), size)
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size), owner


# --- blocks of vectors with their trees


def _pack_block(v: np.ndarray, parts: int) -> bytes:
    """The vectors and, for each part, its tree's order, boxes and sums, level by level; the nodes'
    bounds follow from the number of vectors."""
    width = v.shape[1] // parts
    out = [v.astype(np.int32).reshape(-1)]
    for p in range(parts):
        t = build_tree(v[:, p * width : (p + 1) * width])
        out += [t.order.astype(np.uint16), np.concatenate(t.low).astype(np.int32), np.concatenate(t.high).astype(np.int32), np.concatenate(t.total)]
    return pack(*[x.reshape(-1) for x in out])


def _starts(n: int, leaf: int = LEAF) -> list[np.ndarray]:
    start = np.array([0, n])
    out = [start]
    while n > leaf * (len(start) - 1):
        start = np.append(np.stack([start[:-1], start[:-1] + np.diff(start) // 2], axis=1).reshape(-1), n)
        out.append(start)
    return out


def _unpack_block(data: bytes, dim: int, parts: int) -> Iterator[tuple[np.ndarray, Tree]]:
    """(points, tree) of each part."""
    v, *rest = unpack(data)
    v, width = v.astype(np.int64).reshape(-1, dim), dim // parts
    start = _starts(len(v))
    ends = np.cumsum([len(s) - 1 for s in start])[:-1]
    for p in range(parts):
        order, *nodes = rest[4 * p : 4 * p + 4]
        levels = [np.split(x.astype(np.int64).reshape(-1, width), ends) for x in nodes]
        yield v[:, p * width : (p + 1) * width], Tree(order.astype(np.int64), start, *levels)


def _blocks(parts: int):
    """Rows (row, v) of one partition as blocks (rows, tree)."""

    def made(rows: list, vectors: list) -> pa.RecordBatch:
        row = pa.concat_arrays(rows)
        v = np.concatenate(vectors)
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(row)], pa.int32()), row), pa.array([_pack_block(v, parts)], pa.binary())], names=["rows", "tree"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        rows, vectors, n = [], [], 0
        for batch in batches:
            at = 0
            while at < len(batch):
                piece = batch.slice(at, BLOCK - n)
                rows.append(piece.column("row"))
                vectors.append(piece.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(piece), -1))
                at, n = at + len(piece), n + len(piece)
                if n == BLOCK:
                    yield made(rows, vectors)
                    rows, vectors, n = [], [], 0
        if n:
            yield made(rows, vectors)

    return lean(run)


def _round(shared, parts: int):
    """Sums and counts of one partition's entries: (part, entry, position, total, n)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        book: np.ndarray = shared.value
        k, width = book.shape[1:]
        sums, counts = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            for data in batch.column("tree"):
                for p, (points, tree) in enumerate(_unpack_block(data.as_py(), parts * width, parts)):
                    _, s, c, _ = filter_tree(tree, points, book[p])
                    sums[p] += s
                    counts[p] += c
        at = np.indices(sums.shape).reshape(3, -1)
        n = np.repeat(counts.reshape(-1), width)
        used = n > 0
        columns = [*(x[used].astype(np.int32) for x in at), sums.reshape(-1)[used], n[used]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["part", "entry", "position", "total", "n"])

    return lean(run)


def _assign(shared, parts: int):
    """(row, code, error) of every vector of the blocks."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        book: np.ndarray = shared.value
        width = book.shape[2]
        for batch in batches:
            for rows, data in zip(batch.column("rows"), batch.column("tree"), strict=True):
                label, error = [], 0
                for p, (points, tree) in enumerate(_unpack_block(data.as_py(), parts * width, parts)):
                    got = filter_tree(tree, points, book[p])[0]
                    label.append(got)
                    error = error + ((points - book[p][got]) ** 2).sum(axis=1)
                code = np.stack(label, axis=1).astype(np.uint8)
                texts = [bytes(c).hex() for c in code]
                yield pa.RecordBatch.from_arrays([rows.values, pa.array(texts, pa.string()), pa.array(error)], names=["row", "code", "error"])

    return lean(run)


# --- Lloyd's rounds


def integer_vectors(vectors: DataFrame, col: str, scale: float) -> Column:
    """floor(scale * x) of every component, as long; null where the vector takes no part."""
    v = F.col(col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(x * scale).cast("long"))
    return F.when(F.col(col).isNotNull() & (F.size(col) > 0) & ~bad, whole)


def _held(dim: int) -> Column:
    """``v``, or an error where squared distances or sums of products might not fit a long."""
    largest = math.isqrt((1 << _LONG) // (16 * dim))
    return F.when(F.exists("v", lambda x: (x > largest) | (x < -largest)), F.raise_error(F.lit(f"a scaled component is beyond {largest}: squared distances might not fit a long"))).otherwise(F.col("v"))


def codebooks_text(book: np.ndarray) -> str:
    """All entries' components by part, entry and position, comma-joined."""
    return ",".join(map(str, book.reshape(-1).tolist()))


def vector_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0, id_col: str = "vec_id", col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector.

    Each part's codebook starts as that part of the ``entries`` first vectors by id (ids null come
    last, equal ids by their integers); each round assigns every part to the nearest entry, ties to
    the lower index, and replaces each entry by the componentwise floor of its parts' mean; an unused
    entry stays. ``code`` has two hex digits a part, ``error`` the squared distances, ``label_error``
    the errors of all rows with an equal label, nulls together.

    Vectors that are null or empty or hold null or non-finite components are left out, and so are
    those whose length is not that of the first vector by id; that length must be a multiple of
    ``parts``. A component whose squares might not fit a long (beyond 2**26 after scaling, for 64
    components) is an error. Rows without an id are coded;
    repeated rows are coded each time. Fewer vectors than entries make fewer entries; an empty table
    has an empty result. Other columns are ignored.

    A round moves parts * entries * width sums a partition; nothing else leaves the partitions.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    spark = vectors.sparkSession
    chosen = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), integer_vectors(vectors, f"`{col}`", scale).alias("v")).filter("v IS NOT NULL")
    first = chosen.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).select(F.size("v")).collect()
    dim = first[0][0] if first else parts
    if dim % parts:
        raise ValueError(f"vectors of {dim} components cannot be cut into {parts} equal parts")
    chosen = chosen.filter(F.size("v") == dim).withColumn("v", _held(dim))
    start = chosen.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    book = np.array([r["v"] for r in start], np.int64).reshape(-1, parts, dim // parts).swapaxes(0, 1)

    row = F.struct("vec_id", "label")
    row_type = T.StructType([T.StructField("vec_id", chosen.schema["vec_id"].dataType), T.StructField("label", chosen.schema["label"].dataType)])
    block_type = T.StructType([T.StructField("rows", T.ArrayType(row_type)), T.StructField("tree", T.BinaryType())])
    trees = chosen.select(row.alias("row"), "v").mapInArrow(_blocks(parts), block_type).persist(StorageLevel.DISK_ONLY)
    try:
        for _ in range(rounds if len(start) else 0):
            book = _moved(trees, book, parts)
        coded_type = T.StructType([T.StructField("row", row_type), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
        coded = cut(trees.mapInArrow(_assign(spark.sparkContext.broadcast(book), parts), coded_type).select("row.*", "code", "error"))
    finally:
        trees.unpersist()
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(codebooks_text(book).encode()).hexdigest()
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("vec_id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _moved(trees: DataFrame, book: np.ndarray, parts: int) -> np.ndarray:
    """The codebooks after one round."""
    shared = trees.sparkSession.sparkContext.broadcast(book)
    found = trees.mapInArrow(_round(shared, parts), "part int, entry int, position int, total long, n long")
    # At most as many rows as the codebooks have components.
    means = found.groupBy("part", "entry", "position").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()
    out = book.copy()
    for r in means:
        out[r["part"], r["entry"], r["position"]] = _floor(r["total"], r["n"])
    shared.unpersist()
    return out


def _floor(total: Decimal, n: Decimal) -> int:
    return int(total) // int(n)
