"""How quality filters interact: what each order of applying them removes, and Shapley shares.

Each document becomes a mask of the filters it fails; masks, counted by part, are all that the orders
need. Within a part the orders are visited by single swaps of neighbours, so that a step to the next
order changes two filters' rows only: all others are carried along, and each filter's removals are
added up on the way for its Shapley share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import cut, lean

_WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class TextFilter:
    """A filter by a letter. ``fails`` is made of the columns text, n_words and n_distinct; None
    stands for the repeated-text filter."""

    letter: str
    fails: Column | None


def standard_filters() -> list[TextFilter]:
    """Too short, too repetitive, too many capitals, markup characters, text seen before."""
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    return [
        TextFilter("A", F.col("n_words") < 200),
        TextFilter("B", 100 * F.col("n_distinct") < 50 * F.col("n_words")),
        TextFilter("C", 100 * capitals > 3 * F.length("text")),
        TextFilter("D", F.col("text").rlike("[#$%&*|]")),
        TextFilter("E", None),
    ]


def failure_masks(docs: DataFrame, filters: list[TextFilter], part_col: str = "lang") -> DataFrame:
    """(doc_id, part, mask, n): rows of equal values are one row with their number. Bit i of the mask
    says that the document fails filter i.

    Equal texts are found by their SHA-256. First the smallest id of each text is aggregated, then
    documents meet it by text and id, so that no group of copies, however large, meets in one task.
    A null text is empty, a null part is the empty string. A row without an id is identical to no
    smaller id's text, and no other row is to its.
    """
    id_type = docs.schema["doc_id"].dataType
    base = docs.select(F.col("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    # The list of words is made once a row: what a generator yields is not computed again.
    counted = base.withColumn("w", F.explode(F.array(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)))))
    counted = counted.select("doc_id", "part", "text", F.size("w").alias("n_words"), F.size(F.array_distinct("w")).alias("n_distinct"))
    mask, repeated = F.lit(0), 0
    for i, f in enumerate(filters):
        if f.fails is None:
            repeated |= 1 << i
        else:
            mask = mask + F.when(f.fails, F.lit(1 << i)).otherwise(F.lit(0))
    keyed = counted.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("h"))
    rows = keyed.groupBy("doc_id", "part", "mask", "h").agg(F.count("*").alias("n"))
    if not repeated:
        return rows.drop("h")
    rows = cut(rows)  # some sixty bytes a document; the texts are read once
    named = rows.filter("doc_id IS NOT NULL")
    first = named.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.lit(True).alias("is_first"))
    known = named.join(first, ["h", "doc_id"], "left").withColumn("mask", F.col("mask") + F.when(F.col("is_first"), 0).otherwise(repeated))
    free = rows.filter("doc_id IS NULL")
    return known.select("doc_id", "part", "mask", "n").unionByName(free.select(F.lit(None).cast(id_type).alias("doc_id"), "part", "mask", "n"))


def mask_cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, cells): for each part its counts by mask, at most two to the number of filters:
    (mask, docs, good, toxic). A document is good or toxic where any of its labels says 1; labels
    without an id are ignored, and so are labels of rows without an id."""
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = masks.filter("doc_id IS NOT NULL").join(marks, "doc_id", "left").select("part", "mask", "n", "good", "toxic")
    none = F.lit(None).cast("boolean")
    every = known.unionByName(masks.filter("doc_id IS NULL").select("part", "mask", "n", none.alias("good"), none.alias("toxic")))
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(F.lit(0))).alias(c)
    cells = every.groupBy("part", "mask").agg(F.sum("n").alias("docs"), of("good"), of("toxic"))
    return cells.groupBy("part").agg(F.collect_list(F.struct("mask", "docs", "good", "toxic")).alias("cells"))


def transpositions(n: int) -> Iterator[int]:
    """The places of the swaps that lead through all orders of n things: a swap at i exchanges the
    things at i and i + 1. The last thing sweeps through each order of the others, to and fro."""
    if n < 2:
        return
    down = True
    for swap in [*transpositions(n - 1), None]:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        if swap is not None:
            yield swap + 1 if down else swap
        down = not down


def walk(cells: np.ndarray, n: int) -> tuple[list[list[int]], np.ndarray, np.ndarray, np.ndarray]:
    """(orders, figures, unique failures, Shapley sums). ``cells``: rows (mask, docs, good, toxic).
    figures[o, s]: kept, removed, redundant, good lost, toxic lost of step s of order o."""
    mask, counts = cells[:, 0], cells[:, 1:]
    fails = [counts[(mask >> f) & 1 == 1].sum(axis=0) for f in range(n)]
    unique = np.array([counts[mask == 1 << f, 0].sum() for f in range(n)], np.int64)
    total = counts[:, 0].sum()

    def step(f: int, before: int) -> np.ndarray:
        """What filter f removes after the filters of the set ``before``: docs, good, toxic."""
        return counts[((mask >> f) & 1 == 1) & (mask & before == 0)].sum(axis=0)

    order, removed, before = list(range(n)), [], 0
    for f in order:
        removed.append(step(f, before))
        before |= 1 << f
    orders, figures, shapley = [], [], np.zeros(n, np.int64)
    for swap in [*transpositions(n), None]:
        taken = np.array(removed).reshape(n, 3)
        kept = total - np.cumsum(taken[:, 0])
        redundant = np.array([fails[f][0] for f in order], np.int64) - taken[:, 0]
        orders.append(list(order))
        figures.append(np.column_stack([kept, taken[:, 0], redundant, taken[:, 1:]]))
        shapley[order] += taken[:, 0]
        if swap is None:
            break
        before = sum(1 << f for f in order[:swap])
        order[swap], order[swap + 1] = order[swap + 1], order[swap]
        removed[swap] = step(order[swap], before)
        removed[swap + 1] = step(order[swap + 1], before | 1 << order[swap])
    return orders, np.array(figures), unique, shapley


def _audit(letters: str):
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(batches) -> Iterator[pa.RecordBatch]:
        n = len(letters)
        for batch in batches:
            for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                table = np.array([[c["mask"], c["docs"], c["good"], c["toxic"]] for c in cells], np.int64)
                orders, figures, unique, shapley = walk(table, n)
                flat, at = figures.reshape(-1, 5), np.array(orders).reshape(-1)
                texts = np.repeat(["".join(letters[f] for f in o) for o in orders], n)
                columns = [pa.array([part] * len(flat)), pa.array(texts), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders)))]
                columns += [pa.array(np.ascontiguousarray(x)) for x in (flat[:, 0], flat[:, 1], flat[:, 2], unique[at], flat[:, 3], flat[:, 4], shapley[at])]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return lean(run)


def audit_filters(docs: DataFrame, labels: DataFrame, filters: list[TextFilter] | None = None, part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley): one row for each part, order of the filters and step, zeros included.

    ``kept`` documents are left after the step and ``removed`` go here; ``redundant`` fail its filter
    but went earlier; ``unique_fails`` fail its filter alone; ``good_lost`` and ``toxic_lost`` are the
    removed with such a label; ``shapley`` is the sum of what its filter removes over all orders.

    Every row of ``docs`` counts as a document. An empty table has no parts and an empty result.
    Other columns are ignored. At most 6 filters: the rows are their orders times their number.
    """
    filters = standard_filters() if filters is None else filters
    letters = "".join(f.letter for f in filters)
    if not 1 <= len(filters) <= 6 or len(letters) != len(filters):
        raise ValueError("1 to 6 filters with one letter each")
    cells = mask_cells(failure_masks(docs, filters, part_col), labels)
    figures = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return cells.mapInArrow(_audit(letters), "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in figures))
