"""A quality classifier: logistic regression over hashed word n-grams, learnt by FTRL-proximal.

Features are the words of a text and its pairs of neighbouring words, and the same of the words'
forms (capitals, digits, the sign at the end, whether the word before is repeated), hashed to 2**bits
places. The value of a feature is the root of its share of the text's n-grams, so that every text has
length one.

Learning is dealt to shards. In each pass every shard starts from the common state and follows its
examples one by one; then each feature's changes are averaged over the shards that met it. A state is
2**bits places large, whatever the input. Scores are sparse dot products, made where the texts lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .packing import narrow, pack, unpack
from .runtime import cut, lean

#: Labelled documents learnt from at most (those of smallest hash of the id), and in a shard about.
EXAMPLES, SHARD_ROWS, MOST_SHARDS = 16_384, 512, 16
#: Bytes of text that are made into features at once, about.
TEXT_BYTES = 1_000_000
_PAIR = W.stream(2, seed=131) | np.uint64(1)
_CAPITAL, _DIGIT = np.zeros(256, np.int64), np.zeros(256, np.int64)
_CAPITAL[65:91] = _DIGIT[48:58] = 1


@dataclass(frozen=True)
class Ftrl:
    """Settings: hashed places, passes, learning rate, its offset, and penalties. The defaults were
    chosen by the loss on a fifth of the rows that may be learnt from."""

    bits: int = 18
    passes: int = 4
    alpha: float = 2.0
    beta: float = 0.1
    l1: float = 0.01
    l2: float = 0.0


def word_forms(text: pa.Array, h: np.ndarray) -> np.ndarray:
    """A number for the form of each word, in the order of its hashes ``h``: whether it begins with a
    capital, has another, has a digit, equals the word before, and the ASCII sign at its end."""
    data, off = W.raw(text)
    start, end, per = W.word_spans(data, off)
    if not len(start):
        return np.zeros(0, np.uint64)
    capitals, digits = (np.append(0, np.cumsum(kind[data])) for kind in (_CAPITAL, _DIGIT))
    sign = np.where(W.PUNCTUATION[data[end - 1]], data[end - 1].astype(np.int64), 0)
    first = np.cumsum(per) - per
    again = np.append(False, h[1:] == h[:-1])
    again[first[per > 0]] = False
    form = capitals[start + 1] - capitals[start] + 2 * (capitals[end] > capitals[start + 1]) + 4 * (digits[end] > digits[start]) + 8 * again + 16 * sign
    return W.mix(form.astype(np.uint64) + _PAIR[0])


def text_counts(text: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, count) of a column of texts, by row and feature. A null text is empty and has
    none."""
    h, per = W.word_hashes(text, lower=False)
    row, places = np.repeat(np.arange(len(per)), per), np.uint64((1 << bits) - 1)
    inside = row[:-1] == row[1:]
    found, of = [], []
    for one in (h, word_forms(text, h)):
        with np.errstate(over="ignore"):
            pair = W.mix(one[:-1] * _PAIR[0] + one[1:] * _PAIR[1])
        found += [one & places, pair[inside] & places]
        of += [row, row[:-1][inside]]
    key, count = np.unique(np.concatenate(of) << bits | np.concatenate(found).astype(np.int64), return_counts=True)
    return key >> bits, key & int(places), count


def text_features(text: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of a column of texts, by row and feature."""
    row, feature, count = text_counts(text, bits)
    return row, feature, np.sqrt(count / np.bincount(row, count, minlength=len(text))[row])


def weights(z: np.ndarray, n: np.ndarray, s: Ftrl, bias: int) -> np.ndarray:
    """The weights that a state stands for. The last place, ``bias``, has no L1 penalty."""
    shrunk = z - np.sign(z) * s.l1
    w = np.where(np.abs(z) <= s.l1, 0.0, -shrunk / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))
    if len(z) and len(w) > bias:
        w[bias] = -z[bias] / ((s.beta + np.sqrt(n[bias])) / s.alpha + s.l2)
    return w


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def follow(z: np.ndarray, n: np.ndarray, examples: Iterator[tuple[np.ndarray, np.ndarray, float]], s: Ftrl) -> None:
    """Update a state (z, n) by examples (features, values, label), one by one. The last place of a
    state is the bias, which every example has with value 1."""
    bias = len(z) - 1
    for feature, value, y in examples:
        at, x = np.append(feature, bias), np.append(value, 1.0)
        w = weights(z[at], n[at], s, len(at) - 1)
        g = (sigmoid(w @ x) - y) * x
        more = n[at] + g * g
        z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / s.alpha * w
        n[at] = more


def _made(s: Ftrl):
    """(key, doc_id, y, features) of labelled texts."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch.column("text").cast(pa.large_string()), TEXT_BYTES):
                piece = batch.slice(part.start, part.stop - part.start)
                row, feature, count = text_counts(piece.column("text"), s.bits)
                cuts = np.searchsorted(row, np.arange(len(piece) + 1))
                packed = [pack(narrow(np.diff(feature[a:b], prepend=0)), narrow(count[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("shard", "place", "doc_id", "y")), pa.array(packed, pa.binary())], names=["shard", "place", "doc_id", "y", "features"])

    return lean(run)


def _pass(shared, s: Ftrl):
    """The changes of each shard's state in one pass; rows come by shard, and in order."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        z0, n0 = shared.value
        z, n, shard = z0.copy(), n0.copy(), None

        def changes() -> pa.RecordBatch:
            met = np.flatnonzero((n != n0) | (z != z0))
            columns = [np.full(len(met), shard, np.int32), met.astype(np.int32), z[met] - z0[met], n[met] - n0[met]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shard", "feature", "dz", "dn"])

        for batch in batches:
            shards, ys = batch.column("shard").to_numpy(), batch.column("y").to_numpy()
            for i, data in enumerate(batch.column("features")):
                if shard is not None and shards[i] != shard:
                    yield changes()
                    z, n = z0.copy(), n0.copy()
                shard = int(shards[i])
                steps, count = unpack(data.as_py())
                follow(z, n, [(np.cumsum(steps, dtype=np.int64), np.sqrt(count / max(1, count.sum(dtype=np.int64))), float(ys[i]))], s)
        if shard is not None:
            yield changes()

    return lean(run)


def learnable(labels: DataFrame, held_out: Column, examples: int = EXAMPLES) -> DataFrame:
    """(doc_id, y): the labels that are learnt from, ``examples`` at most. Rows that are held out,
    without an id or with another label than 0 or 1, and ids whose labels differ are left out."""
    y = F.col("quality").cast("double")
    known = labels.filter(~held_out & F.col("doc_id").isNotNull() & y.isin(0.0, 1.0)).groupBy("doc_id").agg(F.min(y).alias("y"), F.max(y).alias("most")).filter("y = most")
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples).select("doc_id", "y")


def fit(docs: DataFrame, labels: DataFrame, settings: Ftrl | None = None, examples: int = EXAMPLES) -> np.ndarray:
    """The weights learnt from ``labels`` (doc_id, y) and the texts of ``docs`` (of a repeated id, the
    smallest text). Passes are deterministic: shards follow from the ids, and are added up in order."""
    s = settings or Ftrl()
    spark = docs.sparkSession
    chosen = labels.limit(examples).collect()  # ids and labels, bounded by ``examples``
    z, n = np.zeros((1 << s.bits) + 1), np.zeros((1 << s.bits) + 1)
    if not chosen:
        return weights(z, n, s, 1 << s.bits)
    shards = min(MOST_SHARDS, max(1, len(chosen) // SHARD_ROWS))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = spark.createDataFrame([(r["doc_id"], r["y"]) for r in chosen], f"doc_id {id_type}, y double")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(rows), "doc_id")
    once = texts.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    dealt = once.withColumn("place", F.xxhash64("doc_id")).withColumn("shard", F.pmod("place", F.lit(shards)).cast("int"))
    made = dealt.select("shard", "place", "doc_id", "y", "text").mapInArrow(_made(s), f"shard int, place long, doc_id {id_type}, y double, features binary")
    # Dealt and sorted once: a checkpoint keeps its partitions, so that no pass shuffles examples.
    sorted_rows = cut(made.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "place", "doc_id"))
    for _ in range(s.passes):
        shared = spark.sparkContext.broadcast((z, n))
        found = sorted_rows.mapInArrow(_pass(shared, s), "shard int, feature int, dz double, dn double")
        mean = lambda c: F.aggregate("d", F.lit(0.0), lambda a, x: a + x[c]) / F.size("d")
        # By feature, in the order of the shards: at most 2**bits + 1 rows.
        moved = found.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("shard", "dz", "dn"))).alias("d")).select("feature", mean("dz").alias("dz"), mean("dn").alias("dn")).toArrow()
        at = moved.column("feature").to_numpy()
        z[at] += moved.column("dz").to_numpy()
        n[at] += moved.column("dn").to_numpy()
        shared.unpersist()
    return weights(z, n, s, 1 << s.bits)


def _scorer(shared, names: list[str], text_at: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        w: np.ndarray = shared.value
        bits = (len(w) - 1).bit_length() - 1
        for batch in batches:
            text = batch.column(text_at).cast(pa.large_string())
            for part in W.chunks(text, TEXT_BYTES):
                piece = batch.slice(part.start, part.stop - part.start)
                row, feature, value = text_features(text[part], bits)
                score = sigmoid(w[-1] + np.bincount(row, value * w[feature], minlength=len(piece)))
                yield pa.RecordBatch.from_arrays([*piece.columns[: len(names) - 1], pa.array(score)], names=names)

    return lean(run)


def score(docs: DataFrame, model: np.ndarray, keep: tuple[str, ...] = ("doc_id",), score_col: str = "score") -> DataFrame:
    """``keep`` columns of every row and the chance of label 1, from the text alone. An empty or null
    text has that of the bias. A kept column of the name of ``score_col`` is an error."""
    if score_col in keep:
        raise ValueError("a kept column has the name of the result")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*(f"c{i}" for i in range(len(keep))), "score"]
    chosen = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=False)), F.col("text").cast("string").alias("text"))
    fields = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(keep, names, strict=False))
    return chosen.mapInArrow(_scorer(shared, names, len(keep)), f"{fields}, score double").toDF(*keep, score_col)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text can be divided by 5; such rows are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, settings: Ftrl | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Documents without an id are scored too, and repeated rows each time; a null text is empty. With
    no labels to learn from every score is 0.5. Other columns are ignored.
    """
    model = fit(docs, learnable(labels, held_out()), settings)
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
