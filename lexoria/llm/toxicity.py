"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Every text is held against the whole TF-IDF vectors of a bounded sample of labelled rows. Terms are
all whole alphanumeric words of the sample, whatever their labels, and besides them, as terms of
their own, the words' beginnings of BEGINNING characters: so the forms of a word are alike without
being the same. Document frequencies are counted over all documents.

The index is a block-max inverted index. Examples of alike frequent words share a block. Lists of
rarer words are short and added up whole; for the frequent words each block keeps its largest
weight of each. A block's bound is the best sum of rare words that one of its examples has, plus
what its largest weights allow; blocks below the k-th cosine are skipped. Whatever may be among
the k nearest is scored in full, so that the search is exact.

The k nearest vote, with weights that fall with distance: cosine ** NEAR / rank ** FAR. k is the
one of NEIGHBOURS whose leave-one-out votes tell the labels best, and votes are calibrated by
isotonic regression on them.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .packing import join, narrow, pack, unpack
from .runtime import cut, give_back, lean, lean_group
from .vector_blocks import top

#: Labelled rows in the sample at most (half of them of label 1, if there are as many), bytes of
#: their texts at most, and of one text: a longer one is no example.
EXAMPLES, EXAMPLE_BYTES, LONGEST = 4_096, 64_000_000, 1_000_000
#: Numbers of neighbours to choose from, and the weight of the prior in a vote.
NEIGHBOURS, PRIOR = (15, 30, 50, 100, 200), 0.25
#: Powers of the cosine and of the rank in a neighbour's weight.
NEAR, FAR = 0.25, 0.5
#: Characters of a beginning, and weights: (1 + ln tf) * idf ** POWER. Chosen by the loss on a quarter
#: of the rows that may be learnt from.
BEGINNING, POWER = 4, 1.5
#: Examples in a block, frequent words with block maxima, texts searched at once, and blocks opened
#: first, for each ``BLOCK`` neighbours asked.
BLOCK, HOT, AT_ONCE, FIRST = 64, 256, 32, 2
#: Examples weighed at once when the lists are made.
LISTED = 256
#: Parts in which document frequencies are summed; bytes of text handled at once.
PARTS, TEXT_BYTES = 32, 1_000_000


def term_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, then of every word's beginning; words per text)."""
    whole, per = W.word_hashes(column, W.PUNCTUATION)
    beginning, _ = W.word_hashes(column, W.PUNCTUATION, BEGINNING)
    return np.concatenate([whole, W.mix(beginning)]), per


def _terms(column: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, tf) of the vocabulary's terms in each text."""
    h, per = term_hashes(column)
    if not len(vocabulary) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    hit = vocabulary[at] == h
    row = np.tile(np.repeat(np.arange(len(per)), per), 2)[hit]
    cell, tf = np.unique(row * len(vocabulary) + at[hit], return_counts=True)
    return cell // len(vocabulary), cell % len(vocabulary), tf


def _weights(row: np.ndarray, term: np.ndarray, tf: np.ndarray, idf: np.ndarray, rows: int) -> np.ndarray:
    """Unit-length weights."""
    w = (1.0 + np.log(tf)) * idf[term]
    return w / np.sqrt(np.bincount(row, w * w, minlength=rows))[row]


def _alike(x: np.ndarray, leaf: int) -> np.ndarray:
    """An order of rows in which each ``leaf`` of them are alike: cut in halves along the direction
    in which they differ most, again and again."""
    out, stack = [], [np.arange(len(x))]
    while stack:
        rows = stack.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        y = x[rows] - x[rows].mean(0)
        v = np.random.default_rng(0).standard_normal(x.shape[1])
        for _ in range(8):
            v = y.T @ (y @ v)
            v /= np.linalg.norm(v) + 1e-300
        order = rows[np.argsort(y @ v, kind="stable")]
        middle = max(leaf, len(rows) // 2 // leaf * leaf)
        stack += [order[middle:], order[:middle]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


@dataclass
class BlockMaxIndex:
    """Examples as (ids, labels) and their (size, term, tf), one after the other.

    Only these travel; each process makes the lists at its first search.
    """

    words: np.ndarray
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    size: np.ndarray
    term: np.ndarray
    tf: np.ndarray
    opened: int = field(default=0, compare=False)
    bounded: int = field(default=0, compare=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "lists"}

    @functools.cached_property
    def lists(self) -> tuple:
        """(example at each place, hot column of each word or -1, weights of hot words by block,
        their maxima, starts, places and weights of the rare words' lists). A process holds them as
        long as the index, so what was needed on the way is given back at once."""
        made = self._lists()
        give_back()
        return made

    def _lists(self) -> tuple:
        n = len(self.ids)
        often = np.bincount(self.term, minlength=len(self.words))
        hot = np.sort(np.argsort(-often, kind="stable")[:HOT])
        slot = np.full(len(self.words), -1, np.int32)
        slot[hot] = np.arange(len(hot))
        blocks, ends = -(-n // BLOCK), np.concatenate([[0], np.cumsum(self.size, dtype=np.int64)])
        dense = np.zeros((blocks * BLOCK, max(1, len(hot))))
        cold = slot[self.term] < 0
        rare, held, row = self.term[cold], np.empty(int(cold.sum())), np.empty(int(cold.sum()), np.int32)
        done = 0
        for a in range(0, n, LISTED):
            b = min(a + LISTED, n)
            s = slice(ends[a], ends[b])
            own = np.repeat(np.arange(b - a, dtype=np.int32), self.size[a:b])
            weight, out = _weights(own, self.term[s], self.tf[s].astype(float), self.idf, b - a), cold[s]
            dense[a + own[~out], slot[self.term[s][~out]]] = weight[~out]
            m = int(out.sum())
            held[done : done + m], row[done : done + m] = weight[out], a + own[out]
            done += m
        del cold
        order = _alike(dense[:n], BLOCK)
        dense[:n] = dense[order]
        dense = dense.reshape(blocks, BLOCK, dense.shape[1])
        place = np.empty(n, np.int32)
        place[order] = np.arange(n, dtype=np.int32)
        at = place[row]
        del row
        by = np.lexsort((at, rare))
        del rare
        at, held = at[by], held[by]
        often[hot] = 0
        return order, slot, dense, np.ascontiguousarray(dense.max(1).T) if n else np.zeros((1, 0)), np.concatenate([[0], np.cumsum(often)]), at, held

    def vectors(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, tf, unit-length weight) of each text."""
        row, term, tf = _terms(column, self.words)
        return row, term, tf, _weights(row, term, tf, self.idf, len(column)) if len(row) else np.zeros(0)

    def search(self, terms: list[np.ndarray], weights: list[np.ndarray], k: int, leave_out: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(examples, cosines) of the k nearest examples with a positive cosine for each vector,
        ties to the smaller id. leave_out: an example for each vector that takes no part."""
        order, slot, dense, maxima, start, place, held = self.lists
        blocks = len(dense)
        first = min(blocks, FIRST * -(-k // BLOCK))
        for a in range(0, len(terms), AT_ONCE):
            some = range(a, min(a + AT_ONCE, len(terms)))
            asked = np.zeros((len(some), dense.shape[2]))
            cos = np.zeros((len(some), blocks * BLOCK))
            for i in some:
                warm = slot[terms[i]] >= 0
                asked[i - a, slot[terms[i][warm]]] = weights[i][warm]
                t, w = terms[i][~warm], weights[i][~warm]
                s, m = start[t], start[t + 1] - start[t]
                at = np.repeat(s - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
                cos[i - a] = np.bincount(place[at], held[at] * np.repeat(w, m), minlength=blocks * BLOCK)
            bound = cos.reshape(len(some), blocks, BLOCK).max(2) + asked @ maxima
            done = np.zeros(bound.shape, bool)

            def open_blocks(todo: np.ndarray, cos: np.ndarray, asked: np.ndarray) -> None:
                for b in np.flatnonzero(todo.any(axis=0)):
                    who = np.flatnonzero(todo[:, b])
                    cos[who, b * BLOCK : (b + 1) * BLOCK] += asked[who] @ dense[b].T

            if blocks:
                np.put_along_axis(done, np.argpartition(-bound, first - 1, axis=1)[:, :first], True, axis=1)
                open_blocks(done, cos, asked)
            seen = np.where(np.repeat(done, BLOCK, axis=1), cos, 0.0)
            left = [-1 if leave_out is None else int(np.flatnonzero(order == leave_out[i])[0]) for i in some]
            for j, p in enumerate(left):
                if p >= 0:
                    seen[j, p] = 0.0
            n = seen.shape[1]
            kth = np.partition(seen, n - k, axis=1)[:, n - k] if k < n else np.zeros(len(some))
            more = (bound >= kth[:, None] - 1e-9) & (bound > 0) & ~done
            open_blocks(more, cos, asked)
            done |= more
            self.opened, self.bounded = self.opened + int(done.sum()), self.bounded + done.size
            for j, p in enumerate(left):
                hit = np.flatnonzero((cos[j] >= max(kth[j] - 1e-9, 1e-12)) & np.repeat(done[j], BLOCK))
                hit = hit[hit != p]
                near = np.round(cos[j, hit], 12)
                pick = top(near, self.ids[order[hit]], k)
                yield order[hit[pick]], near[pick]


@dataclass
class ToxicityModel:
    index: BlockMaxIndex
    prior: float
    k: int
    knots: np.ndarray
    values: np.ndarray

    def vote(self, at: np.ndarray, cos: np.ndarray, k: int | None = None) -> float:
        """The weighted share of label 1 among the k nearest."""
        k = self.k if k is None else k
        weight = cos[:k] ** NEAR / (1.0 + np.arange(len(cos[:k]))) ** FAR
        return float((weight @ self.index.labels[at[:k]] + PRIOR * self.prior) / (weight.sum() + PRIOR))

    def score(self, vote: float) -> float:
        return float(np.interp(vote, self.knots, self.values))


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, least: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Knots and rising values of y's weighted mean over x: pooled adjacent violators over groups of
    equal x of at least ``least`` rows, smoothed by one half of a row."""
    weight = np.ones(len(x)) if weight is None else weight
    order = np.argsort(x, kind="stable")
    groups: list[list[float]] = []  # weight of label 1, weight, rows, sum of x by weight, last x
    mean = lambda g: g[0] / g[1]
    for a, b, w in zip(x[order], y[order], weight[order], strict=True):
        if groups and (groups[-1][2] < least or groups[-1][4] == a):
            g = groups[-1]
            groups[-1] = [g[0] + b * w, g[1] + w, g[2] + 1, g[3] + a * w, a]
        else:
            groups.append([b * w, w, 1, a * w, a])
        while len(groups) > 1 and groups[-1][2] >= least and mean(groups[-2]) >= mean(groups[-1]):
            g = groups.pop()
            groups[-1] = [*(p + q for p, q in zip(groups[-1][:4], g[:4], strict=True)), g[4]]
    if not groups:
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    knots = np.array([g[3] / g[1] for g in groups])
    values = np.array([(g[0] + 0.5 * g[1] / g[2]) / (g[1] + g[1] / g[2]) for g in groups])
    return np.concatenate([[0.0], knots, [1.0]]), np.maximum.accumulate(np.concatenate([[values[0] / 2], values, [(1 + values[-1]) / 2]]))


def _loss(vote: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    p = np.clip(np.interp(vote, *isotonic(vote, y, weight)), 1e-4, 1 - 1e-4)
    return float(-np.average(y * np.log(p) + (1 - y) * np.log(1 - p), weights=weight))


def training_rows(labels: DataFrame, examples: int = EXAMPLES) -> tuple[DataFrame, list[int]]:
    """(doc_id, toxic) of at most ``examples`` labelled documents, those of smallest hash, up to half
    of them of label 1; and how many labelled documents each label has. A document with several
    labels counts by the largest."""
    named = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    named = cut(named)
    every = [named.filter(F.col("toxic") == y).count() for y in (0, 1)]
    take = {1: min(every[1], max(examples // 2, examples - every[0]))}
    take[0] = min(every[0], examples - take[1])
    first = lambda y: named.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id", F.lit(4)), "doc_id").limit(take[y])
    return first(0).unionByName(first(1)), every


def sample_examples(docs: DataFrame, rows: DataFrame, most_bytes: int = EXAMPLE_BYTES) -> DataFrame:
    """(doc_id, text, toxic) of the training rows: equal texts once, none above LONGEST bytes, and no
    more than fit ``most_bytes``, by the hash of the id. As many rows as there are examples are ranked in one task."""
    rows = F.broadcast(rows)  # at most EXAMPLES rows
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(rows, "doc_id").filter(F.octet_length("text") <= LONGEST)
    once = found.withColumn("same", F.sha2("text", 256)).groupBy("same").agg(F.min(F.struct("doc_id", "text", "toxic")).alias("r")).select("r.*")
    sample = cut(once)
    upto = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id", F.lit(4)), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fits = F.broadcast(sample.select("doc_id", upto.alias("upto")).filter(F.col("upto") <= most_bytes).select("doc_id"))
    return sample.join(fits, "doc_id", "left_semi")


def _vocabulary(batches):
    """The distinct terms of texts."""
    for batch in batches:
        text = batch.column("text").cast(pa.large_string())
        for part in W.chunks(text, TEXT_BYTES):
            word = np.unique(term_hashes(text[part])[0])
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64))], names=["word"])


def _frequency(shared):
    """How many texts hold each word of a sorted list, in PARTS packed parts; part -1 counts the texts."""

    def run(batches):
        words = shared.value
        total, rows = np.zeros(len(words), np.int64), 0
        for batch in batches:
            text = batch.column("text").cast(pa.large_string())
            rows += len(text)
            for part in W.chunks(text, TEXT_BYTES):
                _, term, _ = _terms(text[part], words)
                total += np.bincount(term, minlength=len(words)).astype(np.int64)
        parts = [np.array([rows], np.int64), *np.array_split(total, PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, PARTS), pa.int32()), pa.array([pack(narrow(x)) for x in parts], pa.binary())], names=["part", "df"])

    return lean(run)


def _add_up(table: pa.Table) -> pa.Table:
    total = 0
    for x in table.column("df"):
        total = total + unpack(x.as_buffer().to_pybytes())[0].astype(np.int64)
    return pa.table({"part": table.column("part")[:1], "df": pa.array([pack(narrow(total))], pa.binary())})


def _sparse(shared):
    """The vectors of texts, packed."""

    def run(batches):
        for batch in batches:
            text = batch.column("text").cast(pa.large_string())
            out = []
            for part in W.chunks(text, TEXT_BYTES):
                row, term, tf = _terms(text[part], shared.value)
                cuts = np.searchsorted(row, np.arange(part.stop - part.start + 1))
                out += [pack(term[a:b].astype(np.int32), narrow(tf[a:b])) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("toxic").cast(pa.int32()), pa.array(out, pa.binary())], names=["doc_id", "toxic", "vector"])

    return lean(run)


def _left_out(shared, k: int):
    """The nearest examples of each example but itself."""

    def run(batches):
        index: BlockMaxIndex = shared.value
        for batch in batches:
            ids, text = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("text").cast(pa.large_string())
            for part in W.chunks(text, TEXT_BYTES):
                row, term, _, weight = index.vectors(text[part])
                cuts = np.searchsorted(row, np.arange(1, part.stop - part.start))
                found = list(index.search(np.split(term, cuts), np.split(weight, cuts), k, np.searchsorted(index.ids, ids[part])))
                yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array([pack(at, cos) for at, cos in found], pa.binary())], names=["doc_id", "near"])

    return lean(run)


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, neighbours: tuple[int, ...] = NEIGHBOURS) -> ToxicityModel:
    """The model of ``labels`` (doc_id, toxic) over the texts of ``docs``. Only ``examples`` rows of
    the labels are learnt from, equal texts once; document frequencies are counted over all rows of
    ``docs``. What reaches the driver is bounded by the sample, not by the tables."""
    sc = docs.sparkSession.sparkContext
    rows, every = training_rows(labels, examples)
    sample = cut(sample_examples(docs, rows))
    found = sample.select("text").mapInArrow(lean(_vocabulary), "word long").distinct().toArrow()
    words = np.sort(found.column("word").to_numpy().astype(np.int64).view(np.uint64))
    shared = sc.broadcast(words)
    counted = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_frequency(shared), "part int, df binary").groupBy("part").applyInArrow(lean_group(_add_up), "part int, df binary")
    df = {r["part"]: unpack(bytes(r["df"]))[0].astype(float) for r in counted.collect()}
    total = float(df[-1][0]) if df else 0.0
    held = np.concatenate([df[i] for i in range(PARTS)]) if df else np.zeros(len(words))
    idf = (np.log((1.0 + total) / (1.0 + held)) + 1.0) ** POWER

    made = sample.mapInArrow(_sparse(shared), "doc_id long, toxic int, vector binary").orderBy("doc_id").collect()  # at most ``examples`` packed rows
    parts = [unpack(bytes(r["vector"])) for r in made]
    ids, y = np.array([r["doc_id"] for r in made], np.int64), np.array([r["toxic"] for r in made], float)
    size = np.array([len(x) for x, _ in parts], np.int32)
    index = BlockMaxIndex(words, idf, ids, y, size, join([x for x, _ in parts], np.int32), narrow(join([x for _, x in parts], np.uint8)))
    # What an example stands for: the labelled rows of its label over the examples of its label.
    weight = np.array([every[int(v)] / max(1, int((y == v).sum())) for v in (0, 1)])[y.astype(int)]
    prior = ((weight * y).sum() + 0.5) / (weight.sum() + 1)
    model = ToxicityModel(index, prior, neighbours[0], np.zeros(0), np.zeros(0))
    if not len(ids):
        model.knots, model.values = isotonic(np.zeros(0), y)
        return model
    searched = sc.broadcast(index)
    near = {r["doc_id"]: unpack(bytes(r["near"])) for r in sample.select("doc_id", "text").mapInArrow(_left_out(searched, max(neighbours)), "doc_id long, near binary").collect()}
    for used in (shared, searched):
        used.unpersist()
    votes = {k: np.array([model.vote(*near[int(i)], k) for i in ids]) for k in neighbours}
    model.k = min(neighbours, key=lambda k: (_loss(votes[k], y, weight), k))
    model.knots, model.values = isotonic(votes[model.k], y, weight)
    return model


def _scorer(shared, names: list[str], text_at: int):
    """The first columns, as many as have names, with score and evidence after them."""

    def run(batches):
        model: ToxicityModel = shared.value
        memo: dict[bytes, tuple] = {}
        for batch in batches:
            text = batch.column(text_at).cast(pa.large_string())
            for part in W.chunks(text, TEXT_BYTES):
                piece = batch.slice(part.start, part.stop - part.start)
                row, term, tf, weight = model.index.vectors(text[part])
                cuts = np.searchsorted(row, np.arange(len(piece) + 1))
                none = model.score(model.prior)
                score, evidence = np.full(len(piece), none), [""] * len(piece)
                ask: dict[bytes, slice] = {}
                keys: dict[int, bytes] = {}
                for i in np.flatnonzero(np.diff(cuts)):
                    s = slice(cuts[i], cuts[i + 1])
                    keys[i] = hashlib.sha256(term[s].tobytes() + tf[s].tobytes()).digest()
                    if keys[i] not in memo:
                        ask[keys[i]] = s
                found = model.index.search([term[s] for s in ask.values()], [weight[s] for s in ask.values()], model.k)
                for key, (at, cos) in zip(ask, found, strict=True):
                    near = ",".join(f"{model.index.ids[a]}:{c:.4f}:{int(model.index.labels[a])}" for a, c in zip(at[:3], cos[:3], strict=True))
                    memo[key] = (model.score(model.vote(at, cos)), near)
                for i, key in keys.items():
                    score[i], evidence[i] = memo[key]
                if len(memo) > 20_000:
                    memo.clear()
                yield pa.RecordBatch.from_arrays([*piece.columns[: len(names) - 2], pa.array(score), pa.array(evidence, pa.string())], names=names)

    return lean(run)


def score(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",), score_col: str = "score", evidence_col: str = "evidence") -> DataFrame:
    """``keep`` columns of every row, score (0 to 1) and evidence (up to three nearest examples as
    id:cosine:label). A text that shares no word with any example, an empty and a null text get the
    score of the rate of label 1 among the examples. Scores depend on the text alone. Columns of
    any names may be kept; a kept column that has the name of ``score_col`` or ``evidence_col`` is
    an error, so choose others then."""
    if {score_col, evidence_col} & set(keep):
        raise ValueError("a kept column has the name of a result")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*(f"c{i}" for i in range(len(keep))), "score", "evidence"]
    text = [] if "text" in keep else [F.col("text").cast("string").alias("text")]
    chosen = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=False)), *text)
    fields = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(keep, names, strict=False))
    text_at = len(keep) if text else keep.index("text")
    out = chosen.mapInArrow(_scorer(shared, names, text_at), f"{fields}, score double, evidence string")
    return out.toDF(*keep, score_col, evidence_col)


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 when divided by 4; such rows are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every row of ``docs``.

    Nulls: labels without a doc_id or a label are ignored, documents without an id are scored; a
    null text is empty. Repeated rows are scored each time. With no labels at all the score is 0.5.
    Other columns are ignored.
    """
    model = fit(docs, labels.filter(~held_out()))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
