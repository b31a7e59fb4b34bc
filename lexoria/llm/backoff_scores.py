"""Stupid-backoff scores of documents under bigram and unigram counts of the whole corpus.

score(w | v) = c(v w) / c(v) where c(v w) >= min_count, else alpha * c(w) / N; a text's first word
has c(w) / N. Counts cover all documents.

The n-gram tables are partitioned by hash: a word's bucket holds its count and the counts of the
bigrams that begin with it. Each document's distinct bigrams are joined to them there; words that
are backed off to go on to the bucket of their own, and sums per document come back and are added.
Blocks of postings name each word once, by 64-bit hash. The few words and bigrams that make up a
fixed share of the corpus are counted first; their bigrams are scored where they are read or spread
over all buckets, so that no bucket holds a very frequent key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .packing import join, narrow, pack, split, unpack
from .runtime import buckets_for, by_bucket, cut, lean, text_bytes

#: A word or bigram with this share of all is counted beforehand. With the number of buckets the
#: share falls, so that a word that stays below it is a fraction of a bucket, down to LEAST_SHARE: at
#: most 2 / LEAST_SHARE words and as many bigrams (8 MB each) are broadcast at any size.
HOT_SHARE, LEAST_SHARE = 1 / 8_192, 1 / 262_144
_BLOCK = "bucket int, kind int, payload binary"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POSTINGS, _REQUESTS, _COUNTS, _SUMS = range(4)


def _name(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A 64-bit name of the bigram v w."""
    with np.errstate(over="ignore"):
        return W.mix(v * _ODD + W.mix(w + _ODD))


def _bigrams(h: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, second word, text) of every bigram."""
    row = np.repeat(np.arange(len(per)), per)
    inside = row[1:] == row[:-1]
    return h[:-1][inside], h[1:][inside], row[1:][inside]


def _lookup(table: tuple[np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The count of each x in a table with sorted keys, 0 where it is missing."""
    keys, counts = table
    if not len(keys) or not len(x):
        return np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, counts[at], 0)


def _texts(batch: pa.RecordBatch):
    keep = batch.sort_by("doc_id")
    text, ids = keep.column("text").cast(pa.large_string()), keep.column("doc_id").to_numpy(zero_copy_only=False)
    for part in W.chunks(text, 6_000_000):
        h, per = W.word_hashes(text[part])
        yield ids[part], h, per


def _frequent(share: float):
    """Words (0) and bigrams (1) with at least half the hot share of a partition; its words (2)."""

    def run(batches):
        yield from _often(batches, share)

    return lean(run)


def _often(batches, share: float):
    found, total = {0: [], 1: []}, 0
    for batch in batches:
        for _, h, per in _texts(batch):
            total += len(h)
            v, w, _ = _bigrams(h, per)
            for kind, x in ((0, h), (1, _name(v, w))):
                u, c = np.unique(x, return_counts=True)
                keep = c * 4 >= share * len(h)
                found[kind].append((u[keep], c[keep]))
    rows = [(2, 0, total)]
    for kind, parts in found.items():
        u, inverse = np.unique(join([p[0] for p in parts], np.uint64), return_inverse=True)
        c = np.bincount(inverse, join([p[1] for p in parts], np.int64), minlength=len(u)).astype(np.int64)
        keep = c * 2 >= share * total
        rows += [(kind, k, n) for k, n in zip(u[keep].view(np.int64).tolist(), c[keep].tolist(), strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["kind", "key", "n"])


def _count(words: np.ndarray, bigrams: np.ndarray):
    """Exact counts of the given words (0) and bigrams (1)."""

    def run(batches):
        total = {0: np.zeros(len(words), np.int64), 1: np.zeros(len(bigrams), np.int64)}
        for batch in batches:
            for _, h, per in _texts(batch):
                v, w, _ = _bigrams(h, per)
                for kind, known, x in ((0, words, h), (1, bigrams, _name(v, w))):
                    if len(known):
                        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                        total[kind] += np.bincount(at[known[at] == x], minlength=len(known)).astype(np.int64)
        kind = np.repeat([0, 1], [len(words), len(bigrams)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([words, bigrams]).view(np.int64)), pa.array(np.concatenate([total[0], total[1]]))], names=["kind", "key", "n"])

    return run


def _owners(doc: np.ndarray) -> list[np.ndarray]:
    """Ascending owners as (first, steps, counts)."""
    used, count = np.unique(doc, return_counts=True)
    return [used[:1].astype(np.int64), narrow(np.diff(used)), narrow(count)]


def _owned(first: np.ndarray, steps: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.repeat(np.concatenate([first, first + np.cumsum(steps.astype(np.int64))]), count)


def _coded(x: np.ndarray) -> list[np.ndarray]:
    table, at = np.unique(x, return_inverse=True)
    return [table, narrow(at)]


def _bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    return (x >> np.uint64(32)).astype(np.int64) % buckets


def _doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return _bucket(W.mix(doc.astype(np.uint64)), buckets)


def _sum_blocks(doc: np.ndarray, value: np.ndarray, buckets: int, out: list, words: np.ndarray | None = None) -> None:
    u, inverse = np.unique(doc, return_inverse=True)
    total = np.bincount(inverse, value, minlength=len(u))
    n = np.zeros(len(u), np.int64) if words is None else np.bincount(inverse, words, minlength=len(u)).astype(np.int64)
    for b, (d, s, k) in split(_doc_bucket(u, buckets), u, total, n):
        out.append((b, _SUMS, pack(d[:1], narrow(np.diff(d)), s, narrow(k))))


def _batch(out: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "kind", "payload"])


def _explode(hot, buckets: int):
    def run(batches):
        words, bigrams, total = hot.value
        for batch in batches:
            for own, h, per in _texts(batch):
                out: list[tuple[int, int, bytes]] = []
                v, w, row = _bigrams(h, per)
                score = np.zeros(len(own))
                known = _lookup(bigrams, _name(v, w))
                done = known > 0  # then v is frequent, too
                score += np.bincount(row[done], np.log(known[done] / np.maximum(1, _lookup(words, v[done]))), minlength=len(own))
                v, w, row = v[~done], w[~done], row[~done]
                name = _name(v, w)
                order = np.lexsort((name, row))
                v, w, row, name = v[order], w[order], row[order], name[order]
                new = np.ones(len(v), bool)
                new[1:] = (row[1:] != row[:-1]) | (name[1:] != name[:-1])
                at = np.flatnonzero(new)
                tf = np.diff(np.append(at, len(v)))
                v, w, row, name = v[at], w[at], row[at], name[at]
                for b, (r, v_, w_, t) in split(_bucket(np.where(_lookup(words, v) > 0, name, v), buckets), row, v, w, tf):
                    out.append((b, _POSTINGS, pack(*_owners(own[r]), *_coded(v_), *_coded(w_), narrow(t))))
                some = per > 0
                first, row = h[(np.cumsum(per) - per)[some]], np.flatnonzero(some)
                c = _lookup(words, first)
                score[row[c > 0]] += np.log(c[c > 0] / total)
                for b, (r, w_) in split(_bucket(first[c == 0], buckets), row[c == 0], first[c == 0]):
                    out.append((b, _REQUESTS, pack(*_owners(own[r]), *_coded(w_), np.ones(len(w_), np.uint8), np.zeros(1))))
                u, c = np.unique(h, return_counts=True)
                rare = _lookup(words, u) == 0
                for b, (w_, c_) in split(_bucket(u[rare], buckets), u[rare], c[rare]):
                    out.append((b, _COUNTS, pack(w_, narrow(c_))))
                _sum_blocks(own, score, buckets, out, per.astype(float))
                yield _batch(out)

    return run


def _word_counts(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    u, inverse = np.unique(join([p[0] for p in parts], np.uint64), return_inverse=True)
    return u, np.bincount(inverse, join([p[1] for p in parts], np.int64), minlength=len(u)).astype(np.int64)


def _join_bigrams(hot, buckets: int, alpha: float, min_count: int):
    """A bucket of the tables against its postings: sums for what is found, requests for the rest."""

    def run(table: pa.Table) -> pa.Table:
        words, _, total = hot.value
        out: list[tuple[int, int, bytes]] = []
        parts: dict[int, list] = {k: [] for k in range(4)}
        for kind, payload in zip(table.column("kind").to_pylist(), table.column("payload"), strict=True):
            data = payload.as_buffer().to_pybytes()
            if kind in (_REQUESTS, _SUMS):
                out.append((table.column("bucket")[0].as_py(), kind, data))
            else:
                parts[kind].append(unpack(data))
        counts = _word_counts(parts[_COUNTS])
        if len(counts[0]):
            out.append((table.column("bucket")[0].as_py(), _COUNTS, pack(counts[0], narrow(counts[1]))))
        x = parts[_POSTINGS]
        doc = join([_owned(*p[:3]) for p in x], np.int64)
        v, w = join([p[3][p[4]] for p in x], np.uint64), join([p[5][p[6]] for p in x], np.uint64)
        tf = join([p[7] for p in x], np.int64).astype(np.int64)
        name, inverse = np.unique(_name(v, w), return_inverse=True)
        c = np.bincount(inverse, tf, minlength=len(name)).astype(np.int64)[inverse]
        seen = c >= min_count
        begin = _lookup(counts, v[seen])
        begin = np.where(begin > 0, begin, _lookup(words, v[seen]))
        sums = [(doc[seen], tf[seen] * np.log(c[seen] / begin))]
        doc, w, tf = doc[~seen], w[~seen], tf[~seen]
        frequent = _lookup(words, w)
        at = frequent > 0
        sums.append((doc[at], tf[at] * np.log(alpha * frequent[at] / total)))
        _sum_blocks(np.concatenate([s[0] for s in sums]), np.concatenate([s[1] for s in sums]), buckets, out)
        order = np.argsort(doc[~at], kind="stable")
        doc, w, tf = doc[~at][order], w[~at][order], tf[~at][order]
        for b, (d, w_, t) in split(_bucket(w, buckets), doc, w, tf):
            out.append((b, _REQUESTS, pack(*_owners(d), *_coded(w_), narrow(t), np.full(1, np.log(alpha)))))
        return pa.Table.from_batches([_batch(out)])

    return run


def _join_words(hot, buckets: int):
    """A bucket of words against the requests for them."""

    def run(table: pa.Table) -> pa.Table:
        total = hot.value[2]
        out, asked, counted, sums = [], [], [], []
        for kind, payload in zip(table.column("kind").to_pylist(), table.column("payload"), strict=True):
            data = payload.as_buffer().to_pybytes()
            if kind == _SUMS:
                sums.append(_docs_of(unpack(data)))
            elif kind == _COUNTS:
                counted.append(unpack(data))
            else:
                asked.append(unpack(data))
        counts = _word_counts(counted)
        doc, value = [], []
        for p in asked:
            c = _lookup(counts, p[3])
            doc.append(_owned(*p[:3]))
            value.append(p[5] * (np.log(c / total)[p[4]] + p[6][0]))
        _sum_blocks(join(doc, np.int64), join(value, np.float64), buckets, out)
        # All sums of a document meet here, in the bucket of its id: they go on as one.
        d, x, n = (join([p[i] for p in sums], kind) for i, kind in enumerate((np.int64, np.float64, np.int64)))
        order = np.lexsort((x, d))
        _sum_blocks(d[order], x[order], buckets, out, n[order].astype(float))
        return pa.Table.from_batches([_batch(out)])

    return run


def _docs_of(x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first, steps, s, n = x
    return np.concatenate([first, first + np.cumsum(steps.astype(np.int64))]), s, n.astype(np.int64)


def _total(table: pa.Table) -> pa.Table:
    parts = [_docs_of(unpack(payload.as_buffer().to_pybytes())) for payload in table.column("payload")]
    doc, value, words = (join([p[i] for p in parts], kind) for i, kind in enumerate((np.int64, np.float64, np.int64)))
    order = np.lexsort((value, doc))  # a fixed order of addition: reruns agree to the last bit
    u, inverse = np.unique(doc[order], return_inverse=True)
    return pa.table({"doc_id": u, "n_words": np.bincount(inverse, words[order], minlength=len(u)).astype(np.int64), "log_score": np.bincount(inverse, value[order], minlength=len(u))})


def score_documents(docs: DataFrame, alpha: float = 0.4, min_count: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) of every document, in natural logarithms.

    Nulls: a null or empty text has no words, log_score 0 and a null mean; rows with a null id are
    left out. Rows that share an id are one document: their scores and words are added. Other
    columns are ignored. An empty table gives an empty result.
    """
    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).filter("doc_id IS NOT NULL")
    size = text_bytes(docs)
    buckets = buckets_for(size, 16_000_000, 12)
    schema = "kind int, key long, n long"
    share = max(min(HOT_SHARE, 1 / (4 * buckets)), LEAST_SHARE)
    some = cut(docs.mapInArrow(_frequent(share), schema).groupBy("kind", "key").agg(F.sum("n").alias("n")))
    total = some.filter("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = some.filter((F.col("kind") < 2) & (F.col("n") * 2 >= share * total) & (F.col("n") >= 2 * min_count)).collect()  # at most 4 / share rows
    sets = [np.sort(np.array([r["key"] for r in often if r["kind"] == k], np.int64).view(np.uint64)) for k in (0, 1)]
    exact = {(r["kind"], r["key"]): r["n"] for r in docs.mapInArrow(lean(_count(*sets)), schema).groupBy("kind", "key").agg(F.sum("n").alias("n")).collect()}
    counts = [np.array([exact.get((k, key), 0) for key in s.view(np.int64).tolist()], np.int64) for k, s in enumerate(sets)]
    hot = sc.broadcast(((sets[0], counts[0]), (sets[1], counts[1]), total))
    blocks = docs.mapInArrow(lean(_explode(hot, buckets)), _BLOCK)
    blocks = by_bucket(blocks, buckets, _join_bigrams(hot, buckets, alpha, min_count), _BLOCK)
    blocks = by_bucket(blocks, buckets, _join_words(hot, buckets), _BLOCK)
    summed = by_bucket(blocks, buckets, _total, "doc_id long, n_words long, log_score double")
    return summed.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
