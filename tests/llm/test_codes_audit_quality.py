"""Vector codes, the filter audit and the quality classifier against brute force, and their defined
results for nulls, empty texts and tables, ties, repeated rows and extra columns."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexoria.llm import quality_model as Q
from lexoria.llm import words as W
from lexoria.llm.filter_audit import TextFilter, audit_filters, standard_filters, transpositions
from lexoria.llm.packing import unpack
from lexoria.llm.vector_codes import _pack_block, _unpack_block, build_tree, filter_tree, vector_codes

from ..conftest import DATA

# --- op11


def nearest(points, book):
    return ((points[:, None, :] - book[None]) ** 2).sum(axis=2).argmin(axis=1)


@pytest.mark.parametrize("n,dim,spread,k", [(0, 4, 9, 3), (1, 4, 9, 1), (700, 4, 9, 16), (2000, 8, 5000, 16), (900, 3, 2, 16), (300, 2, 1 << 26, 5), (500, 6, 0, 4)])
def test_filtering_assigns_each_point_to_its_nearest_entry(n, dim, spread, k):
    rng = np.random.default_rng(n + dim)
    points = rng.integers(-spread, spread + 1, (n, dim))
    book = np.concatenate([rng.integers(-spread, spread + 1, (k - 1, dim)), points[:1] if n else np.zeros((1, dim), np.int64)])
    label, sums, counts, looked = filter_tree(build_tree(points), points, book)
    want = nearest(points, book) if n else np.zeros(0, int)
    assert (label == want).all() and looked <= n
    assert (counts == np.bincount(want, minlength=k)).all()
    assert all((sums[e] == points[want == e].sum(axis=0)).all() for e in range(k))


def test_whole_subtrees_are_assigned_at_once_and_blocks_survive_packing():
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (8, 8))
    points = centres[rng.integers(0, 8, 5000)] + rng.integers(-20, 21, (5000, 8))
    assert filter_tree(build_tree(points), points, centres)[3] < 100  # of 5,000 points
    both = np.concatenate([points, points[::-1]], axis=1)
    for (p, t), x in zip(_unpack_block(_pack_block(both, 2), 16, 2), (points, points[::-1]), strict=True):
        w = build_tree(x)
        assert (p == x).all() and (t.order == w.order).all()
        assert all((a == b).all() for f in ("start", "low", "high", "total") for a, b in zip(getattr(t, f), getattr(w, f), strict=True))


def lloyd(rows, parts, entries, rounds, scale):
    """rows: (vec_id, vector, label), kept ones. (codes, errors, label errors, digest)."""
    v = [[math.floor(scale * x) for x in vector] for _, vector, _ in rows]
    width = len(v[0]) // parts
    first = sorted(range(len(v)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, v[i]))[:entries]
    cut = lambda x, p: x[p * width : (p + 1) * width]
    books = [[cut(v[i], p) for i in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for x in v:
                groups[best(cut(x, p), books[p])].append(cut(x, p))
            for e, xs in groups.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    codes = [[best(cut(x, p), books[p]) for p in range(parts)] for x in v]
    errors = [sum(far(cut(x, p), books[p][c]) for p, c in enumerate(code)) for x, code in zip(v, codes, strict=True)]
    by_label = Counter()
    for (_, _, label), e in zip(rows, errors, strict=True):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i is None, i or 0), "".join(f"{c:02x}" for c in code), e, by_label[label], digest) for (i, _, label), code, e in zip(rows, codes, errors, strict=True))


VECTORS = "vec_id long, embedding array<float>, label int, code string, error long"


def coded(df, **kw):
    return sorted(((r.vec_id is None, r.vec_id or 0), r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes(df, **kw).collect())


def test_codes_equal_plain_lloyd_with_bad_repeated_and_unnamed_rows(spark):
    rng = np.random.default_rng(5)
    good = [(int(i), [float(x) for x in np.float32(rng.normal(size=8)).round(1)], [1, 2, None][i % 3]) for i in rng.permutation(150)]
    good += [good[0], good[0], (None, [0.5] * 8, 7), (7, [0.25] * 8, None), (200, [0.0] * 8, 2)]
    bad = [(1, None, 1), (2, [], 1), (3, [1.0] * 7 + [None], 1), (4, [1.0] * 7 + [float("nan")], 1), (5, [float("inf")] + [1.0] * 7, 1), (900, [1.0] * 16, 1)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in good + bad], VECTORS)
    want = lloyd(good, 4, 5, 3, 16.0)
    for n in (1, 3):
        assert coded(df.repartition(n), parts=4, entries=5, rounds=3, scale=16.0) == want


def test_codes_of_few_none_and_unfit_vectors(spark):
    few = [(3, [1.0, 2.0], None), (1, [1.0, 2.0], 4)]
    assert coded(spark.createDataFrame([(*r, "", 0) for r in few], VECTORS), parts=2) == lloyd(few, 2, 16, 6, 4096.0)
    empty = vector_codes(spark.createDataFrame([], VECTORS))
    assert empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and empty.count() == 0
    with pytest.raises(ValueError):
        vector_codes(spark.createDataFrame([(1, [1.0] * 3, 1, "", 0)], VECTORS), parts=2)


# --- op12

LABELS = "doc_id long, quality int, toxic int"


def audited(rows, labels):
    """(part, order, step) to figures, by applying each order to each document."""
    fails = {}
    for i, (doc_id, text, _) in enumerate(rows):
        t = text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = doc_id is not None and any(d is not None and d < doc_id and (x or "") == t for d, x, _ in rows)
        fails[i] = {c for c, f in zip("ABCDE", (len(ws) < 200, 100 * len(set(ws)) < 50 * len(ws), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), seen), strict=True) if f}
    mark = lambda k: {d for d, *m in labels if d is not None and m[k] == 1}
    good, toxic = mark(0), mark(1)
    parts = defaultdict(list)
    for i, (_, _, lang) in enumerate(rows):
        parts[lang or ""].append(i)
    out, share = {}, Counter()
    for part, members in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = list(members)
            for step, f in enumerate(order, 1):
                gone = [i for i in left if f in fails[i]]
                left = [i for i in left if f not in fails[i]]
                failing = [i for i in members if f in fails[i]]
                share[part, f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(fails[i] == {f} for i in failing), sum(rows[i][0] in good for i in gone), sum(rows[i][0] in toxic for i in gone)]
    return {(p, o, s): (*v, share[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_swaps_visit_every_order_once():
    for n in range(1, 7):
        order, seen = list(range(n)), set()
        for swap in [*transpositions(n), None]:
            seen.add(tuple(order))
            if swap is not None:
                order[swap], order[swap + 1] = order[swap + 1], order[swap]
        assert len(seen) == math.factorial(n) == len([*transpositions(n)]) + 1


def test_audit_equals_every_order_applied(spark):
    long = " ".join(f"w{i}" for i in range(210))
    rows = [
        (1, long, "en"), (2, long, "de"), (3, long + " #", "en"), (3, long + " #", "en"), (4, "A a", None), (5, None, ""), (6, "", "en"), (7, "x " * 250, "en"), (8, "THE " * 250, "fr"),
        (9, long.upper(), "fr"), (None, long, "en"), (None, "q", None), (10, "É x y $", "de"), (11, "THE " * 250, "fr"), (12, "z" * 200_000 + " |", "de"), (12, "other", "en"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (3, 1, 0), (8, 0, None), (11, 1, 1), (None, 1, 1), (77, 1, 1), (12, 1, 1)]
    docs = spark.createDataFrame([(i, t, part, "clash", 5) for i, t, part in rows], "doc_id long, text string, lang string, mask string, step int").repartition(3)
    marks = spark.createDataFrame(labels, LABELS)
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in audit_filters(docs, marks).collect()}
    assert got == audited(rows, labels)
    assert audit_filters(docs.limit(0), marks).count() == 0
    assert audit_filters(docs, marks.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_audit_of_other_filters(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (2, "a", "en"), (3, "c", "en")], "doc_id int, text string, lang string")
    rows = audit_filters(docs, spark.createDataFrame([], LABELS), [TextFilter("x", F.col("text").contains("a")), TextFilter("y", F.col("n_words") < 2)]).orderBy("filter_order", "step").collect()
    assert [(r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in rows] == [("xy", 1, 1, 2, 0, 1, 3), ("xy", 2, 0, 1, 1, 1, 3), ("yx", 1, 1, 2, 0, 1, 3), ("yx", 2, 0, 1, 1, 1, 3)]
    with pytest.raises(ValueError):
        audit_filters(docs, docs, [*standard_filters(), *standard_filters()])


# --- op13


def features(text, bits):
    """Feature to value by counting n-grams one by one, with the hashes of single words."""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    hashes = [int(W.word_hashes(pa.array([w]), lower=False)[0][0]) for w in ws]
    forms = []
    for i, w in enumerate(ws):
        data = w.encode()
        upper = [65 <= c <= 90 for c in data]
        sign = data[-1] if data[-1] < 128 and not chr(data[-1]).isalnum() else 0
        form = upper[0] + 2 * any(upper[1:]) + 4 * any(48 <= c <= 57 for c in data) + 8 * (i > 0 and ws[i - 1] == w) + 16 * sign
        forms.append(int(W.mix(np.array([form], np.uint64) + Q._PAIR[0])[0]))
    count = Counter()
    for view in (hashes, forms):
        count.update(h % (1 << bits) for h in view)
        for a, b in zip(view, view[1:], strict=False):
            mixed = (a * int(Q._PAIR[0]) + b * int(Q._PAIR[1])) % (1 << 64)
            count[int(W.mix(np.array([mixed], np.uint64))[0]) % (1 << bits)] += 1
    total = sum(count.values())
    return {f: math.sqrt(c / total) for f, c in count.items()}


def ftrl(examples, s):
    """Plain follow-the-regularised-leader over dictionaries, one feature after another."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(f):
        if f != "bias" and abs(z[f]) <= s.l1:
            return 0.0
        shrunk = z[f] if f == "bias" else z[f] - math.copysign(s.l1, z[f])
        return -shrunk / ((s.beta + math.sqrt(n[f])) / s.alpha + s.l2)

    for _ in range(s.passes):
        for x, y in examples:
            x = {**x, "bias": 1.0}
            w = {f: weight(f) for f in x}
            p = 1 / (1 + math.exp(-sum(w[f] * v for f, v in x.items())))
            for f, v in x.items():
                g = (p - y) * v
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / s.alpha * w[f]
                n[f] += g * g
    return {f: weight(f) for f in [*n]}


TEXTS = ["The cat, the cat sat", "BAD!! BAD!! NEWS!! 7", None, "", " \t\n", "é ß Ünder x", "a a a a a", "word " * 5000, "x", "The cat, sat THE"]


def test_features_equal_counting_one_by_one():
    row, feature, value = Q.text_features(pa.array(TEXTS), 10)
    for i, text in enumerate(TEXTS):
        got = dict(zip(feature[row == i].tolist(), value[row == i].tolist(), strict=True))
        assert got == pytest.approx(features(text, 10))


def test_learning_and_scores_equal_plain_python(spark):
    s = Q.Ftrl(bits=12, passes=3)
    texts = [f"{'Good day' if i % 3 else 'BAD!! LUCK!!'} word{i % 7} and word{i}" for i in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([(i, t, "x", 0.0) for i, t in rows], "doc_id long, text string, score string, y double")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)] + [(None, 1, 0), (100, None, 0), (101, 0, 0), (101, 1, 0), (5000, 1, 0)], LABELS)
    known = [(i, float(i % 3 > 0)) for i in range(60) if zlib.crc32(str(i).encode()) % 5] + [(5000, 1.0)] * (zlib.crc32(b"5000") % 5 > 0)
    assert sorted(map(tuple, Q.learnable(labels, Q.held_out()).collect())) == sorted(known)
    place = dict(spark.createDataFrame([(i,) for i, _ in rows], "doc_id long").select("doc_id", F.xxhash64("doc_id")).collect())
    text = dict(rows)
    w = ftrl([(features(text[i], 12), y) for i, y in sorted(known, key=lambda k: place.get(k[0], 0)) if i in text], s)
    for n in (1, 3):
        got = Q.quality(docs.repartition(n), labels, settings=s).collect()
        assert len(got) == len(rows)
        for r in got:
            x = sum(w.get(f, 0.0) * v for f, v in features(text[r.doc_id], 12).items()) + w["bias"]
            assert r.score == pytest.approx(1 / (1 + math.exp(-x)), abs=1e-9)
            assert r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_shards_are_averaged_and_ids_repeat(spark, monkeypatch):
    monkeypatch.setattr(Q, "SHARD_ROWS", 10)
    docs = spark.createDataFrame([(i, f"Good word{i}" if i % 2 else "BAD!! word") for i in range(50)] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)], LABELS)
    s = Q.Ftrl(bits=10, passes=2)
    models = [Q.fit(docs.repartition(n), Q.learnable(labels, F.lit(False)), s) for n in (1, 7)]
    assert (models[0] == models[1]).all()
    assert len({r.score for r in Q.score(docs, models[0]).filter("doc_id = 3").collect()}) == 1


def test_quality_of_empty_tables_and_unnamed_rows(spark):
    docs = spark.createDataFrame([(None, "text"), (1, None)], "doc_id long, text string")
    none = spark.createDataFrame([], LABELS)
    assert {(r.doc_id, r.score, r.held_out, r.predicted) for r in Q.quality(docs, none).collect()} == {(None, 0.5, False, 1), (1, 0.5, zlib.crc32(b"1") % 5 == 0, 1)}
    assert Q.quality(docs.limit(0), none).count() == 0
    with pytest.raises(ValueError):
        Q.score(docs, np.zeros(5), keep=("doc_id",), score_col="doc_id")


def test_quality_of_labels_that_were_not_learnt(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = Q.quality(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    right = sum(r.predicted == r.quality for r in got)
    assert right >= 0.85 * len(got)
