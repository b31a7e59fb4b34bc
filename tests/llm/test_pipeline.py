"""The pipeline's stages and its whole run against plain Python on small fixtures."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as P
from lexoria.llm.merge_dropout import MergeEncoder, PieceModel
from lexoria.llm.mixing import WEIGHTS
from lexoria.llm.queries import MODEL_FILE
from lexoria.llm.secret_scans import RULES

from .test_llm import DOCS, brute_groups, brute_toxicity, toxic_corpus, words

#: Names that the stages use, or used, inside.
CLASH = ["score", "evidence", "spans", "blob", "_id", "_copies", "variant", "ids", "copy", "copies", "others", "key", "size", "u", "range", "toxic", "n_pieces", "none"]


def fixture(spark, folder, clash=()):
    rng = random.Random(3)
    rows = toxic_corpus(400, seed=9)
    copies = [(1000 + i, t + (" extra" if i % 2 else ""), y) for i, (_, t, y) in enumerate(rows[:40])]
    odd = [(2000, None, None), (2001, "", None), (2002, "my token = abcdefgh123 stays here " * 3 + "AKIA" + "B7" * 9, None), (2003, "password: hunter2hunter2 " + "0123456789abcdef" * 3 + "{}<>" * 30, None)]
    odd += [(None, " ".join(rng.choice(["one", "two", "three"]) for _ in range(20)), None) for _ in range(5)] + [(None, "no id at all", None)] * 2 + [(2004, "same row twice", None)] * 2
    every = rows + copies + odd
    data = [(i, t, "en" if n % 11 else None, f"s{n % 4}" if n % 9 else None, None if t is None else len(t), *(n for _ in clash)) for n, (i, t, _) in enumerate(every)]
    spark.createDataFrame(data, DOCS + "".join(f", `{c}` long" for c in clash)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, y, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return data, {i: y for i, _, y in rows}


def brute_redact(text):
    found = []
    for order, rule in enumerate(RULES):
        found += [(m.start(), order, m.end()) for m in re.finditer(rule.pattern, text or "") if len(m[rule.group]) >= rule.least]
    out, at = "", 0
    for start, _, end in sorted(found):
        if end > at:
            out += (text[at:start] + "[secret]") if start >= at else ""
            at = end
    return out + text[at:] if found else text


def brute_mix(rows):
    """How often each of (doc_id, text, source) is taken, whole."""
    by = defaultdict(list)
    for i, (doc, text, source) in enumerate(rows):
        junk = sum(c in "#$%&*|<>{}[]\\\\^~" for c in text or "")
        quality = max(0.1, 2.0 * (len(text) - junk) / len(text) - 1.0) if text else 0.1
        assert doc is not None
        u = (int(hashlib.md5(f"0:{doc}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
        by[source].append((-math.log(u) / quality, doc, len(words(text)), i))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    size = {s: sum(r[2] for r in by[s]) for s in names}
    weight = {s: float(WEIGHTS[n % len(WEIGHTS)]) for n, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(size.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if 2.0 * size[s] < level * weight[s]]
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        for s in full:
            target[s], left = 2.0 * size[s], left - 2.0 * size[s]
            free.remove(s)
    taken = [0] * len(rows)
    for s in names:
        epochs = math.floor(target[s] / size[s]) if size[s] else 0
        rest, upto = target[s] - epochs * size[s], 0
        for _, _, n, i in sorted(by[s]):
            upto += n
            taken[i] = epochs + (n > 0 and rest > 0 and 2 * upto - n <= 2 * rest)
    return taken


def test_whole_run_matches_brute_force(spark, tmp_path):
    data, label = fixture(spark, tmp_path)
    rows, same, every = [], set(), Counter()
    text_of = {d[0]: d[1] for d in data if d[0] is not None}
    for i in sorted(label):
        if zlib.crc32(str(i).encode()) % 4 == 2:
            continue
        every[label[i]] += 1
        if text_of[i] not in same:
            same.add(text_of[i])
            rows.append((text_of[i], label[i]))
    scores = brute_toxicity([d[1] for d in data], rows, [d[1] for d in data], every)
    kept = [d for d, s in zip(data, scores, strict=True) if s < P.TOXIC]
    named = sorted((d for d in kept if d[0] is not None), key=lambda d: (d[0], d[1] or "", d[3] or ""))
    named = [d for n, d in enumerate(named) if n == 0 or named[n - 1][0] != d[0]]
    groups = brute_groups([d[1] for d in named], [d[0] for d in named])
    kept = [d for d in named if groups[d[0]][1] == d[0]] + [d for d in kept if d[0] is None]
    clean = [(d[0], brute_redact(d[1]), d[3]) for d in kept]
    assert sum(a[1] != b[1] for a, b in zip(clean, kept, strict=True)) >= 2
    run = P.run(spark, str(tmp_path)).collect()
    enc = MergeEncoder(PieceModel.load(MODEL_FILE), 0.0, 0)
    got = Counter((r.doc_id, enc.decode(r.ids), r.source) for r in run)
    # Rows without an id take part in the mix by a hash of their text, which has no plain counterpart:
    # they are checked by what they are, the others by how often they are taken.
    lost = Counter((i, t or "", s) for i, t, s in clean)
    assert set(got) <= set(lost) and all(r.lossless for r in run)
    total = sum(len(words(t)) for _, t, _ in clean)
    assert abs(sum(n * len(words(t)) for (_, t, _), n in got.items()) - 1.5 * total) < 0.05 * total
    frame = spark.createDataFrame([(i, t, "en", s, None) for i, t, s in clean if i is not None], DOCS)
    alone = [c for c in clean if c[0] is not None]
    mixed = Counter((r.doc_id, r.text, r.source) for r in P.mix(spark, frame, str(tmp_path)).collect())
    assert mixed == Counter({c: n for c, n in zip(alone, brute_mix(alone), strict=True) if n})


@pytest.mark.parametrize("clash", [(), CLASH])
def test_stages_keep_columns_rows_and_nulls(spark, tmp_path, clash):
    data, _ = fixture(spark, tmp_path, clash)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [name for name, _ in P.STAGES] == ["toxicity", "ngram_jaccard_join", "secret_scans", "source_mixing", "sentencepiece"]
    kept = P.reject_toxic(spark, docs, str(tmp_path)).cache()
    assert kept.schema == docs.schema and {d[0] for d in data[-13:]} <= {r.doc_id for r in kept.collect()}
    one = P.keep_one_of_near_copies(spark, kept, str(tmp_path)).cache()
    assert one.schema == docs.schema and set(one.collect()) <= set(kept.collect())
    ids = Counter(r.doc_id for r in one.collect())
    assert ids[None] == 7 and ids[2004] == 1 and max(n for i, n in ids.items() if i is not None) == 1
    clean = P.redact_secrets(spark, one, str(tmp_path)).cache()
    text = {r.doc_id: r for r in clean.collect()}
    assert clean.schema == docs.schema and clean.count() == one.count() and "abcdefgh123" not in text[2002].text and text[2002].n_chars == len(text[2002].text)
    others = lambda frame: sorted((str(tuple(r)) for r in frame.collect() if r.doc_id not in (2002, 2003)))
    assert others(clean) == others(one)
    mixed = P.mix(spark, clean, str(tmp_path)).cache()
    assert mixed.schema == docs.schema and set(mixed.collect()) <= set(clean.collect())
    last = P.encode(spark, mixed, str(tmp_path))
    new = [c + "_" if c in clash else c for c in ("n_pieces", "ids", "lossless")]
    assert last.columns == [c for c in docs.columns if c != "text"] + new
    assert last.count() == mixed.count() and last.filter("not lossless").count() == 0


def test_rows_without_an_id_are_mixed_one_by_one(spark, tmp_path):
    texts = [f"text {i} of five " * (i + 1) for i in range(5)]
    frame = spark.createDataFrame([(None, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)] + [(7, "a b c", "en", "s0", 5)] * 4, DOCS)
    got = Counter(r.text for r in P.mix(spark, frame, str(tmp_path)).collect())
    assert len(set(got) & set(texts)) >= 4 and max(n for t, n in got.items() if t in texts) <= 2 and 4 <= got["a b c"] <= 8


def test_a_text_of_several_megabytes_passes_whole(spark, tmp_path):
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(9000)}" for _ in range(600_000)) + " token=abcdefgh99 end"
    rows = [(i, t, "en", "s", len(t)) for i, t, y in toxic_corpus(60) if not y] + [(5000, long, "en", "s", len(long)), (5001, long + " more", "en", "s", len(long) + 5)]
    spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame = spark.createDataFrame(rows, DOCS)
    frame = P.keep_one_of_near_copies(spark, P.reject_toxic(spark, frame, str(tmp_path)), str(tmp_path))
    frame = P.redact_secrets(spark, frame, str(tmp_path)).cache()
    assert {r.doc_id for r in frame.collect()} & {5000, 5001} == {5000}
    row = P.encode(spark, frame.filter("doc_id = 5000"), str(tmp_path)).collect()[0]
    assert row.lossless and MergeEncoder(PieceModel.load(MODEL_FILE), 0.0, 0).decode(row.ids) == long.replace("token=abcdefgh99", "[secret]")


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
