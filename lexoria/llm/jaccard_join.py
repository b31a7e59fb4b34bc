"""N-gram Jaccard join: a size-aware heavy-light set similarity join over word shingles.

1. Every document becomes its set of k-word shingle hashes. Postings go to hash buckets as packed
   blocks; a shingle that several documents of one block hold is sent once, and its postings go
   straight on, so that a frequent shingle's list never meets in one task.
2. Shingles held by one document only can be in no overlap. Documents that have too few shared
   shingles for the threshold leave; equal sets collapse into one class.
3. Light sets (small): every subset of the size that a pair needs to share is enumerated, and sets
   with an equal subset meet. Heavy sets: inverted lists over the part of each set that an equal
   partner must touch, rarest shingles first, are scanned. The boundary is where enumerating all
   smaller sets would cost more than scanning their lists.
4. Candidates are verified on whole sets. In each list members are first held against a few pivots;
   then every member outside the list's largest component is held against all members of other
   components, by counting overlaps along inverted lists in blocks. No list emits all its pairs,
   and no link that matters to a component is lost.
5. All links lie inside components. Each set is held against all others of its component in the
   same way, and only the number of its links leaves a block.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .packing import join, pack, pack_lists, split, unpack, unpack_lists
from .runtime import Scratch, buckets_for, by_bucket, cut, lean, lean_group, release, text_bytes

#: Counters of the fixed-size frequency sketch that orders shingles (256 KB when broadcast).
SKETCH = 1 << 16
#: Pivots of each inverted list in the first scan.
PIVOTS = 3
#: Shingles are compared by 56 bits: a chance of about 4e-12 for a false match of two sets of 500.
_TOKEN = np.uint64((1 << 56) - 1)
_BLOCK = "bucket int, kind int, payload binary"


def _blocks(k: int, buckets: int):
    """Documents to blocks. Kinds: 0 postings; 1 shingles that this block knows to be shared;
    2 postings of those; 3 sizes and fingerprints."""

    def run(batches):
        for batch in batches:
            keep = batch.filter(batch.column("doc_id").is_valid()).sort_by("doc_id")
            text, ids = keep.column("text").cast(pa.large_string()), keep.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            out: list[tuple[int, int, bytes]] = []
            for part in W.chunks(text):
                yield from _emit(text[part], ids[part], out)
            if out:
                yield _rows(out)

    def _emit(text, ids, out):
        h, per = W.word_hashes(text)
        toks, n = W.shingle_hashes(h, per, k)
        sizes, fp = np.zeros(len(ids), np.int64), np.zeros((2, len(ids)), np.uint64)
        sets, owners = [], []
        ends = np.cumsum(n)
        for i in range(len(ids)):
            s = np.unique(toks[ends[i] - n[i] : ends[i]])
            sizes[i] = len(s)
            with np.errstate(over="ignore"):
                fp[0, i], fp[1, i] = W.mix(s + np.uint64(1)).sum(dtype=np.uint64), (W.mix(s ^ np.uint64(0x5BD1E995)) * np.uint64(3)).sum(dtype=np.uint64)
            sets.append(s)
            owners.append(np.full(len(s), i, np.uint32))
        tok, own = join(sets, np.uint64) & _TOKEN, join(owners, np.uint32)
        order = np.argsort(tok, kind="stable")
        ranked = tok[order]
        first = np.ones(len(tok), bool)
        first[1:] = ranked[1:] != ranked[:-1]
        last = np.ones(len(tok), bool)
        last[:-1] = first[1:]
        single = np.empty(len(tok), bool)
        single[order] = first & last
        spread = int(W.mix(ids[:1].astype(np.uint64))[0] % np.uint64(buckets)) if len(ids) else 0
        bucket_of = lambda t: (t >> np.uint64(24)).astype(np.int64) % buckets
        for b, (t, o) in split(bucket_of(tok[single]), tok[single], own[single]):
            out.append((b, 0, pack_lists(ids[o], t)))
        many = ranked[first & ~last]
        for b, (t,) in split(bucket_of(many), many):
            out.append((b, 1, pack(t)))
        if (~single).any():
            out.append((spread, 2, pack_lists(ids[own[~single]], tok[~single])))
        out.append((spread, 3, pack(ids, sizes, fp[0], fp[1])))
        if sum(len(x[2]) for x in out) > 8_000_000:
            yield _rows(out)
            out.clear()

    def _rows(out):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], names=["bucket", "kind", "payload"])

    return run


def _shared(targets: int):
    """One bucket of shingles: the postings of shared ones, dealt out by document."""

    def run(table: pa.Table) -> pa.Table:
        docs, toks, known, out = [], [], [], []
        for kind, payload in zip(table.column("kind").to_pylist(), table.column("payload"), strict=True):
            data = payload.as_buffer().to_pybytes()
            if kind == 0:
                doc, tok = unpack_lists(data)
                docs.append(doc)
                toks.append(tok)
            elif kind == 1:
                known += unpack(data)
            else:
                x = unpack_lists(data) if kind == 2 else unpack(data)
                for b, part in split(W.mix(x[0].astype(np.uint64)).astype(np.int64) % targets, *x):
                    out.append((b, kind, pack_lists(*part) if kind == 2 else pack(*part)))
        doc, tok, sure = join(docs, np.int64), join(toks, np.uint64), np.unique(join(known, np.uint64))
        order = np.argsort(tok, kind="stable")
        doc, tok = doc[order], tok[order]
        same = np.zeros(len(tok), bool)
        same[1:] = tok[1:] == tok[:-1]
        same[:-1] |= same[1:]
        if len(sure):
            same |= sure[np.minimum(np.searchsorted(sure, tok), len(sure) - 1)] == tok
        doc, tok = doc[same], tok[same]
        for b, part in split(W.mix(doc.astype(np.uint64)).astype(np.int64) % targets, doc, tok):
            out.append((b, 2, pack_lists(*part)))
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int32()), "kind": pa.array([x[1] for x in out], pa.int32()), "payload": pa.array([x[2] for x in out], pa.binary())})

    return run


def _gather(percent: int):
    """One bucket of documents: size, fingerprint, and the shared shingles where they suffice."""

    def run(table: pa.Table) -> pa.Table:
        sizes, docs, toks = [], [], []
        for kind, payload in zip(table.column("kind").to_pylist(), table.column("payload"), strict=True):
            data = payload.as_buffer().to_pybytes()
            if kind == 3:
                sizes.append(unpack(data))
            else:
                doc, tok = unpack_lists(data)
                docs.append(doc)
                toks.append(tok)
        ids, n, f1, f2 = (join([x[i] for x in sizes], t) for i, t in enumerate((np.int64, np.int64, np.uint64, np.uint64)))
        doc, tok = join(docs, np.int64), join(toks, np.uint64)
        order = np.lexsort((tok, doc))
        doc, tok = doc[order], tok[order]
        lo, hi = np.searchsorted(doc, ids), np.searchsorted(doc, ids, side="right")
        enough = (n > 0) & (100 * (hi - lo) >= percent * n)
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int64()), "f1": pa.array(f1.view(np.int64)), "f2": pa.array(f2.view(np.int64)),
            "toks": pa.array([tok[a:b].tobytes() if e else None for a, b, e in zip(lo, hi, enough, strict=True)], pa.binary()),
        })

    return run


def _need(a: int, b: int, percent: int) -> int:
    """The least overlap at which sets of a and b shingles link."""
    return -(-percent * (a + b) // (100 + percent))


def _levels(n: int, percent: int) -> list[int]:
    """The overlaps that a set of n shingles may need with any partner."""
    return sorted({_need(n, m, percent) for m in range(-(-percent * n // 100), 100 * n // percent + 1)} & set(range(1, n + 1)))


def _enumeration(n: int, percent: int) -> int:
    return sum(math.comb(n, c) for c in _levels(n, percent))


def _prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def light_boundary(histogram: dict[int, int], list_length: float, percent: int = 75) -> int:
    """The largest size up to which enumerating subsets costs no more than scanning lists.

    histogram: sets of each size. A set of n shingles costs its number of subsets in the one case,
    and prefix length * list_length * n (comparisons with the members of its lists) in the other.
    """
    best = n = spent = saved = 0
    while n < 40:
        n += 1
        spent += histogram.get(n, 0) * _enumeration(n, percent)
        saved += histogram.get(n, 0) * _prefix(n, percent) * list_length * n
        if spent > saved or _enumeration(n, percent) > 64 * _prefix(n, percent) * list_length * n:
            break
        best = n
    return best


def _cells(batches):
    for batch in batches:
        for part in range(0, len(batch), 2000):
            toks = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("toks")[part : part + 2000]]
            cell, count = np.unique((join(toks, np.uint64) >> np.uint64(36)).astype(np.int64) % SKETCH, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(count.astype(np.int64))], names=["cell", "count"])


def _keys(boundary: int, percent: int, sketch):
    """Light sets: (key of a subset, kind 0); others and those near the boundary: (shingle, kind 1)."""
    plans: dict[int, list[tuple[int, np.ndarray]]] = {}

    def run(batches):
        order_of = sketch.value
        for batch in batches:
            key, ids, sizes, kinds = [], [], [], []
            for doc, n, data in zip(batch.column("id").to_pylist(), batch.column("n").to_pylist(), batch.column("toks"), strict=True):
                tok = np.frombuffer(data.as_buffer(), np.uint64)
                made = []
                if n <= boundary:
                    plan = (n, len(tok))
                    if plan not in plans:
                        plans[plan] = [(c, np.array(list(combinations(range(len(tok)), c)), np.int64)) for c in _levels(n, percent) if c <= len(tok)]
                    with np.errstate(over="ignore"):
                        made += [(0, W.mix(W.mix(tok)[at].sum(axis=1, dtype=np.uint64) + np.uint64(c))) for c, at in plans[plan]]
                if 100 * n >= percent * (boundary + 1):
                    unshared = n - len(tok)
                    often = order_of[(tok >> np.uint64(36)).astype(np.int64) % SKETCH]
                    take = max(0, _prefix(n, percent) - unshared)
                    made.append((1, tok[np.lexsort((tok, often))[:take]]))
                for kind, x in made:
                    key.append(x)
                    ids.append(np.full(len(x), doc, np.int64))
                    sizes.append(np.full(len(x), n, np.int64))
                    kinds.append(np.full(len(x), kind, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(join(key, np.uint64).view(np.int64)), pa.array(join(ids, np.int64)), pa.array(join(sizes, np.int64)), pa.array(join(kinds, np.int32))], names=["key", "id", "n", "kind"])

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for n1, n2, x, y in zip(batch.column("n1").to_pylist(), batch.column("n2").to_pylist(), batch.column("t1"), batch.column("t2"), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                keep.append(100 * both >= percent * (n1 + n2 - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(keep, pa.bool_())], names=["a", "b", "linked"])

    return run


def _check(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) of candidate pairs, on whole sets."""
    one = sets.select(F.col("id").alias("a"), F.col("n").alias("n1"), F.col("toks").alias("t1"))
    two = sets.select(F.col("id").alias("b"), F.col("n").alias("n2"), F.col("toks").alias("t2"))
    return cut(pairs.join(one, "a").join(two, "b").mapInArrow(lean(_verify(percent)), "a long, b long, linked boolean"))


def _scan_lists(percent: int, count: bool = False):
    """Blocks of families: the sets asked (role 1) against all of a block, by counting overlaps
    along the block's inverted lists. Links between different labels; with ``count``, how many
    links to other sets each set has, whatever their labels."""

    def run(table: pa.Table) -> pa.Table:
        a_out, b_out = [], []
        col = {c: table.column(c).to_numpy() for c in ("family", "rows", "cols", "role", "id", "n", "label")}
        toks = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("toks")]
        order = np.lexsort((col["role"], col["cols"], col["rows"], col["family"]))
        key = np.stack([col[c][order] for c in ("family", "rows", "cols")])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        for block in np.split(order, cuts):
            data, queries = block[col["role"][block] == 0], block[col["role"][block] == 1]
            if not len(data) or not len(queries):
                continue
            length = [len(toks[i]) for i in data]
            flat, owner = np.concatenate([toks[i] for i in data]), np.repeat(np.arange(len(data)), length)
            by = np.argsort(flat, kind="stable")
            flat, owner = flat[by], owner[by]
            n, label, ids = col["n"][data], col["label"][data], col["id"][data]
            for q in queries:
                lo, hi = np.searchsorted(flat, toks[q]), np.searchsorted(flat, toks[q], side="right")
                m = hi - lo
                at = np.repeat(lo - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
                both = np.bincount(owner[at], minlength=len(data))
                hit = 100 * both >= percent * (n + col["n"][q] - both)
                if count:
                    a_out.append(col["id"][q : q + 1])
                    b_out.append(np.array([(hit & (ids != col["id"][q])).sum()], np.int64))
                    continue
                hit &= label != col["label"][q]
                a_out.append(np.full(int(hit.sum()), col["id"][q]))
                b_out.append(ids[hit])
        return pa.table({"a": pa.array(join(a_out, np.int64)), "b": pa.array(join(b_out, np.int64))})

    return run


#: Sets in a block of a family; bytes of sets that one task scans, about.
FAMILY_ROWS, SCAN_BYTES = 1_024, 6_000_000


def _degrees(final: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(class, n_links): the links of each set to others, all of which are in its component."""
    wide = final.groupBy("component").agg(F.ceil(F.count("*") / FAMILY_ROWS).cast("int").alias("parts"))
    sized = final.join(wide, "component").select(F.col("component").alias("family"), F.col("node").alias("id"), F.lit(0).cast("long").alias("label"), "parts").join(sets.select("id", "n"), "id")
    part, every = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    data = sized.select("family", "id", "n", "label", F.lit(0).alias("role"), part.alias("cols"), every.alias("rows"))
    asked = sized.select("family", "id", "n", "label", F.lit(1).alias("role"), every.alias("cols"), part.alias("rows"))
    dealt = scratch.keep(data.unionByName(asked))
    tasks = buckets_for(8 * int(dealt.agg(F.sum("n")).first()[0] or 0), SCAN_BYTES)
    spread = F.pmod(F.xxhash64("family", "rows", "cols"), F.lit(tasks)).cast("int")
    counts = dealt.join(sets.select("id", "toks"), "id").withColumn("task", spread).groupBy("task").applyInArrow(lean_group(_scan_lists(percent, count=True)), "a long, b long")
    return cut(counts.groupBy(F.col("a").alias("class")).agg(F.sum("b").alias("n_links")))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", count_links: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every document.

    Documents link when 100 * |A and B| >= percent * |A or B| over their sets of k-word shingles;
    component_id is the smallest id reachable by links, its own included. n_links counts all links
    of the document's class (equal sets) to other classes; without ``count_links`` it is null.

    Nulls: a null text is empty, and an empty set links with nothing, not even with another empty
    one. Rows with a null id are left out. Rows that share an id are one document, for which the
    smallest text by code point stands. Other columns are ignored. Empty tables give empty results.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id IS NOT NULL")
    if docs.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        docs = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
    size = text_bytes(docs)
    buckets = buckets_for(size, 5_000_000)
    targets = buckets_for(size, 12_000_000)
    blocks = docs.mapInArrow(lean(_blocks(k, buckets)), _BLOCK)
    dealt = by_bucket(blocks, buckets, _shared(targets), _BLOCK)
    scratch = Scratch(spark)
    gathered = scratch.keep(by_bucket(dealt, targets, _gather(percent), "doc_id long, n long, f1 long, f2 long, toks binary"))
    release(spark)

    all_docs = cut(gathered.select("doc_id", "n", "f1", "f2"))
    classes = all_docs.filter("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("class"))
    sets = gathered.filter("toks IS NOT NULL").groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "n", "toks")).alias("s"))
    sets = scratch.keep(sets.select(F.col("s.doc_id").alias("id"), "s.n", "s.toks"))
    scratch.clear(gathered)

    histogram = {r["n"]: r["count"] for r in sets.filter("n <= 40").groupBy("n").count().collect()}
    cells = sets.select("toks").mapInArrow(lean(_cells), "cell long, count long").groupBy("cell").agg(F.sum("count").alias("count")).toPandas()
    counts = np.zeros(SKETCH, np.int32)
    counts[cells["cell"].to_numpy(np.int64)] = np.minimum(cells["count"].to_numpy(np.int64), 2**31 - 1)
    each = counts.astype(float)
    # Lists as long as a random posting sees them; what chance collisions in the cells add is taken off.
    length = max(2.0, ((each**2).sum() - each.sum() ** 2 / SKETCH) / max(1.0, each.sum()))
    boundary = light_boundary(histogram, length, percent)
    sketch = spark.sparkContext.broadcast(counts)

    kept = scratch.keep(sets.mapInArrow(lean(_keys(boundary, percent, sketch)), "key long, id long, n long, kind int"))
    close = f"100 * least(n1, n2) >= {percent} * greatest(n1, n2)"
    # Light: in each group of an equal subset, all that can link by it link with its smallest set.
    # Lists: a few pivots of each list and size band, other members against them.
    keys = kept.withColumn("band", F.when(F.col("kind") == 0, F.lit(0)).otherwise(F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent))).cast("int"))
    on = ["kind", "key", "band"]
    member = F.struct("id", "n")
    picks = [F.min(F.struct("n", "id")).alias("p0")] + [F.min_by(member, F.xxhash64(F.col("id"), F.lit(r))).alias(f"p{r}") for r in range(1, PIVOTS)]
    heads = keys.groupBy(*on).agg(F.count("*").alias("members"), *picks).filter("members > 1")
    heads = heads.select(*on, F.array(*[F.struct(F.col(f"p{r}.id").alias("pid"), F.col(f"p{r}.n").alias("pn")) for r in range(PIVOTS)]).alias("heads"))
    star = keys.join(heads, on).select("id", F.col("n").alias("n2"), F.explode(F.array_distinct("heads")).alias("h")).select(F.col("h.pid").alias("pid"), F.col("h.pn").alias("n1"), "id", "n2")
    star = star.filter(f"pid <> id AND {close}").select(F.least("pid", "id").alias("a"), F.greatest("pid", "id").alias("b")).distinct()
    tested = _check(star, sets, percent)
    release(spark)
    label = cut(components(tested.filter("linked")))

    # Lists that still hold several components: the members outside the largest one, the list's
    # family, are scanned against all members. Families meet in blocks, whatever their size.
    lists = keys.filter("kind = 1").select("key", "id").join(label.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("label"))
    per = lists.groupBy("key", "label").count().groupBy("key").agg(F.max(F.struct("count", "label")).alias("main"), F.count("*").alias("labels")).filter("labels > 1").select("key", F.col("main.label").alias("family"))
    members = scratch.keep(lists.join(per, "key").select("family", "id", "label").distinct())
    scratch.clear(kept)
    release(spark)
    wide = members.groupBy("family").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / FAMILY_ROWS)).cast("int").alias("cols"), F.greatest(F.lit(1), F.ceil(F.count_if(F.col("label") != F.col("family")) / FAMILY_ROWS)).cast("int").alias("rows"))
    sized = members.join(wide, "family").join(sets.select("id", "n"), "id")
    column, row = F.pmod(F.xxhash64("id"), F.col("cols")).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("rows")).cast("int")
    data = sized.select("family", "id", "n", "label", F.lit(0).alias("role"), column.alias("cols"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("rows"))
    asked = sized.filter("label <> family").select("family", "id", "n", "label", F.lit(1).alias("role"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("cols"), row.alias("rows"))
    dealt_out = scratch.keep(data.unionByName(asked))
    tasks = buckets_for(8 * int(dealt_out.agg(F.sum("n")).first()[0] or 0), SCAN_BYTES)
    spread = F.pmod(F.xxhash64("family", "rows", "cols"), F.lit(tasks)).cast("int")
    found = dealt_out.join(sets.select("id", "toks"), "id").withColumn("task", spread).groupBy("task").applyInArrow(lean_group(_scan_lists(percent)), "a long, b long")
    links = cut(tested.filter("linked").select("a", "b").unionByName(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct())
    release(spark)
    final = cut(components(links))
    degree = _degrees(final, sets, percent, scratch) if count_links else None
    scratch.clear()

    named = classes.join(final.withColumnRenamed("node", "class"), "class", "left")
    named = named.join(degree, "class", "left") if count_links else named.withColumn("n_links", F.lit(None).cast("long"))
    number = F.coalesce("n_links", F.lit(0).cast("long")) if count_links else F.col("n_links")
    named = named.select("f1", "f2", F.coalesce("component", "class").alias("component_id"), number.alias("n_links"))
    filled = all_docs.filter("n > 0").select("doc_id", "n", "f1", "f2").join(named, ["f1", "f2"])
    out = filled.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    empty = all_docs.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0 if count_links else None).cast("long").alias("n_links"))
    return out.unionByName(empty)
