"""Corpus lifecycle: fingerprints, incremental maintenance, diffs, review states, gap roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts in which items are compared; they are not merged again, so that a task's share stays small. Up to
#: 200, what a scan deals out is not sorted in memory (spark.shuffle.sort.bypassMergeThreshold).
LOSS_PARTS = 200


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of the columns as text, nulls marked, separated by U+001F."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in columns]), 256)


def grouped_fingerprint(rows: DataFrame, by: str | None, columns: list[str]) -> DataFrame:
    """(by, rows, fingerprint) of each group, or of all rows: independent of row order. Row hashes are
    dealt by their first two digits, each part's are listed in order and hashed, and so are the parts'
    hashes, so that a task lists a 256th of a group's hashes."""
    keys = [by] if by else []
    joined = lambda x: F.sha2(F.array_join(x, "\n"), 256)
    hashed = rows.select(*keys, row_hash(columns).alias("h"))
    parts = hashed.groupBy(*keys, F.left("h", F.lit(2)).alias("p")).agg(joined(F.array_sort(F.collect_list("h"))).alias("ph"), F.count("*").alias("n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("p", "ph"))), lambda x: x["ph"])
    return parts.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), joined(listed).alias("fingerprint"))


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, fingerprint) of all rows."""
    return grouped_fingerprint(rows, None, columns)


def plan_ingest(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """(filename, action, reuse_from): skip an unchanged document, reuse another one with an equal
    processing hash (the oldest), else embed. incoming: (filename, processing_hash); existing:
    (filename, processing_hash, created_at)."""
    own = existing.select("filename", F.col("processing_hash").alias("old_hash"))
    donor = F.struct("created_at", F.col("filename").alias("f"))
    oldest = existing.groupBy("processing_hash").agg(F.min(donor).alias("d1"))
    # The oldest of another name stands in where a document would be its own donor.
    second = existing.join(oldest, "processing_hash").filter("filename <> d1.f").groupBy("processing_hash").agg(F.min(donor).alias("d2"))
    j = incoming.join(own, "filename", "left").join(oldest, "processing_hash", "left").join(second, "processing_hash", "left")
    other = F.when(F.col("d1.f") != F.col("filename"), F.col("d1.f")).otherwise(F.col("d2.f"))
    same = F.col("old_hash").eqNullSafe(F.col("processing_hash"))
    return j.select("filename", F.when(same, "skip").when(other.isNotNull(), "reuse").otherwise("embed").alias("action"), F.when(~same, other).alias("reuse_from"))


def check_revision(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(canonical_id, verdict): older revisions and other content under one revision are rejected."""
    j = incoming.join(existing.select("canonical_id", F.col("revision").alias("r"), F.col("content_hash").alias("h")), "canonical_id", "left")
    v = F.when(F.col("r").isNull(), "new").when(F.col("revision") < F.col("r"), "older_revision").when((F.col("revision") == F.col("r")) & (F.col("content_hash") != F.col("h")), "changed_without_revision").when(F.col("revision") == F.col("r"), "unchanged").otherwise("newer")
    return j.select("canonical_id", v.alias("verdict"))


def losses(source: DataFrame, target: DataFrame, categories: list[str]) -> DataFrame:
    """(unit_id, category, lost): per unit and category the multiset of source items beyond the
    target's; nulls are equal. Both: (unit_id, category, item)."""
    items = ["unit_id", "category", "item"]
    signed = source.select(*items, F.lit(1).alias("n")).unionByName(target.select(*items, F.lit(-1).alias("n")))
    # Dealt out before anything is counted: few items occur twice, so counts on the side of the scan would hold a whole split's.
    dealt = signed.filter(F.col("category").isin(categories)).repartition(LOSS_PARTS, "unit_id", "category")
    lost = dealt.groupBy(*items).agg(F.sum("n").alias("lost")).filter("lost > 0")
    return lost.groupBy("unit_id", "category").agg(F.sum("lost").alias("lost"))


def selection_diff(selected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """(key, problem): selected but missing, or present but not selected."""
    a = selected.select(key).distinct().join(present, key, "left_anti").select(key, F.lit("missing").alias("problem"))
    return a.unionByName(present.select(key).distinct().join(selected, key, "left_anti").select(key, F.lit("extra").alias("problem")))


def duplicates(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy(value).agg(F.count("*").alias("n")).filter("n > 1")


#: Allowed review steps: action, states it may start from, the state after it.
REVIEW_STEPS = {"APPROVE": (("PENDING", "REJECTED"), "APPROVED"), "REJECT": (("PENDING", "APPROVED"), "REJECTED"), "PUBLISH": (("APPROVED", "PUBLISHED"), "PUBLISHED")}


def fold_reviews(events: DataFrame) -> DataFrame:
    """(item_id, status, published, rejected_steps): the state of each item after its events in
    order; a step that its state does not allow is counted and has no effect. Publishing again adds
    another published chunk. events: (item_id, at, seq, action)."""
    start = F.struct(F.lit("PENDING").alias("s"), F.lit(0).alias("p"), F.lit(0).alias("bad"))

    def step(a, e):
        out = F.struct(a["s"].alias("s"), a["p"].alias("p"), (a["bad"] + 1).alias("bad"))
        for action, (before, after) in REVIEW_STEPS.items():
            done = F.struct(F.lit(after).alias("s"), (a["p"] + int(action == "PUBLISH")).alias("p"), a["bad"].alias("bad"))
            out = F.when((e["action"] == action) & a["s"].isin(*before), done).otherwise(out)
        return F.when(e["action"] == "SUBMIT", a).otherwise(out)

    ordered = events.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("at", "seq", "action"))).alias("e"))
    r = ordered.select("item_id", F.aggregate("e", start, step).alias("r"))
    return r.select("item_id", F.col("r.s").alias("status"), F.col("r.p").alias("published"), F.col("r.bad").alias("rejected_steps"))


def pending(items: DataFrame, limit: int = 20) -> DataFrame:
    """The oldest pending items; the limit is held within 1..200."""
    return items.filter("status = 'PENDING'").orderBy("created_at", "item_id").limit(max(1, min(limit, 200)))


def knowledge_gaps(log: DataFrame) -> DataFrame:
    """(query, occurrences, max_similarity, platform, first_seen, last_seen): the platform is the
    last one's. log: (query, similarity, platform, ts, seq)."""
    return log.groupBy(F.left("query", F.lit(500)).alias("query")).agg(F.count("*").alias("occurrences"), F.max("similarity").alias("max_similarity"), F.max_by("platform", F.struct("ts", "seq")).alias("platform"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def top_gaps(gaps: DataFrame, limit: int = 10) -> DataFrame:
    return gaps.orderBy(F.col("occurrences").desc(), F.col("last_seen").desc(), "query").limit(max(1, min(limit, 100)))


def stored_priority() -> Column:
    """Rules in order, so that a very long document is 3 whatever its name."""
    name = F.col("filename")
    p = F.when(name.rlike(r"^0[0-5]-") & name.endswith(".md"), 10).when(F.lower(name).contains("faq") | F.lower(name).contains("manual"), 8).otherwise(5)
    return F.when(F.col("chunk_count") > 400, 3).otherwise(p)


def inferred_priority() -> Column:
    """The ingest rule: the name's 10 wins over the length's 3."""
    name = F.col("filename")
    return F.when(name.rlike(r"^0[0-5]-") & name.endswith(".md"), 10).when(F.lower(name).contains("faq") | F.lower(name).contains("manual"), 8).when(F.col("chunk_count") > 400, 3).otherwise(5)


def ensure_identity(registered: DataFrame, wanted: DataFrame) -> DataFrame:
    """(scope, verdict): register, match or mismatch of embedding index identities."""
    same = ["provider", "model", "dimensions", "version"]
    j = wanted.join(registered.select("scope", F.struct(*same).alias("r")), "scope", "left")
    return j.select("scope", F.when(F.col("r").isNull(), "register").when(F.struct(*same) == F.col("r"), "match").otherwise("mismatch").alias("verdict"))


def usage_ledger(calls: DataFrame, order: list[str]) -> DataFrame:
    """(stage, calls, tokens, complete, cost): calls deduplicated by call_id (the first stays), token
    sums, and costs that are null unless all are known. calls: (stage, call_id, tokens, cost, ...)."""
    w = Window.partitionBy("call_id").orderBy(*order)
    once = calls.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    return once.groupBy("stage").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), (F.count("tokens") == F.count("*")).alias("complete"), F.when(F.count("cost") == F.count("*"), F.round(F.sum("cost"), 6)).alias("cost"))
