"""The composed retrieval of a batch of questions: feedback, sections, chunks, fallback, challenger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexoria.functions import text as tx
from lexoria.functions.vectors import safe_number
from lexoria.sources.shared import checkpoints

from . import postrank, retrieval
from .bounds import small

#: Entries of a price list at most.
MOST_PRICES = 10_000
SECTION_COUNT, CHUNK_COUNT, FETCH, CHALLENGERS, CHALLENGER_FETCH = 12, 8, 80, 4, 16
SIMILARITY, FLOOR = 0.55, 0.7
FEEDBACK_COUNT, FEEDBACK_SIMILARITY = 4, 0.58
#: Keys of a feedback scope, and those by which feedback outside of conversations is chosen.
SCOPE_KEYS, ATTRIBUTES = ["level", "tenant", "erp", "version", "platform", "guild_id", "channel_id", "thread_id"], ["tenant", "erp", "version"]


def _cut(df: DataFrame) -> DataFrame:
    """A stage's few rows (at most 3 * CHUNK_COUNT a question), materialised in the shared folder,
    so that the stages do not nest into one plan."""
    checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def search_chunks(chunks: DataFrame, questions: DataFrame, count: int = CHUNK_COUNT, fetch: int = FETCH, threshold: float = SIMILARITY, scope: DataFrame | None = None) -> DataFrame:
    """Hybrid search; questions for which it finds nothing get vector search. At most ``fetch`` rows a
    question, neighbours included, or ``count``."""
    first = F.col("position") <= max(fetch, count)
    hybrid = _cut(retrieval.hybrid_match_chunks(chunks, questions, count, threshold, fetch_limit=fetch, scope=scope).filter(first))
    missing = questions.join(hybrid.select("query_id").distinct(), "query_id", "left_anti")
    return _cut(hybrid.unionByName(retrieval.match_chunks(chunks, missing, count, threshold, fetch, scope).filter(first), allowMissingColumns=True))


def search_memory(memory: DataFrame, questions: DataFrame, count: int = FEEDBACK_COUNT, threshold: float = FEEDBACK_SIMILARITY) -> DataFrame:
    """(query_id, position, id, item_id, similarity, origin): the feedback in a question's own scope, if
    it has one, then global feedback for every question; what is in both comes twice. memory: as in
    retrieval.search_feedback; questions: (query_id, query_embedding, scope map or null). A scope without
    a level is a tenant's; a conversation's has to be equal as a whole."""
    scope = tx.normal_scope(F.col("scope"), SCOPE_KEYS)
    asked = _cut(questions.select("query_id", "query_embedding", scope.alias("scope"), F.coalesce(F.element_at(scope, "level"), F.lit("tenant")).alias("level")))
    own, talk = asked.filter(F.size("scope") > 0), F.col("level") == "conversation"
    attributes = F.map_concat(F.create_map(F.lit("level"), F.col("level")), F.map_filter("scope", lambda k, v: k.isin(ATTRIBUTES)))
    found = lambda q, part, exact=False: retrieval.search_feedback(memory, q, count, threshold, exact).withColumn("_part", F.lit(part)).join(asked.select("query_id", "level"), "query_id")
    scoped = found(own.filter(~talk).withColumn("scope", attributes), 0).unionByName(found(own.filter(talk), 0, True))
    both = scoped.unionByName(found(asked.withColumn("scope", F.create_map(F.lit("level"), F.lit("global"))), 1))
    origin = F.when((F.col("_part") == 1) | (F.col("level") == "global"), "feedback_global").otherwise("feedback_scoped")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("_part", "position"))
    return _cut(both.select("query_id", place.alias("position"), "id", "item_id", "similarity", origin.alias("origin")))


def retrieve(chunks: DataFrame, sections: DataFrame, questions: DataFrame, feedback: DataFrame | None = None, threshold: float = SIMILARITY, challenger: bool = True) -> DataFrame:
    """(query_id, slot, id, document_id, chunk_index, content, similarity, origin, routing_scope).

    Sections of a question restrict its chunks, with the sections next to them. Without such chunks,
    or with a best section below threshold * FLOOR, an unrestricted search follows. A question with a
    module filter also gets a few chunks from all modules that it has no copy of yet, two to one. Feedback
    rows (those of search_memory with their content) come first and have no routing scope. Everything is
    deduplicated by content, feedback by its id, first wins.
    """
    questions = _cut(questions.drop("doc_types", "modules").join(retrieval.search_filters(questions), "query_id"))
    hits = _cut(retrieval.hybrid_match_sections(sections, questions, SECTION_COUNT, threshold))
    ids = hits.groupBy("query_id").agg(F.collect_set("id").alias("ids"), F.max(safe_number(F.col("similarity"))).alias("best"))
    named = _cut(questions.drop("section_ids").join(ids, "query_id", "left"))
    restricted = named.filter("ids IS NOT NULL").withColumn("section_ids", F.col("ids")).drop("ids", "best")
    scope = retrieval.scope_of_sections(sections.select("id", "document_id", "section_index"), restricted)
    near = search_chunks(chunks, restricted, threshold=threshold, scope=scope).withColumn("_part", F.lit(0))
    found = near.select("query_id").distinct().withColumn("_found", F.lit(True))
    weak = named.join(found, "query_id", "left").filter(F.col("_found").isNull() | (F.coalesce("best", F.lit(0.0)) < threshold * FLOOR))
    free = weak.withColumn("section_ids", F.array().cast("array<bigint>")).drop("ids", "best", "_found")
    wide = search_chunks(chunks, free, threshold=threshold).withColumn("_part", F.lit(1))
    kb = postrank.dedupe_chunks(near.unionByName(wide, allowMissingColumns=True), ["_part", "position"])
    order = Window.partitionBy("query_id").orderBy("_part", "position")
    filtered = questions.select("query_id", (F.size("modules") > 0).alias("_filtered"))
    kb = kb.withColumn("position", F.row_number().over(order)).drop("_part").join(filtered, "query_id").withColumn("routing_scope", F.when(F.col("_filtered"), "filtered").otherwise("global")).drop("_filtered")
    if challenger:
        broad = questions.filter(F.size("modules") > 0).withColumn("modules", F.array().cast("array<string>"))
        other = search_chunks(chunks, broad, CHALLENGERS, CHALLENGER_FETCH, threshold).withColumn("routing_scope", F.lit("global_challenger"))
        sides = kb.withColumn("_part", F.lit(0)).unionByName(other.withColumn("_part", F.lit(1)), allowMissingColumns=True)
        fresh = postrank.dedupe_chunks(sides, ["_part", "position"]).filter("_part = 1").drop("_part")
        kb = postrank.interleave(kb, fresh)
    else:
        kb = kb.withColumn("slot", F.col("position").cast("long"))
    cols = ["query_id", "slot", "id", "document_id", "chunk_index", "content", "filename", "similarity", "origin", "routing_scope"]
    out = kb.select(*cols).withColumn("_first", F.lit(1))
    if feedback is not None:
        # Without a place in a document until the end, as feedback is told apart by its id.
        none = lambda kind: F.lit(None).cast(kind)
        name = F.concat(F.lit("feedback_"), F.coalesce("item_id", "id").cast("string"), F.lit(".md"))
        f = feedback.select("query_id", F.col("position").cast("long").alias("slot"), "id", none("long").alias("document_id"), none("int").alias("chunk_index"), "content", name.alias("filename"), "similarity", "origin", none("string").alias("routing_scope"), F.lit(0).alias("_first"))
        out = f.unionByName(out)
    once = postrank.dedupe_chunks(out, ["_first", "slot"])
    slot, index = F.row_number().over(Window.partitionBy("query_id").orderBy("_first", "slot")), F.when(F.col("_first") == 0, 0).otherwise(F.col("chunk_index"))
    return once.withColumns({"slot": slot, "chunk_index": index}).drop("_first")


def batches(rows: DataFrame, group: str, order: str, cost: str, cap: int) -> DataFrame:
    """(.., batch): consecutive rows share a batch while their costs fit ``cap``; null for a group
    with any row above it."""
    item = F.struct(F.col(order).alias("o"), F.col(cost).cast("long").alias("c"))
    start = F.struct(F.lit(1).alias("b"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("out"))

    def step(a, x):
        full = (a["used"] + x["c"] > cap) & (a["used"] > 0)
        b = F.when(full, a["b"] + 1).otherwise(a["b"])
        return F.struct(b.alias("b"), F.when(full, x["c"]).otherwise(a["used"] + x["c"]).alias("used"), F.concat(a["out"], F.array(b)).alias("out"))

    g = rows.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("items"), (F.max(cost) > cap).alias("_over"))
    e = g.select(group, "_over", F.explode(F.arrays_zip(F.transform("items", lambda x: x["o"]).alias("o"), F.aggregate("items", start, step, lambda a: a["out"]).alias("b"))).alias("z"))
    e = e.select(group, F.col("z.o").alias(order), F.when(~F.col("_over"), F.col("z.b")).alias("batch"))
    return rows.join(e, [group, order])


def model_cost(calls: DataFrame, pricing: DataFrame) -> DataFrame:
    """(.., cost, cost_status) of calls (call_id, provider, model, input_tokens, output_tokens,
    cached_tokens, reasoning_tokens) under a small price list (provider, known_model, threshold,
    input, cached, output, long_input, long_cached, long_output) in units a million tokens. The
    longest known model that equals the name or begins it before a dash counts."""
    p = small(pricing.withColumnRenamed("provider", "_provider"), MOST_PRICES, "prices")
    model = F.lower(F.trim("model"))
    fit = (F.col("provider") == F.col("_provider")) & ((model == F.col("known_model")) | model.startswith(F.concat("known_model", F.lit("-"))))
    w = Window.partitionBy("call_id").orderBy(F.length("known_model").desc_nulls_last())
    j = calls.join(p, fit, "left").withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    cached, reasoning = F.coalesce("cached_tokens", F.lit(0)), F.coalesce("reasoning_tokens", F.lit(0))
    long = (F.col("threshold") > 0) & (F.col("input_tokens") + cached > F.col("threshold"))
    rate = lambda name: F.when(long, F.col(f"long_{name}")).otherwise(F.col(name))
    cost = F.round((F.col("input_tokens") * rate("input") + cached * rate("cached") + (F.col("output_tokens") + reasoning) * rate("output")) / 1_000_000, 12)
    known = F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull()
    status = F.when(F.col("known_model").isNull(), "unknown_model").when(~known, "usage_incomplete").when(F.col("cached_tokens").isNotNull() & F.col("reasoning_tokens").isNotNull(), "estimated").otherwise("estimated_partial_breakdown")
    return j.select(*calls.columns, F.when(F.col("known_model").isNotNull() & known, cost).alias("cost"), status.alias("cost_status"))
