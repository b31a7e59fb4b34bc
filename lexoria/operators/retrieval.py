"""Vector, lexical and hybrid retrieval for batches of questions.

The question side is small and checked before it is broadcast; the corpus side is scanned once.
All windows are partitioned by query_id, and ranked cuts become group limits before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexoria.functions.vectors import cosine_similarity, dot, norm
from lexoria.sources.shared import checkpoints

from .bounds import small
from .lexical import lexical_matches, tokenised
from .postings import PostingsIndex
from .vector_index import VectorIndex

RRF_K = 60
#: Questions in one batch at most; larger batches are to be split.
BATCH = 1_024
#: Sections in the scopes of one batch at most; they are broadcast.
MOST_SCOPE = 262_144


def _collected(questions: DataFrame) -> list[tuple[int, str]]:
    rows = questions.select("query_id", "query_text").limit(BATCH + 1).collect()
    if len(rows) > BATCH:
        raise ValueError(f"more than {BATCH} questions in a batch")
    return [(r.query_id, r.query_text) for r in rows]


def _asked(values: str, column: Column) -> Column:
    return (F.size(values) == 0) | F.array_contains(F.col(values), column)


def _filters() -> Column:
    doc_type, module = F.coalesce("doc_type", F.lit("")), F.coalesce("module", F.lit(""))
    return _asked("doc_types", doc_type) & (_asked("modules", module) | (module == ""))


def scope_of_sections(sections: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, section_id): the asked sections and those next to them in the same document."""
    asked = small(questions.select("query_id", F.explode("section_ids").alias("id")), MOST_SCOPE, "sections in a batch")
    seeds = sections.select("id", "document_id", "section_index").join(asked, "id")
    near = seeds.select("query_id", "document_id", F.explode(F.array(*[F.col("section_index") + i for i in (-1, 0, 1)])).alias("section_index"))
    places = sections.select("document_id", "section_index", F.col("id").alias("section_id"))
    checkpoints(sections.sparkSession)
    return places.join(F.broadcast(near), ["document_id", "section_index"]).select("query_id", "section_id").distinct().checkpoint()


def base_rows(corpus: DataFrame, questions: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Corpus rows that pass each question's filters, with ``similarity``. A row without a module
    passes every module filter. A question without a vector has null similarities."""
    _collected(questions)  # holds the batch to its bound
    passes = _filters()
    asked = F.broadcast(questions.select("query_id", "doc_types", "modules", "section_ids", "query_embedding", norm(F.col("query_embedding")).alias("_asked_norm")))
    once = corpus.withColumn("_norm", F.explode(F.array(norm(F.col("embedding")))))  # a norm a row, not a pair
    rows = _scoped(once.join(asked, passes), scope)
    similarity = dot(F.col("embedding"), F.col("query_embedding")) / F.nullif(F.col("_norm") * F.col("_asked_norm"), F.lit(0.0))
    return rows.withColumn("similarity", similarity).drop("embedding", "query_embedding", "doc_types", "modules", "section_ids", "_norm", "_asked_norm")


def lexical_rows(corpus: DataFrame, questions: DataFrame, scope: DataFrame | None = None, carry: tuple[str, ...] = ("document_id", "chunk_index")) -> DataFrame:
    """(query_id, id, *carry, lexical_score) of the corpus rows that pass each question's filters and
    match its text. Tokens are made once a corpus row, before the questions are joined."""
    asked = F.broadcast(questions.select("query_id", "doc_types", "modules", "section_ids"))
    extra = ["section_id"] if scope is not None else []
    narrow = tokenised(corpus).select("id", *carry, *(c for c in extra if c not in carry), "doc_type", "module", "_tokens", "_n")
    rows = _scoped(narrow.join(asked, _filters()), scope)
    return lexical_matches(rows, _collected(questions)).select("query_id", "id", *carry, "lexical_score")


def _scoped(rows: DataFrame, scope: DataFrame | None) -> DataFrame:
    """Rows in the scope of their question; the scope is broadcast, as rows carry texts and vectors."""
    if scope is not None:
        scope = small(scope, MOST_SCOPE, "sections in the scopes of a batch")
        free = rows.filter(F.size("section_ids") == 0)
        rows = free.unionByName(rows.filter(F.size("section_ids") > 0).join(scope, ["query_id", "section_id"], "left_semi").select(*free.columns))
    return rows


def top(rows: DataFrame, rank: str, order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def fuse(vector: DataFrame, lexical: DataFrame, weights: tuple[float, float], carry: tuple[str, ...] = ("document_id", "chunk_index")) -> DataFrame:
    """Reciprocal rank fusion: (query_id, id, *carry, fusion_score, vector_similarity, lexical_score,
    origin). ``carry`` are columns that follow from the id."""
    keys = ["query_id", "id", *carry]
    v = vector.select(*keys, "vector_rank", F.col("similarity").alias("vector_similarity"))
    t = lexical.select(*keys, "lexical_rank", "lexical_score")
    both = v.join(t, keys, "full_outer")
    part = lambda w, r: F.coalesce(F.lit(w) / (F.lit(float(RRF_K)) + F.col(r)), F.lit(0.0))
    origin = F.when(F.col("vector_rank").isNotNull() & F.col("lexical_rank").isNotNull(), "hybrid").when(F.col("lexical_rank").isNotNull(), "lexical").otherwise("vector")
    return both.withColumn("fusion_score", part(weights[0], "vector_rank") + part(weights[1], "lexical_rank")).withColumn("origin", origin)


def _fused_order() -> list[Column]:
    return [F.col("fusion_score").desc(), F.coalesce("vector_similarity", F.lit(-1.0)).desc(), F.col("id")]


def expand(seeds: DataFrame, chunks: DataFrame, questions: DataFrame, match_count: int, scope: DataFrame | None = None) -> DataFrame:
    """Seeds with the chunks next to them: one row a chunk (a seed stays a seed, else the best seed
    wins), at most 3 * match_count a question, seeds followed by their neighbours. seeds:
    (query_id, id, document_id, chunk_index, retrieval_rank, ...).

    At most 3 * match_count * BATCH wanted places are broadcast and probed by one more scan of the
    chunks; similarities are computed for what is found only."""
    around = seeds.withColumnRenamed("id", "seed_chunk_id").withColumn("_at", F.col("chunk_index")).withColumn("chunk_index", F.explode(F.array(*[F.col("chunk_index") + i for i in (-1, 0, 1)])))
    found = chunks.join(F.broadcast(around), ["document_id", "chunk_index"])
    named = questions.select(F.col("query_id").alias("_q"), "doc_types", "modules", "section_ids", "query_embedding")
    passes = (F.col("query_id") == F.col("_q")) & _filters()
    rows = _scoped(found.join(F.broadcast(named), passes), scope).withColumn("similarity", cosine_similarity(F.col("embedding"), F.col("query_embedding")))
    rows = rows.drop("embedding", "query_embedding", "doc_types", "modules", "section_ids", "_q")
    rows = rows.withColumn("is_neighbor", F.col("id") != F.col("seed_chunk_id")).withColumn("neighbor_distance", F.abs(F.col("chunk_index") - F.col("_at")))
    choice = Window.partitionBy("query_id", "id").orderBy("is_neighbor", "retrieval_rank", "neighbor_distance", "seed_chunk_id")
    once = rows.withColumn("_choice", F.row_number().over(choice)).filter("_choice = 1")
    order = [F.col(c) for c in ("retrieval_rank", "is_neighbor", "neighbor_distance", "chunk_index", "id")]
    return top(once, "position", order, 3 * match_count).drop("_choice", "_at")


def match_chunks(chunks: DataFrame, questions: DataFrame, match_count: int = 8, threshold: float = 0.55, fetch_limit: int = 80, scope: DataFrame | None = None) -> DataFrame:
    """Vector search with neighbours. ``similarity`` is every row's own."""
    base = base_rows(chunks, questions, scope)
    near = base.filter(F.col("similarity") >= threshold)
    seeds = top(near, "retrieval_rank", [F.col("similarity").desc(), F.col("id")], match_count).select("query_id", "id", "document_id", "chunk_index", "retrieval_rank")
    out = expand(seeds, chunks, questions, match_count, scope)
    return out.withColumn("lexical_score", F.lit(None).cast("double")).withColumn("fusion_score", F.lit(None).cast("double")).withColumn("origin", F.when(F.col("is_neighbor"), "neighbor").otherwise("vector"))


def hybrid_match_chunks(chunks: DataFrame, questions: DataFrame, match_count: int = 8, threshold: float = 0.55, weights: tuple[float, float] = (0.6, 0.4), fetch_limit: int = 80, scope: DataFrame | None = None, floor: float = 0.7) -> DataFrame:
    """Vector and lexical search fused by rank, then neighbours. Lexical and fusion scores are null
    on neighbours; fused rows have no similarity floor."""
    base, fetch = base_rows(chunks, questions, scope), max(fetch_limit, match_count)
    vector = top(base.filter(F.col("similarity") >= threshold * floor), "vector_rank", [F.col("similarity").desc(), F.col("id")], fetch)
    lexical = top(lexical_rows(chunks, questions, scope), "lexical_rank", [F.col("lexical_score").desc(), F.col("id")], fetch)
    return _fused_search(vector, lexical, chunks, questions, match_count, weights, scope)


def _fused_search(vector: DataFrame, lexical: DataFrame, chunks: DataFrame, questions: DataFrame, match_count: int, weights: tuple[float, float], scope: DataFrame | None) -> DataFrame:
    seeds = top(fuse(vector, lexical, weights), "retrieval_rank", _fused_order(), match_count).select("query_id", "id", "document_id", "chunk_index", "retrieval_rank", "lexical_score", "fusion_score", "origin")
    out = expand(seeds, chunks, questions, match_count, scope)
    mine = lambda c: F.when(~F.col("is_neighbor"), F.col(c))
    return out.withColumn("lexical_score", mine("lexical_score")).withColumn("fusion_score", mine("fusion_score")).withColumn("origin", F.when(F.col("is_neighbor"), "neighbor").otherwise(F.col("origin")))


def hybrid_match_indexed(vectors: VectorIndex, texts: PostingsIndex, chunks: DataFrame, questions: DataFrame, match_count: int = 8, threshold: float = 0.55, weights: tuple[float, float] = (0.6, 0.4), fetch_limit: int = 80, floor: float = 0.7, exact: bool = True, probes: int = 8) -> DataFrame:
    """hybrid_match_chunks over stored indexes of the chunks: only the probed lists of vectors and the
    asked lexemes' postings are read, and lexical scores are cover densities. The vector index has the
    columns of the chunks but content; the postings carry document_id, chunk_index, doc_type, module.
    Neighbours are looked up in ``chunks`` by the broadcast seeds."""
    fetch = max(fetch_limit, match_count)
    vector = vectors.search(questions, fetch, probes, exact, threshold * floor).withColumnRenamed("rank", "vector_rank")
    lexical = texts.search(questions, _filters(), fetch)
    return _fused_search(vector, lexical, chunks, questions, match_count, weights, None)


def hybrid_match_sections(sections: DataFrame, questions: DataFrame, match_count: int = 12, threshold: float = 0.55, weights: tuple[float, float] = (0.65, 0.35), fetch_limit: int = 48) -> DataFrame:
    """Fused search over sections, without neighbours. A section without a vector has similarity 0."""
    base, fetch = base_rows(sections, questions), max(fetch_limit, match_count)
    vector = top(base.filter(F.col("similarity") >= threshold * 0.65), "vector_rank", [F.col("similarity").desc(), F.col("id")], fetch)
    lexical = top(lexical_rows(sections, questions, None, ()), "lexical_rank", [F.col("lexical_score").desc(), F.col("id")], fetch)
    seeds = top(fuse(vector, lexical, weights, ()), "retrieval_rank", _fused_order(), match_count)
    # At most match_count * BATCH seeds look up their sections; similarities are made for these only.
    asked = questions.select("query_id", "query_embedding")
    found = sections.join(F.broadcast(seeds.join(asked, "query_id")), "id")
    own = F.coalesce(cosine_similarity(F.col("embedding"), F.col("query_embedding")), F.lit(0.0)).alias("similarity")
    return found.select(*[c for c in seeds.columns if c != "vector_similarity"], "document_id", "section_index", "module", "doc_type", "filename", own)


def match_chunks_v1(chunks: DataFrame, questions: DataFrame, match_count: int = 8, threshold: float = 0.55, fetch_limit: int = 80) -> DataFrame:
    """The older form: a neighbour gets 0.9 of its best adjacent seed's similarity; the best row of
    each chunk stays; at most 2 * match_count by similarity."""
    base = base_rows(chunks, questions)
    near = base.filter(F.col("similarity") >= threshold)
    seeds = top(near, "retrieval_rank", [F.col("similarity").desc(), F.col("id")], match_count)
    return _inherit(seeds.withColumn("score", F.col("similarity")), base, match_count)


def _inherit(seeds: DataFrame, base: DataFrame, match_count: int) -> DataFrame:
    around = seeds.select("query_id", "document_id", F.col("score").alias("_s"), F.explode(F.array(F.col("chunk_index") - 1, F.col("chunk_index") + 1)).alias("chunk_index"))
    near = around.filter("chunk_index >= 0").groupBy("query_id", "document_id", "chunk_index").agg((F.max("_s") * 0.9).alias("score"))
    cols = ["query_id", "id", "document_id", "chunk_index"]
    rows = seeds.select(*cols, "score").unionByName(base.join(near, ["query_id", "document_id", "chunk_index"]).select(*cols, "score"))
    best = rows.groupBy(*cols).agg(F.max("score").alias("similarity"))
    return top(best, "position", [F.col("similarity").desc(), F.col("id")], 2 * match_count)


def hybrid_match_chunks_v1(chunks: DataFrame, questions: DataFrame, match_count: int = 8, threshold: float = 0.55, weights: tuple[float, float] = (0.6, 0.4), fetch_limit: int = 30) -> DataFrame:
    """The older hybrid: fused rows stay only with half the threshold's similarity or in both lists;
    neighbours inherit as in match_chunks_v1."""
    base = base_rows(chunks, questions)
    vector = top(base, "vector_rank", [F.col("similarity").desc(), F.col("id")], fetch_limit)
    lexical = top(lexical_rows(chunks, questions), "lexical_rank", [F.col("lexical_score").desc(), F.col("id")], fetch_limit)
    fused = fuse(vector, lexical, weights).filter((F.coalesce("vector_similarity", F.lit(0.0)) >= 0.5 * threshold) | (F.col("origin") == "hybrid"))
    seeds = top(fused, "retrieval_rank", _fused_order(), match_count).select("query_id", "id", "document_id", "chunk_index", F.coalesce("vector_similarity", F.lit(0.0)).alias("score"))
    return _inherit(seeds, base, match_count)


def search_feedback(feedback: DataFrame, questions: DataFrame, match_count: int = 6, threshold: float = 0.58, exact_scope: bool = False) -> DataFrame:
    """Published, active feedback in a question's scope, nearest first. feedback: (id, item_id,
    status, active, scope map, embedding); questions: (query_id, query_embedding, scope map). A scope
    key that a question leaves out is ignored, unless the whole scopes must be equal; a missing
    level is global and other missing keys are empty."""
    asked = small(questions.select("query_id", "query_embedding", F.col("scope").alias("asked")), BATCH, "questions in a batch")
    live = feedback.filter((F.col("status") == "PUBLISHED") & F.col("active"))
    if exact_scope:
        entries = lambda c: F.array_sort(F.map_entries(c))
        fits = entries("scope") == entries("asked")
    else:
        fits = F.forall(F.map_entries("asked"), lambda e: F.coalesce(F.element_at("scope", e["key"]), F.when(e["key"] == "level", "global").otherwise("")) == e["value"])
    rows = live.join(asked, fits).withColumn("similarity", cosine_similarity(F.col("embedding"), F.col("query_embedding"))).filter(F.col("similarity") >= threshold)
    return top(rows, "position", [F.col("similarity").desc(), F.col("id")], max(1, min(match_count, 50))).drop("embedding", "query_embedding", "asked")


def postprocess(rows: DataFrame, max_results: int, threshold: float, floor: float = 0.7, max_candidates: int | None = None, ranked: bool = False) -> DataFrame:
    """Search results cut to ``max_candidates`` (twice ``max_results`` by default). With ``ranked`` a
    question that has a retrieval rank keeps its rows in their position; else rows stay from
    threshold * floor on, by falling similarity. rows: (query_id, position, similarity,
    retrieval_rank, ...)."""
    most = max(1, max_candidates or 2 * max_results)
    known = F.max(F.col("retrieval_rank").isNotNull()).over(Window.partitionBy("query_id")) if ranked else F.lit(False)
    value = F.when(F.isnan("similarity"), None).otherwise(F.col("similarity"))
    near = rows.withColumn("_ranked", known).withColumn("_value", F.coalesce(value, F.lit(0.0))).filter(F.col("_ranked") | (F.col("_value") >= threshold * floor))
    order = [F.when(F.col("_ranked"), F.lit(0.0)).otherwise(-F.col("_value")), F.col("position")]
    return top(near, "place", order, most).drop("_ranked", "_value")


def search_filters(plan: DataFrame, use_doc_types: bool = True, use_modules: bool = True) -> DataFrame:
    """A question plan (query_id, doc_types, modules) with lower-cased, trimmed, distinct filters;
    an empty one asks for all."""
    clean = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    none = F.array().cast("array<string>")
    return plan.select("query_id", (clean("doc_types") if use_doc_types else none).alias("doc_types"), (clean("modules") if use_modules else none).alias("modules"))
