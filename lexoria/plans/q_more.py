"""Orchestration, publishing, claims and cost queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexoria.functions import text as tx
from lexoria.operators import claims, evaluation, inventory, orchestration, publishing, retrieval
from lexoria.sources import corpus

from .q_evaluation import GOOD_REFERENCES, good_references
from .q_postrank import _cand, candidates
from .q_retrieval import THRESHOLD, corpus_sql

t = corpus.table


def full_retrieval(spark, sf_dir):
    from .q_retrieval import _feedback, _scopes

    asked = corpus.questions(spark, sf_dir).join(_scopes(spark, sf_dir).select("query_id", "scope"), "query_id", "left")
    near = orchestration.search_memory(_feedback(spark, sf_dir), asked, 6, -1.0)  # at most 12 a question
    texts = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    texts = texts.join(F.broadcast(near.select("id").distinct()), "id", "left_semi")
    found = near.join(texts, "id", "left").withColumn("content", F.coalesce("content", F.lit("")))
    chunks = corpus.stored(corpus.chunks(spark, sf_dir), "chunks")
    sections = corpus.stored(corpus.sections(spark, sf_dir, chunks), "sections")
    out = orchestration.retrieve(chunks, sections, corpus.questions(spark, sf_dir), feedback=found, threshold=THRESHOLD)
    return out.select("query_id", "slot", "id", "origin", "routing_scope", F.round("similarity", 6).alias("similarity"))


def fallback(spark, sf_dir):
    """At a high threshold some questions have lexical hits only, some none at all."""
    chunks = corpus.stored(corpus.chunks(spark, sf_dir), "chunks")
    return orchestration.search_chunks(chunks, corpus.questions(spark, sf_dir), threshold=0.3).select("query_id", "id", "origin", "position")


def batching(spark, sf_dir):
    c = candidates(spark, sf_dir).select("query_id", "id", "position", tx.estimated_tokens(F.col("content")).alias("tokens"))
    return orchestration.batches(c, "query_id", "position", "tokens", 3_000)


_PRICES = [("a", "large", 0, 2.0, 0.5, 8.0, 0.0, 0.0, 0.0), ("a", "large-mini", 0, 0.4, 0.1, 1.6, 0.0, 0.0, 0.0), ("b", "pro", 200, 1.25, 0.3, 10.0, 2.5, 0.6, 15.0)]


def costs(spark, sf_dir):
    p = spark.createDataFrame(_PRICES, "provider string, known_model string, threshold int, input double, cached double, output double, long_input double, long_cached double, long_output double")
    e = t(spark, sf_dir, "events")
    name = F.element_at(F.array(*[F.lit(x) for x in ("Large-mini-2024", "large-x", "pro", "other")]), (F.col("event_id") % 4 + 1).cast("int"))
    calls = e.select(F.col("event_id").alias("call_id"), F.when(F.col("event_id") % 4 < 2, "a").otherwise("b").alias("provider"), name.alias("model"), F.when(F.col("event_id") % 11 != 0, F.col("user_id") * 3).alias("input_tokens"), F.col("user_id").alias("output_tokens"), F.when(F.col("event_id") % 3 == 0, F.col("user_id") % 7).alias("cached_tokens"), F.when(F.col("event_id") % 2 == 0, F.lit(2).cast("long")).alias("reasoning_tokens"))
    return orchestration.model_cost(calls, p).select("call_id", F.round("cost", 9).alias("cost"), "cost_status")


def prompt_parts(spark, sf_dir):
    return inventory.prompt_token_parts(t(spark, sf_dir, "conversations"))


def replacement(spark, sf_dir):
    c = corpus.chunks(spark, sf_dir).select("document_id", "id", "chunk_index", tx.content_hash(F.col("content")).alias("h"))
    new = c.filter("document_id % 5 = 0 AND chunk_index < 3").withColumn("h", F.lit("new"))
    return publishing.replace_documents(c, new)


def clones(spark, sf_dir):
    c = corpus.chunks(spark, sf_dir).select("document_id", "chunk_index", tx.content_hash(F.col("content")).alias("h"))
    m = c.select(F.col("document_id").alias("source_document_id")).distinct().withColumn("document_id", F.col("source_document_id") + 10_000_000)
    return publishing.clone_rows(c, m).select("id", "document_id", "source_document_id", "chunk_index", "h")


def promotion(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("canonical_id"), tx.content_hash(F.col("text")).alias("content_hash"))
    return publishing.promotion_plan(d.filter("canonical_id % 7 > 0"), d.filter("canonical_id % 5 > 0").withColumn("content_hash", F.when(F.col("canonical_id") % 3 == 0, "x").otherwise(F.col("content_hash"))))


def evidence(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("answer_id"), F.col("text").alias("context"))
    e = d.select("answer_id", F.col("answer_id").alias("evidence_id"), F.floor((F.col("answer_id") % 50 - 1) * F.length("context") / 48).cast("int").alias("start"), "context").withColumn("end", F.col("start") + 41)
    e = e.withColumn("sha256", F.when(F.col("answer_id") % 4 == 0, "no").otherwise(F.sha2(F.expr("substring(context, start + 1, end - start)"), 256))).drop("context")
    return claims.evidence_index(e, d.filter("answer_id % 9 > 0")).select("answer_id", "evidence_id", "valid", "problem")


def policy(spark, sf_dir):
    x = F.col("l_discount") * 10
    p = F.array(x, 1 - x)
    choice = F.when(F.col("l_linenumber") % 5 == 0, "no").when(x >= 0.5, "yes").otherwise("no")
    options = F.array(F.lit("yes"), F.lit("no"))
    return t(spark, sf_dir, "lineitem").select(claims.decision_problems(p, choice, options).alias("problem"), claims.apply_policy(p, choice).alias("applied")).groupBy("problem", "applied").agg(F.count("*").alias("n"))


def stage_metrics(spark, sf_dir):
    """Coverage at the stages of retrieval: candidate pool, after diversity, final context."""
    from lexoria.operators import postrank

    pool = candidates(spark, sf_dir, 40)
    stages = {"candidate_pool": pool, "post_diversity": postrank.limit_diversity(pool, per_section=1, per_document=1), "final_context": pool.filter("position <= 8")}
    refs = good_references(spark, sf_dir)
    out = None
    for name, rows in stages.items():
        got = rows.select(F.concat_ws("/", F.lit(name), "query_id").alias("case_id"), F.col("document_id").alias("doc"), F.col("position").alias("rank"))
        one = evaluation.first_matches(refs.select(F.concat_ws("/", F.lit(name), "query_id").alias("case_id"), "reference_id"), got, F.col("doc") == F.col("reference_id"))
        out = one if out is None else out.unionByName(one)
    return evaluation.coverage(out, (10, 20))


def sections_scope(spark, sf_dir):
    q = corpus.questions(spark, sf_dir).withColumn("section_ids", F.array(*[F.lit(i).cast("long") for i in (0, 31, 112)]))
    return retrieval.scope_of_sections(corpus.sections(spark, sf_dir), q)


QUERIES = {
    "retrieve_chunks_with_feedback": full_retrieval, "search_with_fallback": fallback, "greedy_batches": batching, "model_cost": costs, "prompt_token_parts": prompt_parts, "atomic_replace": replacement, "clone_prepared_rows": clones, "promotion_plan": promotion,
    "evidence_index": evidence, "decision_policy": policy, "stage_metrics": stage_metrics, "section_scope": sections_scope,
}

_HASH = "sha256(regexp_replace({0}, '\\r\\n?', chr(10), 'g'))"
ORACLES = {
    "greedy_batches": f"""WITH RECURSIVE {_cand()}, r AS (SELECT query_id, id, position, ceil(strlen(content) / 2.0)::BIGINT AS tokens, row_number() OVER (PARTITION BY query_id ORDER BY position) AS i, max(ceil(strlen(content) / 2.0)) OVER (PARTITION BY query_id) > 3000 AS over FROM cand),
w AS (SELECT query_id, i, tokens AS used, 1 AS batch FROM r WHERE i = 1 UNION ALL SELECT r.query_id, r.i, CASE WHEN w.used + r.tokens > 3000 THEN r.tokens ELSE w.used + r.tokens END, CASE WHEN w.used + r.tokens > 3000 THEN w.batch + 1 ELSE w.batch END FROM w JOIN r ON r.query_id = w.query_id AND r.i = w.i + 1)
SELECT r.query_id, r.id, r.position, r.tokens, CASE WHEN NOT over THEN w.batch END AS batch FROM r JOIN w ON w.query_id = r.query_id AND w.i = r.i""",
    "model_cost": """WITH c AS (SELECT event_id AS call_id, event_id % 4 AS m, CASE WHEN event_id % 11 <> 0 THEN user_id * 3 END AS i, user_id AS o, CASE WHEN event_id % 3 = 0 THEN user_id % 7 END AS k, CASE WHEN event_id % 2 = 0 THEN 2 END AS r FROM events),
x AS (SELECT *, i IS NOT NULL AND m < 3 AS ok, m = 2 AND i + coalesce(k, 0) > 200 AS long FROM c)
SELECT call_id, CASE WHEN ok THEN round((i * CASE m WHEN 0 THEN 0.4::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE CASE WHEN long THEN 2.5::DOUBLE ELSE 1.25::DOUBLE END END + coalesce(k, 0) * CASE m WHEN 0 THEN 0.1::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE CASE WHEN long THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END END
 + (o + coalesce(r, 0)) * CASE m WHEN 0 THEN 1.6::DOUBLE WHEN 1 THEN 8.0::DOUBLE ELSE CASE WHEN long THEN 15.0::DOUBLE ELSE 10.0::DOUBLE END END) / 1000000, 9) END AS cost,
CASE WHEN m = 3 THEN 'unknown_model' WHEN i IS NULL THEN 'usage_incomplete' WHEN k IS NOT NULL AND r IS NOT NULL THEN 'estimated' ELSE 'estimated_partial_breakdown' END AS cost_status FROM x""",
    "prompt_token_parts": "SELECT conv_id, sum(ceil(strlen(text) / 2.0) + 4)::BIGINT AS history_tokens, sum(CASE WHEN role = 'user' THEN ceil(strlen(text) / 2.0) ELSE 0 END)::BIGINT AS user_tokens, count(*) AS turns FROM conversations GROUP BY conv_id",
    "atomic_replace": f"WITH {corpus_sql()} SELECT document_id, id, chunk_index, CASE WHEN document_id % 5 = 0 THEN 'new' ELSE {_HASH.format('content')} END AS h FROM chunks WHERE document_id % 5 <> 0 OR chunk_index < 3 OR document_id NOT IN (SELECT document_id FROM chunks WHERE document_id % 5 = 0 AND chunk_index < 3)",
    "clone_prepared_rows": f"WITH {corpus_sql()} SELECT (document_id + 10000000) || '-' || chunk_index AS id, document_id + 10000000 AS document_id, document_id AS source_document_id, chunk_index, {_HASH.format('content')} AS h FROM chunks",
    "promotion_plan": f"""WITH d AS (SELECT doc_id, {_HASH.format('text')} AS h FROM documents) SELECT doc_id AS canonical_id, CASE WHEN doc_id % 5 = 0 THEN 'retire' WHEN doc_id % 7 = 0 THEN 'introduce' WHEN doc_id % 3 = 0 THEN 'replace' ELSE 'keep' END AS action FROM d WHERE doc_id % 7 > 0 OR doc_id % 5 > 0""",
    "evidence_index": """WITH e AS (SELECT doc_id AS answer_id, floor((doc_id % 50 - 1) * length(text) / 48.0)::INTEGER AS s, s + 41 AS e, length(text) AS n FROM documents),
p AS (SELECT answer_id, CASE WHEN answer_id % 9 = 0 THEN 'not_rendered' WHEN s < 0 OR e > n THEN 'span_out_of_range' WHEN answer_id % 4 = 0 THEN 'hash_mismatch' END AS problem FROM e) SELECT answer_id, answer_id AS evidence_id, problem IS NULL AS valid, problem FROM p""",
    "decision_policy": """WITH x AS (SELECT l_discount * 10 AS x, l_linenumber FROM lineitem), c AS (SELECT x, CASE WHEN l_linenumber % 5 = 0 THEN 'no' WHEN x >= 0.5 THEN 'yes' ELSE 'no' END AS choice FROM x)
SELECT CASE WHEN x < 0 OR x > 1 OR 1 - x < 0 THEN 'out_of_range' WHEN CASE WHEN x >= 1 - x THEN 'yes' ELSE 'no' END <> choice THEN 'choice_is_not_largest' END AS problem, CASE WHEN greatest(x, 1 - x) >= 0.6 AND abs(x - (1 - x)) >= 0.15 THEN choice ELSE 'inconclusive' END AS applied, count(*) AS n FROM c GROUP BY ALL""",
    "stage_metrics": f"""WITH {_cand(40)}, dv AS (SELECT * FROM (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY query_id, section_id ORDER BY position) <= 1) QUALIFY row_number() OVER (PARTITION BY query_id, document_id ORDER BY position) <= 1),
st AS (SELECT 'candidate_pool' AS stage, query_id, document_id, position FROM cand UNION ALL SELECT 'post_diversity', query_id, document_id, position FROM dv UNION ALL SELECT 'final_context', query_id, document_id, position FROM cand WHERE position <= 8),
m AS (SELECT g.stage || '/' || q.query_id AS case_id, r.reference_id, (SELECT min(position) FROM st WHERE st.stage = g.stage AND st.query_id = q.query_id AND st.document_id = r.reference_id) AS rank FROM questions q, ({GOOD_REFERENCES}) r, (SELECT DISTINCT stage FROM st) g)
SELECT case_id, count(*) AS n_references, round(count(*) FILTER (rank <= 10) / count(*), 4) AS recall_10, round(count(*) FILTER (rank <= 20) / count(*), 4) AS recall_20, round(sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) / count(*), 4) AS discounted_10 FROM m GROUP BY case_id""",
    "section_scope": f"WITH {corpus_sql()}, s AS (SELECT * FROM sections WHERE id IN (0, 31, 112)) SELECT DISTINCT q.query_id, n.id AS section_id FROM questions q, s JOIN sections n ON n.document_id = s.document_id AND n.section_index BETWEEN s.section_index - 1 AND s.section_index + 1",
}
