"""Retrieval queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexoria.operators import lexical, retrieval
from lexoria.sources import corpus

THRESHOLD = 0.05


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


def corpus_sql(rows: list | None = None) -> str:
    """CTEs chunks, sections, questions and base (rows that pass a question's filters)."""
    asked = ", ".join(f"({q}, {v}, '{t}', {_list(d)}, {_list(m)})" for q, v, t, d, m in rows or corpus.QUESTIONS)
    return f"""chunks AS MATERIALIZED (SELECT e.vec_id AS id, e.vec_id // 5 AS document_id, (e.vec_id % 5)::INTEGER AS chunk_index, d.text AS content, d.lang AS doc_type, d.source AS filename,
  CASE WHEN e.label = 9 THEN '' ELSE e.label::VARCHAR END AS module, (e.vec_id // 5) * 10 + (e.vec_id % 5) // 2 AS section_id, ((e.vec_id % 5) // 2)::INTEGER AS section_index, e.embedding
  FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id),
sections AS MATERIALIZED (SELECT section_id AS id, document_id, section_index, content, doc_type, filename, module, embedding, n_chunks FROM
  (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY chunk_index) AS nth, count(*) OVER (PARTITION BY section_id) AS n_chunks FROM chunks) WHERE nth = 1),
questions AS (SELECT q.*, e.embedding AS query_embedding FROM (VALUES {asked}) q(query_id, vec_id, query_text, doc_types, modules) JOIN embeddings e USING (vec_id))"""


def base_sql(relation: str = "chunks", name: str = "base") -> str:
    return f"""{name} AS MATERIALIZED (SELECT q.query_id, c.* EXCLUDE (embedding), list_cosine_similarity(c.embedding::DOUBLE[], q.query_embedding::DOUBLE[]) AS similarity FROM {relation} c JOIN questions q
  ON (len(q.doc_types) = 0 OR list_contains(q.doc_types, coalesce(c.doc_type, ''))) AND (len(q.modules) = 0 OR list_contains(q.modules, coalesce(c.module, '')) OR coalesce(c.module, '') = ''))"""


def vector_sql(threshold: float, fetch: int, base: str = "base") -> str:
    return f"""vec AS (SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS r FROM {base} WHERE similarity >= {threshold} QUALIFY r <= {fetch})"""


def lexical_sql(fetch: int, base: str = "base", rows: list | None = None) -> str:
    """One predicate and score for each question of the batch, from the same parsed form."""
    hit, score = [], []
    for q, _, text, _, _ in rows or corpus.QUESTIONS:
        parsed = lexical.parse_query(text)
        if not parsed:
            continue
        like = lambda t: f"contains(tk, ' {'  '.join(t.split())} ')"
        hit.append(f"WHEN query_id = {q} THEN " + " OR ".join("(" + " AND ".join(("" if w else "NOT ") + like(t) for w, t in g) + ")" for g in parsed))
        terms = sorted({t for g in parsed for w, t in g if w})
        count = lambda t: f"(length(tk) - length(replace(tk, ' {'  '.join(t.split())} ', ''))) / {len(t.split()) - 1 + len(t) + 2}.0"
        score.append(f"WHEN query_id = {q} THEN (" + " + ".join(map(count, terms)) + ")::DOUBLE / (1 + ln(n::DOUBLE))")
    return f"""once AS MATERIALIZED (SELECT id, len(w) AS n, ' ' || array_to_string(w, '  ') || ' ' AS tk FROM (SELECT id, regexp_extract_all(translate(lower(any_value(content)), 'áàâãäåçéèêëíìîïñóòôõöúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[a-z0-9]+') AS w FROM {base} GROUP BY id)),
tok AS (SELECT b.query_id, b.id, o.n, o.tk FROM {base} b JOIN once o ON o.id = b.id),
lex AS (SELECT query_id, id, CASE {' '.join(score)} END AS lexical_score, row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC, id) AS r FROM tok WHERE CASE {' '.join(hit)} ELSE FALSE END QUALIFY r <= {fetch})"""


def fused_sql(a: float, b: float) -> str:
    return f"""fused AS (SELECT coalesce(v.query_id, l.query_id) AS query_id, coalesce(v.id, l.id) AS id, v.similarity AS vs, l.lexical_score,
  coalesce({a}::DOUBLE / (60 + v.r), 0) + coalesce({b}::DOUBLE / (60 + l.r), 0) AS fusion_score, CASE WHEN v.id IS NOT NULL AND l.id IS NOT NULL THEN 'hybrid' WHEN l.id IS NOT NULL THEN 'lexical' ELSE 'vector' END AS origin
  FROM vec v FULL OUTER JOIN lex l ON v.query_id = l.query_id AND v.id = l.id)"""


def expand_sql(match_count: int) -> str:
    """From seeds(query_id, id, retrieval_rank, lexical_score, fusion_score, origin)."""
    return f"""ex AS (SELECT s.query_id, b.id, b.document_id, b.chunk_index, b.similarity, s.retrieval_rank, s.id AS seed_chunk_id, b.id <> s.id AS is_neighbor, abs(b.chunk_index - o.chunk_index) AS neighbor_distance,
  CASE WHEN b.id = s.id THEN s.lexical_score END AS lexical_score, CASE WHEN b.id = s.id THEN s.fusion_score END AS fusion_score, CASE WHEN b.id = s.id THEN s.origin ELSE 'neighbor' END AS origin
  FROM seeds s JOIN base o ON o.query_id = s.query_id AND o.id = s.id JOIN base b ON b.query_id = s.query_id AND b.document_id = o.document_id AND b.chunk_index BETWEEN o.chunk_index - 1 AND o.chunk_index + 1),
one AS (SELECT * FROM ex QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY is_neighbor, retrieval_rank, neighbor_distance, seed_chunk_id) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY retrieval_rank, is_neighbor, neighbor_distance, chunk_index, id) AS position FROM one QUALIFY position <= {3 * match_count})
SELECT query_id, position::INTEGER AS position, id, document_id, chunk_index, round(similarity, 6) AS similarity, round(lexical_score, 6) AS lexical_score, round(fusion_score, 9) AS fusion_score, origin,
  retrieval_rank::INTEGER AS retrieval_rank, is_neighbor, seed_chunk_id FROM ranked"""


def shown(df: DataFrame) -> DataFrame:
    return df.select("query_id", "position", "id", "document_id", "chunk_index", F.round("similarity", 6).alias("similarity"), F.round("lexical_score", 6).alias("lexical_score"), F.round("fusion_score", 9).alias("fusion_score"), "origin", "retrieval_rank", "is_neighbor", "seed_chunk_id")


def match_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(retrieval.match_chunks(corpus.chunks(spark, sf_dir), corpus.questions(spark, sf_dir), 8, THRESHOLD))


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(retrieval.hybrid_match_chunks(corpus.chunks(spark, sf_dir), corpus.questions(spark, sf_dir), 8, THRESHOLD))


def hybrid_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the default threshold most seeds are lexical or vector only."""
    return shown(retrieval.hybrid_match_chunks(corpus.chunks(spark, sf_dir), corpus.questions(spark, sf_dir), 8, 0.55))


_SCOPED = {1: [0, 31], 3: [80]}


def _scoped_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.lit(None).cast("array<bigint>")
    for q, sections in _SCOPED.items():
        ids = F.when(F.col("query_id") == q, F.array(*[F.lit(s).cast("long") for s in sections])).otherwise(ids)
    return corpus.questions(spark, sf_dir).withColumn("section_ids", F.coalesce(ids, F.array().cast("array<bigint>")))


def scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _scoped_questions(spark, sf_dir)
    scope = retrieval.scope_of_sections(corpus.sections(spark, sf_dir), asked)
    return shown(retrieval.match_chunks(corpus.chunks(spark, sf_dir), asked, 8, -1.0, scope=scope))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retrieval.hybrid_match_sections(corpus.sections(spark, sf_dir), corpus.questions(spark, sf_dir), 12, THRESHOLD)
    return out.select("query_id", "id", "document_id", "section_index", "module", F.round("similarity", 6).alias("similarity"), F.round("lexical_score", 6).alias("lexical_score"), F.round("fusion_score", 9).alias("fusion_score"), "origin", "retrieval_rank")


def chunks_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retrieval.match_chunks_v1(corpus.chunks(spark, sf_dir), corpus.questions(spark, sf_dir), 8, THRESHOLD)
    return out.select("query_id", "position", "id", "document_id", "chunk_index", F.round("similarity", 6).alias("similarity"))


def hybrid_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retrieval.hybrid_match_chunks_v1(corpus.chunks(spark, sf_dir), corpus.questions(spark, sf_dir), 8, THRESHOLD)
    return out.select("query_id", "position", "id", "document_id", "chunk_index", F.round("similarity", 6).alias("similarity"))


def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = retrieval.base_rows(corpus.chunks(spark, sf_dir), corpus.questions(spark, sf_dir))
    return retrieval.top(base, "rank", [F.col("similarity").desc(), F.col("id")], 10).select("query_id", "rank", "id", F.round("similarity", 6).alias("similarity"))


def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus.table(spark, sf_dir, "embeddings")
    status = F.element_at(F.array(*[F.lit(s) for s in ("PUBLISHED", "PUBLISHED", "PENDING", "APPROVED")]), (F.col("vec_id") % 4 + 1).cast("int"))
    scope = F.when(F.col("label") < 5, F.create_map(F.lit("level"), F.lit("tenant"), F.lit("tenant"), F.col("label").cast("string"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    return e.select(F.col("vec_id").alias("id"), (F.col("vec_id") / 2).cast("long").alias("item_id"), status.alias("status"), (F.col("vec_id") % 7 != 0).alias("active"), scope.alias("scope"), "embedding")


_FEEDBACK_SQL = """fb AS (SELECT vec_id AS id, ['PUBLISHED','PUBLISHED','PENDING','APPROVED'][(vec_id % 4 + 1)::INTEGER] AS status, vec_id % 7 <> 0 AS active, CASE WHEN label < 5 THEN 'tenant' ELSE 'global' END AS level,
  CASE WHEN label < 5 THEN label::VARCHAR ELSE '' END AS tenant, embedding FROM embeddings)"""


def _scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = corpus.questions(spark, sf_dir)
    m = lambda **kv: F.create_map(*[F.lit(x) for p in kv.items() for x in p])
    scope = F.when(F.col("query_id") == 1, m(level="tenant", tenant="2")).when(F.col("query_id") == 2, m(level="global")).when(F.col("query_id") == 3, m(tenant="4"))
    return q.withColumn("scope", scope).filter("scope IS NOT NULL").select("query_id", "query_embedding", "scope")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retrieval.search_feedback(_feedback(spark, sf_dir), _scopes(spark, sf_dir), 6, -1.0)
    return out.select("query_id", "position", "id", F.round("similarity", 6).alias("similarity"))


def feedback_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retrieval.search_feedback(_feedback(spark, sf_dir), _scopes(spark, sf_dir), 6, -1.0, exact_scope=True)
    return out.select("query_id", "position", "id", F.round("similarity", 6).alias("similarity"))


def _feedback_sql(condition: str) -> str:
    return f"""WITH {corpus_sql()}, {_FEEDBACK_SQL}, s AS (SELECT q.query_id, fb.id, list_cosine_similarity(fb.embedding::DOUBLE[], q.query_embedding::DOUBLE[]) AS similarity FROM fb JOIN questions q ON {condition} WHERE status = 'PUBLISHED' AND active)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id)::INTEGER AS position, id, round(similarity, 6) AS similarity FROM s QUALIFY position <= 6"""


_INHERIT = """around AS (SELECT query_id, document_id, unnest([chunk_index - 1, chunk_index + 1]) AS chunk_index, score FROM seeds),
near AS (SELECT query_id, document_id, chunk_index, max(score) * 0.9 AS score FROM around WHERE chunk_index >= 0 GROUP BY ALL),
allrows AS (SELECT query_id, id, document_id, chunk_index, score FROM seeds UNION ALL SELECT b.query_id, b.id, b.document_id, b.chunk_index, n.score FROM base b JOIN near n USING (query_id, document_id, chunk_index)),
best AS (SELECT query_id, id, document_id, chunk_index, max(score) AS s FROM allrows GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id)::INTEGER AS position, id, document_id, chunk_index, round(s, 6) AS similarity FROM best QUALIFY position <= 16"""


def hybrid_rows_sql(threshold: float) -> str:
    """The CTEs of hybrid search, without the final select; ``ranked`` has the rows."""
    return _hybrid_sql(threshold).rpartition("\nSELECT")[0]


def _hybrid_sql(threshold: float) -> str:
    return f"""WITH {corpus_sql()}, {base_sql()}, {vector_sql(threshold * 0.7, 80)}, {lexical_sql(80)}, {fused_sql(0.6, 0.4)},
seeds AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, coalesce(vs, -1) DESC, id) AS retrieval_rank FROM fused QUALIFY retrieval_rank <= 8), {expand_sql(8)}"""


_VECTOR_SEEDS = "seeds AS (SELECT query_id, id, r AS retrieval_rank, NULL::DOUBLE AS lexical_score, NULL::DOUBLE AS fusion_score, 'vector' AS origin FROM vec)"

QUERIES = {
    "knn_cosine": knn,
    "match_chunks": match_chunks,
    "match_chunks_section_scope": scoped,
    "hybrid_match_chunks": hybrid,
    "hybrid_match_chunks_default_threshold": hybrid_high,
    "hybrid_match_sections": sections,
    "match_chunks_v1": chunks_v1,
    "hybrid_match_chunks_v1": hybrid_v1,
    "search_feedback_chunks": feedback,
    "search_feedback_chunks_scoped": feedback_exact,
}

ORACLES = {
    "knn_cosine": f"WITH {corpus_sql()}, {base_sql()} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id)::INTEGER AS rank, id, round(similarity, 6) AS similarity FROM base QUALIFY rank <= 10",
    "match_chunks": f"WITH {corpus_sql()}, {base_sql()}, {vector_sql(THRESHOLD, 8)}, {_VECTOR_SEEDS}, {expand_sql(8)}",
    "match_chunks_section_scope": f"""WITH {corpus_sql()}, {base_sql(name='open_base')}, asked(query_id, id) AS (VALUES (1, 0), (1, 31), (3, 80)),
scope AS (SELECT DISTINCT a.query_id, n.id AS section_id FROM asked a JOIN sections s ON s.id = a.id JOIN sections n ON n.document_id = s.document_id AND n.section_index BETWEEN s.section_index - 1 AND s.section_index + 1),
base AS (SELECT * FROM open_base b WHERE b.query_id NOT IN (1, 3) OR EXISTS (SELECT 1 FROM scope s WHERE s.query_id = b.query_id AND s.section_id = b.section_id)),
{vector_sql(-1.0, 8)}, {_VECTOR_SEEDS}, {expand_sql(8)}""",
    "hybrid_match_chunks": _hybrid_sql(THRESHOLD),
    "hybrid_match_chunks_default_threshold": _hybrid_sql(0.55),
    "hybrid_match_sections": f"""WITH {corpus_sql()}, {base_sql('sections')}, {vector_sql(THRESHOLD * 0.65, 48)}, {lexical_sql(48)}, {fused_sql(0.65, 0.35)},
seeds AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, coalesce(vs, -1) DESC, id) AS retrieval_rank FROM fused QUALIFY retrieval_rank <= 12)
SELECT s.query_id, s.id, b.document_id, b.section_index, b.module, round(coalesce(b.similarity, 0), 6) AS similarity, round(s.lexical_score, 6) AS lexical_score, round(s.fusion_score, 9) AS fusion_score, s.origin, s.retrieval_rank::INTEGER AS retrieval_rank
FROM seeds s JOIN base b ON b.query_id = s.query_id AND b.id = s.id""",
    "match_chunks_v1": f"WITH {corpus_sql()}, {base_sql()}, {vector_sql(THRESHOLD, 8)}, seeds AS (SELECT v.query_id, v.id, b.document_id, b.chunk_index, v.similarity AS score FROM vec v JOIN base b ON b.query_id = v.query_id AND b.id = v.id), {_INHERIT}",
    "hybrid_match_chunks_v1": f"""WITH {corpus_sql()}, {base_sql()}, {vector_sql(-2.0, 30)}, {lexical_sql(30)}, {fused_sql(0.6, 0.4)},
picked AS (SELECT * FROM fused WHERE coalesce(vs, 0) >= {0.5 * THRESHOLD} OR origin = 'hybrid' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, coalesce(vs, -1) DESC, id) <= 8),
seeds AS (SELECT p.query_id, p.id, b.document_id, b.chunk_index, coalesce(p.vs, 0) AS score FROM picked p JOIN base b ON b.query_id = p.query_id AND b.id = p.id), {_INHERIT}""",
    "search_feedback_chunks": _feedback_sql("(q.query_id = 1 AND level = 'tenant' AND tenant = '2') OR (q.query_id = 2 AND level = 'global') OR (q.query_id = 3 AND tenant = '4')"),
    "search_feedback_chunks_scoped": _feedback_sql("(q.query_id = 1 AND level = 'tenant' AND tenant = '2') OR (q.query_id = 2 AND FALSE)"),
}
