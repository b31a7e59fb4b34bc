"""Queries over ranked candidates and context packing, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexoria.operators import context, inventory, postrank, retrieval
from lexoria.sources import corpus

from .q_retrieval import THRESHOLD, base_sql, corpus_sql, hybrid_rows_sql

OPERATIONAL = "como|erro|configur|token|die"


def candidates(spark: SparkSession, sf_dir: str, k: int = 40) -> DataFrame:
    """The k nearest chunks of each question: the input of these queries."""
    base = retrieval.base_rows(corpus.chunks(spark, sf_dir), corpus.questions(spark, sf_dir))
    return retrieval.top(base, "position", [F.col("similarity").desc(), F.col("id")], k)


def _cand(k: int = 40) -> str:
    return f"{corpus_sql()}, {base_sql()}, cand AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS position FROM base QUALIFY position <= {k})"


def dedupe(spark, sf_dir):
    c = candidates(spark, sf_dir)
    again = c.filter("position <= 10").withColumn("position", F.col("position") + 100)
    return postrank.dedupe_chunks(c.unionByName(again), ["position", "id"]).select("query_id", "id", "position")


def diversity(spark, sf_dir):
    return postrank.limit_diversity(candidates(spark, sf_dir, 80), per_section=1, per_document=2, limit=15).select("query_id", "id", "position", "section_id", "document_id")


def diversity_defaults(spark, sf_dir):
    return postrank.limit_diversity(candidates(spark, sf_dir, 80)).select("query_id", "id", "position")


def section_ids(spark, sf_dir):
    return postrank.ordered_distinct(candidates(spark, sf_dir), "section_id", "position", 5)


def interleaved(spark, sf_dir):
    c = candidates(spark, sf_dir)
    out = postrank.interleave(c.filter("position % 3 <> 0 AND position <= 20"), c.filter("position % 3 = 0 AND position <= 30"))
    return out.select("query_id", "id", "position", F.col("slot").cast("long").alias("slot"))


def rerank_trigger(spark, sf_dir):
    return postrank.should_rerank(candidates(spark, sf_dir, 6).filter("position >= query_id"), low=0.3, high=0.9)


def reranked(spark, sf_dir):
    c = candidates(spark, sf_dir)
    labels = corpus.table(spark, sf_dir, "labels")
    scores = c.join(labels, c.id == labels.doc_id).select("query_id", "id", (F.col("quality") + 1 - F.col("toxic")).cast("double").alias("score"))
    return postrank.rerank(c, scores).select("query_id", "id", "position", "score", "new_position")


def abstain(spark, sf_dir):
    c = candidates(spark, sf_dir, 5).filter("query_id <> 2 AND (query_id <> 3 OR position = 1)").withColumn("similarity", F.when(F.col("query_id") == 4, F.lit(0.64)).otherwise(F.col("similarity") * F.when(F.col("query_id") == 5, 0.5).otherwise(1.0)))
    return postrank.abstain_reasons(corpus.questions(spark, sf_dir), c, operational=OPERATIONAL)


def trace(spark, sf_dir):
    out = retrieval.hybrid_match_chunks(corpus.chunks(spark, sf_dir), corpus.questions(spark, sf_dir), 8, THRESHOLD)
    s = postrank.trace_summary(out)
    return s.withColumns({c: F.round(c, 6) for c in ("max_similarity", "max_lexical", "max_fusion")})


def history(spark, sf_dir):
    kept = context.select_history(corpus.table(spark, sf_dir, "conversations"), 300)
    return kept.select("conv_id", "turn", "role", "tokens")


def last_turns(spark, sf_dir):
    return context.last_messages(corpus.table(spark, sf_dir, "conversations"), 1).select("conv_id", "turn", "role")


def packing(spark, sf_dir):
    return context.select_context(candidates(spark, sf_dir), 4_000).select("query_id", "id", "position", "tokens")


def blocks(spark, sf_dir):
    return context.consecutive_blocks(candidates(spark, sf_dir, 80))


def entities(spark, sf_dir):
    c = candidates(spark, sf_dir, 12)
    found = c.select("query_id", F.lit("words").alias("label"), F.col("position").cast("int").alias("chunk_place"), F.posexplode(F.regexp_extract_all("content", F.lit(r" ?[A-ZÀ-Ý]?[a-zà-ÿ]{3,} ?|[-.]"), F.lit(0))).alias("value_place", "value"))
    return context.merge_entities(found, 12).select("query_id", "value", "place")


def scope_counts(spark, sf_dir):
    c = candidates(spark, sf_dir, 20).withColumn("routing_scope", F.when(F.col("module") == "", None).when(F.col("module") < "5", "preferred").otherwise("global"))
    return inventory.scope_counts(c)


_GREEDY = """RECURSIVE {head}, r AS (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY {order}) AS i FROM items),
walk AS (SELECT {g}, i, tokens <= {budget} AS kept, CASE WHEN tokens <= {budget} THEN tokens ELSE 0 END AS used FROM r WHERE i = 1
  UNION ALL SELECT r.{g}, r.i, w.used + r.tokens <= {budget}, CASE WHEN w.used + r.tokens <= {budget} THEN w.used + r.tokens ELSE w.used END FROM walk w JOIN r ON r.{g} = w.{g} AND r.i = w.i + 1)"""

QUERIES = {
    "dedupe_chunks": dedupe,
    "limit_chunk_diversity": diversity,
    "limit_chunk_diversity_defaults": diversity_defaults,
    "section_ids_from_hits": section_ids,
    "interleave_routing_scopes": interleaved,
    "should_rerank": rerank_trigger,
    "rerank_order": reranked,
    "strict_abstain_reason": abstain,
    "chunk_trace_summary": trace,
    "routing_scope_counts": scope_counts,
    "select_history": history,
    "conversation_trim": last_turns,
    "select_context": packing,
    "consecutive_chunk_blocks": blocks,
    "merge_chunk_entities": entities,
}

ORACLES = {
    "chunk_trace_summary": hybrid_rows_sql(THRESHOLD) + """ SELECT query_id, count(*) AS n, round(max(similarity), 6) AS max_similarity, round(max(lexical_score), 6) AS max_lexical, round(max(fusion_score), 6) AS max_fusion, array_to_string(list_sort(list(DISTINCT origin)), ',') AS origins,
count(DISTINCT document_id) AS documents, count(DISTINCT document_id * 10 + chunk_index // 2) AS sections, count(*) FILTER (is_neighbor) AS neighbors FROM ranked GROUP BY query_id""",
    "dedupe_chunks": f"WITH {_cand()}, k AS (SELECT *, sha256(regexp_replace(content, '\\r\\n?', chr(10), 'g')) || '|' || chunk_index || '|' || content AS key FROM cand) SELECT query_id, id, position FROM k QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY position, id) = 1",
    "limit_chunk_diversity_defaults": f"""WITH {_cand(80)}, s AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY query_id, section_id ORDER BY position) <= 3) SELECT query_id, id, position FROM s QUALIFY row_number() OVER (PARTITION BY query_id, document_id ORDER BY position) <= 6""",
    "limit_chunk_diversity": f"""WITH {_cand(80)}, s AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY query_id, section_id ORDER BY position) <= 1), d AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id, document_id ORDER BY position) <= 2)
SELECT query_id, id, position, section_id, document_id FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY position) <= 15""",
    "section_ids_from_hits": f"WITH {_cand()}, f AS (SELECT query_id, section_id, min(position) AS p FROM cand GROUP BY ALL) SELECT query_id, section_id, row_number() OVER (PARTITION BY query_id ORDER BY p, section_id)::INTEGER AS place FROM f QUALIFY place <= 5",
    "interleave_routing_scopes": f"""WITH {_cand()}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) AS k FROM cand WHERE position % 3 <> 0 AND position <= 20), c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) AS k FROM cand WHERE position % 3 = 0 AND position <= 30),
s AS (SELECT query_id, id, position, CASE WHEN k % 2 = 1 THEN 3 * (k // 2) + 1 ELSE 3 * (k // 2) - 1 END AS want, 0 AS side, k FROM p UNION ALL SELECT query_id, id, position, 3 * k, 1, k FROM c)
SELECT query_id, id, position, row_number() OVER (PARTITION BY query_id ORDER BY want, side, k)::BIGINT AS slot FROM s""",
    "should_rerank": f"WITH {_cand(6)}, c AS (SELECT * FROM cand WHERE position >= query_id) SELECT query_id, count(*) > 2 AND arg_min(similarity, position) BETWEEN 0.3 AND 0.9 AND (count(DISTINCT document_id) > 1 OR count(DISTINCT section_id) > 1 OR count(*) >= 4) AS rerank FROM c GROUP BY query_id",
    "rerank_order": f"""WITH {_cand()}, s AS (SELECT c.query_id, c.id, c.position, (l.quality + 1 - l.toxic)::DOUBLE AS score FROM cand c LEFT JOIN labels l ON l.doc_id = c.id)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN position <= 20 AND score IS NOT NULL THEN 0 WHEN position <= 20 THEN 1 ELSE 2 END, CASE WHEN position <= 20 THEN score END DESC NULLS LAST, position)::INTEGER AS new_position FROM s""",
    "strict_abstain_reason": f"""WITH {_cand(5)}, c AS (SELECT query_id, count(*) AS n, max(CASE query_id WHEN 4 THEN 0.64 WHEN 5 THEN similarity * 0.5 ELSE similarity END) AS best FROM cand WHERE query_id <> 2 AND (query_id <> 3 OR position = 1) GROUP BY query_id)
SELECT q.query_id, CASE WHEN coalesce(n, 0) = 0 THEN 'no_chunks' WHEN n < 2 THEN 'few_chunks' WHEN best < 0.62 THEN 'low_similarity' WHEN regexp_matches(lower(q.query_text), '{OPERATIONAL}') AND best < 0.67 THEN 'low_similarity_operational' END AS reason FROM questions q LEFT JOIN c USING (query_id)""",
    "routing_scope_counts": f"WITH {_cand(20)} SELECT query_id, CASE WHEN module < '5' THEN 'preferred' ELSE 'global' END AS routing_scope, count(*) AS n FROM cand WHERE module <> '' GROUP BY ALL",
    "select_history": "WITH " + _GREEDY.format(head="items AS (SELECT conv_id, turn, role, ceil(strlen(text) / 2.0)::BIGINT + 4 AS tokens FROM conversations)", g="conv_id", order="turn DESC", budget=300) + " SELECT r.conv_id, r.turn, r.role, r.tokens FROM r JOIN walk w ON w.conv_id = r.conv_id AND w.i = r.i WHERE w.kept",
    "conversation_trim": "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2",
    "select_context": "WITH " + _GREEDY.format(head=_cand() + ", items AS (SELECT query_id, id, position, ceil(strlen(content) / 2.0)::BIGINT + 4 AS tokens FROM cand)", g="query_id", order="position", budget=4000) + " SELECT r.query_id, r.id, r.position, r.tokens FROM r JOIN walk w ON w.query_id = r.query_id AND w.i = r.i WHERE w.kept QUALIFY row_number() OVER (PARTITION BY r.query_id ORDER BY r.position) <= 8",
    "consecutive_chunk_blocks": f"""WITH {_cand(80)}, g AS (SELECT query_id, document_id, section_id, chunk_index, chunk_index - row_number() OVER (PARTITION BY query_id, document_id, section_id ORDER BY chunk_index) AS island FROM cand),
b AS (SELECT query_id, document_id, section_id, island, min(chunk_index) AS first_index, max(chunk_index) AS last_index, count(*) AS n FROM g GROUP BY ALL)
SELECT query_id, document_id, section_id, row_number() OVER (PARTITION BY query_id, document_id, section_id ORDER BY first_index)::BIGINT AS block, first_index, last_index, n FROM b""",
    "merge_chunk_entities": f"""WITH {_cand(12)}, e AS (SELECT query_id, position AS c, unnest(x) AS value, unnest(range(0, len(x))) AS v FROM (SELECT query_id, position, regexp_extract_all(content, ' ?[A-ZÀ-Ý]?[a-zà-ÿ]{{3,}} ?|[-.]') AS x FROM cand)),
n AS (SELECT query_id, c, v, trim(value) AS value FROM e WHERE value NOT IN ('-', '.') QUALIFY row_number() OVER (PARTITION BY query_id, trim(regexp_replace(translate(lower(value), 'áàâãäåçéèêëíìîïñóòôõöúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', ' ', 'g')) ORDER BY c, v) = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c, v) AS a, row_number() OVER (PARTITION BY query_id, c ORDER BY v) AS i FROM n)
SELECT query_id, value, row_number() OVER (PARTITION BY query_id ORDER BY c, v)::INTEGER AS place FROM k WHERE a <= 12 OR i = 1""",
}
