"""Evaluation queries over derived cases, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexoria.operators import evaluation as ev
from lexoria.operators import inventory as iv
from lexoria.sources import corpus

from .q_postrank import _cand, candidates


def _qrels(spark, sf_dir):
    c = candidates(spark, sf_dir, 40)
    lab = corpus.table(spark, sf_dir, "labels")
    return c.join(lab, c.id == lab.doc_id).select(F.col("query_id").alias("case_id"), F.col("id").alias("candidate_id"), (F.col("quality") + 1 - F.col("toxic")).alias("relevance"), F.col("position").alias("rank"))


def ndcg(spark, sf_dir):
    q = _qrels(spark, sf_dir)
    return ev.ndcg(q.select("case_id", "candidate_id", "rank"), q.select("case_id", "candidate_id", "relevance"))


def ndcg_unjudged(spark, sf_dir):
    q = _qrels(spark, sf_dir)
    ranked = candidates(spark, sf_dir, 40).select(F.col("query_id").alias("case_id"), F.col("id").alias("candidate_id"), F.col("position").alias("rank"))
    return ev.ndcg(ranked.filter("case_id > 2 OR rank < 3"), q.select("case_id", "candidate_id", "relevance"))


def good_references(spark, sf_dir):
    """(query_id, reference_id): for each question, the documents with a chunk that is labelled good."""
    chunk = corpus.chunks(spark, sf_dir).select("id", "document_id").join(corpus.table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("id")), "id")
    return chunk.select(F.col("document_id").alias("reference_id")).distinct().crossJoin(F.broadcast(corpus.questions(spark, sf_dir).select("query_id")))


GOOD_REFERENCES = "SELECT DISTINCT c.document_id AS reference_id FROM chunks c JOIN labels l ON l.doc_id = c.id WHERE l.quality = 1"


def recall(spark, sf_dir):
    """References: the documents with a chunk that is labelled good; a chunk matches by document id."""
    refs = good_references(spark, sf_dir).withColumnRenamed("query_id", "case_id")
    got = candidates(spark, sf_dir, 40).select(F.col("query_id").alias("case_id"), F.col("document_id").alias("doc"), F.col("position").alias("rank"))
    return ev.coverage(ev.first_matches(refs, got, F.col("doc") == F.col("reference_id")))


def evidence_terms(spark, sf_dir):
    """Reference evidence by terms: all words of a benchmark item, in their order, in a document."""
    item = corpus.table(spark, sf_dir, "benchmark").select((F.col("item_id") % 5).alias("case_id"), F.col("item_id").alias("reference_id"), F.col("text").alias("term"))
    docs = corpus.table(spark, sf_dir, "documents").select(F.col("text").alias("content"), (F.col("doc_id") + 1).alias("rank"))
    return ev.first_evidence(item, docs).groupBy("case_id").agg(F.count("*").alias("n"), F.count("rank").alias("found"), F.min("rank").alias("best"))


def cases(spark, sf_dir):
    """Answer cases with three-valued metrics, one a labelled document."""
    lab = corpus.table(spark, sf_dir, "labels")
    behaviors = F.array(*[F.lit(b) for b in ("exact_answer", "no_answer", "clarify", "partial_abstain")])
    return lab.select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, "holdout").otherwise("development").alias("split"), F.element_at(behaviors, (F.col("doc_id") % 4 + 1).cast("int")).alias("expected_behavior"),
        (F.col("toxic") == 1).alias("abstained"), ((F.col("doc_id") % 7 == 0) & (F.col("toxic") == 0)).alias("clarified"), F.when(F.col("doc_id") % 5 != 0, F.col("quality") == 1).alias("factual_correctness"),
        F.when(F.col("doc_id") % 6 != 0, F.col("quality") + F.col("toxic") > 0).alias("retrieval_relevance"), F.when(F.col("toxic") == 0, F.col("doc_id") % 8 != 0).alias("citation_validity"), (F.col("doc_id") % 2 == 0).alias("intent_match"), (F.col("doc_id") % 41 == 0).alias("failed"),
    )


_CASES = """cases AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'holdout' ELSE 'development' END AS split, ['exact_answer','no_answer','clarify','partial_abstain'][(doc_id % 4 + 1)::INTEGER] AS expected_behavior,
  toxic = 1 AS abstained, doc_id % 7 = 0 AND toxic = 0 AS clarified, CASE WHEN doc_id % 5 <> 0 THEN quality = 1 END AS factual_correctness, CASE WHEN doc_id % 6 <> 0 THEN quality + toxic > 0 END AS retrieval_relevance,
  CASE WHEN toxic = 0 THEN doc_id % 8 <> 0 END AS citation_validity, doc_id % 2 = 0 AS intent_match, doc_id % 41 = 0 AS failed FROM labels),
judged AS (SELECT *, CASE expected_behavior WHEN 'no_answer' THEN abstained WHEN 'clarify' THEN clarified WHEN 'exact_answer' THEN NOT abstained AND NOT clarified ELSE NOT clarified END AS behavior_match FROM cases)"""
METRICS = ["behavior_match", "factual_correctness", "retrieval_relevance", "citation_validity", "intent_match"]


def _judged(spark, sf_dir):
    return cases(spark, sf_dir).withColumn("behavior_match", ev.behavior_match())


def case_scores(spark, sf_dir):
    return _judged(spark, sf_dir).select("doc_id", "behavior_match", ev.false_abstention().alias("false_abstention"), ev.case_score().alias("score"))


def outcomes(spark, sf_dir):
    return cases(spark, sf_dir).withColumn("outcome", ev.case_outcome()).groupBy("split", "outcome").agg(F.count("*").alias("n"))


def metric_summary(spark, sf_dir):
    return ev.metrics_long(_judged(spark, sf_dir), METRICS, ["split"])


def wilson(spark, sf_dir):
    a = corpus.table(spark, sf_dir, "labels").groupBy((F.col("doc_id") % 20).alias("bucket")).agg(F.sum("toxic").alias("successes"), F.count("*").alias("total"))
    w = ev.wilson(F.col("successes"), F.col("total"))
    return a.select("bucket", "successes", "total", ev.rate(F.col("successes"), F.col("total")).alias("rate"), w["low"].alias("low"), w["high"].alias("high"))


def percentiles(spark, sf_dir):
    e = corpus.table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(*[ev.nearest_rank("value", p).alias(f"p{int(p * 100)}") for p in (0.33, 0.5, 0.95)])


def _runs(spark, sf_dir):
    runs = corpus.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), "o_orderstatus")
    r = corpus.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.when(F.col("l_linenumber") != 3, F.col("l_returnflag") == "R").alias("correct"), F.when(F.col("l_quantity") > 10, F.col("l_linestatus") == "O").alias("grounded"))
    return runs, r


def run_summary(spark, sf_dir):
    runs, r = _runs(spark, sf_dir)
    out = ev.run_summary(runs, r, ["correct"], ["grounded"])
    return out.withColumns({"correct_rate": F.round("correct_rate", 6), "grounded_rate": F.round("grounded_rate", 6)})


def non_regression(spark, sf_dir):
    s = ev.metrics_long(_judged(spark, sf_dir).filter("split = 'holdout'"), METRICS, [])
    rules = spark.createDataFrame([("facts", "factual_correctness", ">=", 0.7, True), ("behavior", "behavior_match", ">=", 0.2, True), ("citations", "citation_validity", "<=", 0.5, False), ("unknown", "recall", ">=", 0.8, False)], "rule string, path string, op string, threshold double, critical boolean")
    return ev.non_regression(s.select(F.col("metric").alias("path"), F.col("rate").alias("value")), rules)


def gate(spark, sf_dir):
    return ev.gate(non_regression(spark, sf_dir))


def gate_reasons(spark, sf_dir):
    return iv.gate_reasons(non_regression(spark, sf_dir))


def run_reports(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents")
    error = F.when(F.col("doc_id") % 19 == 0, "boom")
    kind = F.when(F.col("doc_id") % 38 == 0, "timeout")
    return iv.run_report(d.select(error.alias("error"), kind.alias("error_type"), (F.col("doc_id") % 7 == 0).alias("skipped"), (F.col("n_chars") % 9).alias("chunks_count"), F.when(F.col("doc_id") % 23 == 0, F.lit(2).cast("long")).alias("failed_chunks")), 1000)


def units(spark, sf_dir):
    lab = corpus.table(spark, sf_dir, "labels")
    unit, batch = (F.col("doc_id") % 300).alias("unit_id"), (F.col("doc_id") % 2).alias("batch_id")
    cases = lab.select(unit, batch, F.when(F.col("toxic") == 1, "no_evidence").when(F.col("quality") == 1, "answerable").otherwise("ambiguous").alias("answerability"))
    return iv.unit_coverage(corpus.table(spark, sf_dir, "documents").select(unit, batch).distinct(), cases)


def paired(spark, sf_dir):
    a = _judged(spark, sf_dir).withColumnRenamed("doc_id", "case_id")
    return ev.paired(a.filter("case_id % 10 <> 1").select("case_id", F.coalesce("factual_correctness", F.lit(False)).alias("x")).withColumnRenamed("x", "m"), a.filter("case_id % 10 <> 2").select("case_id", F.col("behavior_match").alias("m")), "m")


def identity_diff(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents")
    path = F.concat(F.lit("document."), "doc_id").alias("path")
    a = d.select(path, F.col("lang").alias("value"))
    b = d.filter("doc_id % 41 <> 3").select(path, F.when(F.col("doc_id") % 4 == 0, "xx").otherwise(F.col("lang")).alias("value"))
    return ev.identity_diff(a, b, ["document.0", "document.44"])


def answer_terms(spark, sf_dir):
    """Facts (all of them need an accepted phrase) and forbidden phrases in answers."""
    d = corpus.table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("answer"))
    facts = [[f" {p} " for p in phrases] for phrases in (["the", "der", "le", "el"], ["and", "und", "et", "y"], ["that", "das", "que"])]
    ok = iv.has_facts(F.col("answer"), facts)
    forbidden = iv.forbidden_found(F.col("answer"), ["token", "password", "licensed under"])
    return d.select("doc_id", ok.alias("factual_correctness"), F.array_join(forbidden, ",").alias("forbidden"))


QUERIES = {
    "ndcg_at_10": ndcg, "ndcg_at_10_unjudged": ndcg_unjudged, "retrieval_recall": recall, "evidence_term_match": evidence_terms, "case_score": case_scores, "case_outcomes": outcomes, "metric_summary": metric_summary,
    "wilson_interval": wilson, "nearest_rank_percentile": percentiles, "evaluation_run_summary": run_summary, "non_regression": non_regression, "gate_status": gate, "paired_view": paired, "identity_diff": identity_diff, "factual_and_forbidden": answer_terms, "gate_reasons": gate_reasons, "run_report": run_reports, "unit_coverage": units,
}

_W = """round(greatest(0, (p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 4) AS low, round(least(1, (p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 4) AS high"""
_LONG = "long AS (" + " UNION ALL ".join(f"SELECT split, '{m}' AS metric, {m} AS x FROM judged" for m in METRICS) + ")"
_QREL = f"{_cand(40)}, q AS (SELECT c.query_id AS case_id, c.id AS candidate_id, (l.quality + 1 - l.toxic) AS relevance, c.position AS rank FROM cand c JOIN labels l ON l.doc_id = c.id)"
_RULES = f"""WITH {_CASES}, {_LONG}, s AS (SELECT metric AS path, round(count(*) FILTER (x) / count(x), 4) AS value FROM long WHERE split = 'holdout' GROUP BY metric),
rules(rule, path, op, threshold, critical) AS (VALUES ('facts', 'factual_correctness', '>=', 0.7, TRUE), ('behavior', 'behavior_match', '>=', 0.2, TRUE), ('citations', 'citation_validity', '<=', 0.5, FALSE), ('unknown', 'recall', '>=', 0.8, FALSE)),
j AS (SELECT rule, critical, value, CASE WHEN value IS NULL THEN 'incomplete' WHEN CASE WHEN op = '<=' THEN value <= threshold ELSE value >= threshold END THEN 'passed' ELSE 'failed' END AS status FROM rules LEFT JOIN s USING (path))"""

ORACLES = {
    "gate_reasons": _RULES + " SELECT status, CASE WHEN status = 'passed' THEN 'passed' WHEN status = 'incomplete' THEN 'value_missing' WHEN critical THEN 'critical_rule_failed' ELSE 'rule_failed' END AS reason, count(*) AS n FROM j GROUP BY ALL",
    "run_report": """WITH r AS (SELECT doc_id % 19 = 0 AS f, doc_id % 7 = 0 AS s, n_chars % 9 AS c, CASE WHEN doc_id % 23 = 0 THEN 2 END AS fc, CASE WHEN doc_id % 38 = 0 THEN 'timeout' ELSE 'ingestion_error' END AS k FROM documents), t AS (SELECT count(*) AS returned, count(*) FILTER (NOT f AND NOT s) AS succeeded, count(*) FILTER (s) AS skipped, count(*) FILTER (f) AS failed, sum(c)::BIGINT AS chunks, coalesce(sum(fc), 0)::BIGINT AS failed_chunks, 1000::BIGINT AS expected FROM r)
SELECT *, succeeded = expected AND returned = expected AND skipped + failed + failed_chunks = 0 AS complete, (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT k, count(*) AS n FROM r WHERE f GROUP BY k)) AS error_types FROM t""",
    "unit_coverage": """WITH u AS (SELECT DISTINCT doc_id % 300 AS unit_id, doc_id % 2 AS batch_id FROM documents), c AS (SELECT doc_id % 300 AS unit_id, doc_id % 2 AS batch_id, CASE WHEN toxic = 1 THEN 'no_evidence' WHEN quality = 1 THEN 'answerable' ELSE 'ambiguous' END AS a FROM labels),
p AS (SELECT unit_id, batch_id, count(*) AS cases, array_to_string(list_sort(list(DISTINCT a)), ',') AS answerabilities, count(*) FILTER (a = 'answerable') AS y FROM c GROUP BY ALL) SELECT u.unit_id, u.batch_id, coalesce(cases, 0) AS cases, coalesce(answerabilities, '') AS answerabilities, coalesce(y, 0) > 0 AND coalesce(cases, 0) > coalesce(y, 0) AS covered FROM u LEFT JOIN p USING (unit_id, batch_id)""",
    "ndcg_at_10": f"""WITH {_QREL}, d AS (SELECT case_id, sum(CASE WHEN rank <= 10 THEN (2 ** relevance - 1) / log2(rank + 1) ELSE 0 END) AS dcg FROM q GROUP BY 1),
i AS (SELECT case_id, sum((2 ** relevance - 1) / log2(r + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY relevance DESC, candidate_id) AS r FROM q) WHERE r <= 10 GROUP BY 1)
SELECT d.case_id, CASE WHEN idcg > 0 THEN round(dcg / idcg, 4) END AS ndcg FROM d LEFT JOIN i USING (case_id)""",
    "ndcg_at_10_unjudged": f"""WITH {_QREL}, k AS (SELECT query_id AS case_id, id AS candidate_id, position AS rank FROM cand WHERE query_id > 2 OR position < 3), j AS (SELECT k.*, q.relevance FROM k LEFT JOIN q USING (case_id, candidate_id)),
d AS (SELECT case_id, sum(CASE WHEN rank <= 10 THEN coalesce((2 ** relevance - 1) / log2(rank + 1), 0) ELSE 0 END) AS dcg, count(*) FILTER (relevance IS NULL) AS u FROM j GROUP BY 1),
i AS (SELECT case_id, sum((2 ** relevance - 1) / log2(r + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY relevance DESC, candidate_id) AS r FROM q) WHERE r <= 10 GROUP BY 1)
SELECT d.case_id, CASE WHEN u = 0 AND idcg > 0 THEN round(dcg / idcg, 4) END AS ndcg FROM d LEFT JOIN i USING (case_id)""",
    "retrieval_recall": f"""WITH {_cand(40)}, m AS (SELECT q.query_id AS case_id, r.reference_id, (SELECT min(position) FROM cand c WHERE c.query_id = q.query_id AND c.document_id = r.reference_id) AS rank FROM questions q, ({GOOD_REFERENCES}) r)
SELECT case_id, count(*) AS n_references, round(count(*) FILTER (rank <= 10) / count(*), 4) AS recall_10, round(count(*) FILTER (rank <= 20) / count(*), 4) AS recall_20, round(count(*) FILTER (rank <= 40) / count(*), 4) AS recall_40,
round(sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) / count(*), 4) AS discounted_10 FROM m GROUP BY case_id""",
    "evidence_term_match": """WITH i AS (SELECT item_id % 5 AS case_id, item_id AS reference_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[^\\s]+'), ' ') || ' ' AS term FROM benchmark), d AS (SELECT ' ' || array_to_string(regexp_extract_all(lower(text), '[^\\s]+'), ' ') || ' ' AS text, doc_id + 1 AS rank FROM documents),
m AS (SELECT case_id, reference_id, (SELECT min(rank) FROM d WHERE contains(text, term)) AS rank FROM i) SELECT case_id, count(*) AS n, count(rank) AS found, min(rank) AS best FROM m GROUP BY case_id""",
    "case_score": f"""WITH {_CASES} SELECT doc_id, behavior_match, CASE WHEN expected_behavior = 'exact_answer' THEN abstained END AS false_abstention,
CASE WHEN NOT (factual_correctness IS NULL AND NOT abstained AND expected_behavior IN ('exact_answer', 'partial_abstain')) THEN round((0.25::DOUBLE * behavior_match::INTEGER + 0.1::DOUBLE * intent_match::INTEGER + 0.35::DOUBLE * coalesce(factual_correctness::INTEGER, 0) + 0.15::DOUBLE * coalesce(retrieval_relevance::INTEGER, 0) + 0.15::DOUBLE * coalesce(citation_validity::INTEGER, 0))
 / (0.25::DOUBLE + 0.1::DOUBLE + CASE WHEN factual_correctness IS NULL THEN 0 ELSE 0.35::DOUBLE END + CASE WHEN retrieval_relevance IS NULL THEN 0 ELSE 0.15::DOUBLE END + CASE WHEN citation_validity IS NULL THEN 0 ELSE 0.15::DOUBLE END), 4) END AS score FROM judged""",
    "case_outcomes": f"""WITH {_CASES}, o AS (SELECT split, CASE WHEN failed THEN 'operational_failure' WHEN expected_behavior = 'no_answer' AND abstained THEN 'correct_abstention' WHEN expected_behavior = 'no_answer' THEN 'unsupported_answer' WHEN expected_behavior = 'clarify' AND clarified THEN 'correct_clarification' WHEN expected_behavior = 'clarify' THEN 'missing_clarification'
 WHEN abstained THEN 'false_abstention' WHEN factual_correctness IS NULL THEN 'not_evaluable' WHEN factual_correctness THEN 'correct_answer' ELSE 'incorrect_answer' END AS outcome FROM cases) SELECT split, outcome, count(*) AS n FROM o GROUP BY ALL""",
    "metric_summary": f"WITH {_CASES}, {_LONG}, a AS (SELECT split, metric, count(*) FILTER (x) AS passed, count(*) FILTER (NOT x) AS failed, count(x) AS evaluated, count(x)::DOUBLE AS n, count(*) FILTER (x) / count(x)::DOUBLE AS p FROM long GROUP BY ALL) SELECT split, metric, passed, failed, evaluated, round(p, 4) AS rate, {_W} FROM a",
    "wilson_interval": f"WITH a AS (SELECT doc_id % 20 AS bucket, sum(toxic)::BIGINT AS successes, count(*) AS total, count(*)::DOUBLE AS n, sum(toxic) / count(*)::DOUBLE AS p FROM labels GROUP BY 1) SELECT bucket, successes, total, round(p, 4) AS rate, {_W} FROM a",
    "nearest_rank_percentile": "SELECT event_type, quantile_disc(value, 0.33) AS p33, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type",
    "evaluation_run_summary": """WITH r AS (SELECT l_orderkey AS run_id, CASE WHEN l_linenumber <> 3 THEN l_returnflag = 'R' END AS correct, CASE WHEN l_quantity > 10 THEN l_linestatus = 'O' END AS grounded FROM lineitem)
SELECT o.o_orderkey AS run_id, o.o_orderstatus, count(r.run_id) AS cases, round(avg(correct::INTEGER), 6) AS correct_rate, round(avg(CASE WHEN grounded THEN 1.0 ELSE 0.0 END), 6) AS grounded_rate, count(correct) AS correct_evaluated FROM orders o LEFT JOIN r ON r.run_id = o.o_orderkey GROUP BY ALL""",
    "non_regression": f"{_RULES} SELECT * FROM j",
    "gate_status": f"{_RULES} SELECT CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 'failed' WHEN count(*) FILTER (status = 'incomplete') > 0 THEN 'incomplete' ELSE 'passed' END AS status FROM j",
    "paired_view": f"""WITH {_CASES}, a AS (SELECT doc_id, coalesce(factual_correctness, FALSE) AS x FROM judged WHERE doc_id % 10 <> 1), b AS (SELECT doc_id, behavior_match AS y FROM judged WHERE doc_id % 10 <> 2)
SELECT count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS paired, count(*) FILTER (b.doc_id IS NULL) AS only_first, count(*) FILTER (a.doc_id IS NULL) AS only_second, count(*) FILTER (NOT x AND y) AS gained, count(*) FILTER (x AND NOT y) AS lost, count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL AND x IS NOT DISTINCT FROM y) AS same FROM a FULL JOIN b USING (doc_id)""",
    "identity_diff": """WITH a AS (SELECT 'document.' || doc_id AS path, lang AS current FROM documents), b AS (SELECT 'document.' || doc_id AS path, CASE WHEN doc_id % 4 = 0 THEN 'xx' ELSE lang END AS reference FROM documents WHERE doc_id % 41 <> 3)
SELECT path, current, reference, path IN ('document.0', 'document.44') AS declared FROM a FULL JOIN b USING (path) WHERE current IS DISTINCT FROM reference""",
    "factual_and_forbidden": """WITH d AS (SELECT doc_id, lower(text) AS a FROM documents) SELECT doc_id, (contains(a, ' the ') OR contains(a, ' der ') OR contains(a, ' le ') OR contains(a, ' el ')) AND (contains(a, ' and ') OR contains(a, ' und ') OR contains(a, ' et ') OR contains(a, ' y ')) AND (contains(a, ' that ') OR contains(a, ' das ') OR contains(a, ' que ')) AS factual_correctness,
array_to_string(list_filter(['token', 'password', 'licensed under'], lambda p: contains(a, p)), ',') AS forbidden FROM d""",
}
