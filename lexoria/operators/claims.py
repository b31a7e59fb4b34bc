"""Claims of answers: evidence spans, claim sets, judgment questions, policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evidence_index(evidence: DataFrame, rendered: DataFrame) -> DataFrame:
    """(answer_id, evidence_id, quote, valid, problem): evidence counts if its span lies in the
    rendered context and its hash fits. evidence: (answer_id, evidence_id, start, end, sha256);
    rendered: (answer_id, context)."""
    j = evidence.join(rendered, "answer_id", "left").withColumn("quote", F.expr("substring(context, start + 1, end - start)"))
    problem = F.when(F.col("context").isNull(), "not_rendered").when((F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.col("end") > F.length("context")), "span_out_of_range").when(F.sha2("quote", 256) != F.col("sha256"), "hash_mismatch")
    return j.select("answer_id", "evidence_id", "quote", problem.isNull().alias("valid"), problem.alias("problem"))


def claim_problems(claims: DataFrame, answers: DataFrame, evidence: DataFrame, most: int = 12) -> DataFrame:
    """(answer_id, claim_id, problem): null for a sound claim. claims: (answer_id, claim_id, start,
    end, text, evidence_id); a claim must be a verbatim span of its answer, have an id of its own and
    name valid evidence; an answer has at most ``most``."""
    known = evidence.filter("valid").select("answer_id", "evidence_id", F.lit(True).alias("_known"))
    counts = claims.groupBy("answer_id").agg(F.count("*").alias("_all"))
    twice = claims.groupBy("answer_id", "claim_id").agg(F.count("*").alias("_same"))
    j = claims.join(answers, "answer_id", "left").join(known, ["answer_id", "evidence_id"], "left").join(counts, "answer_id").join(twice, ["answer_id", "claim_id"])
    span = F.expr("substring(answer, start + 1, end - start)")
    p = F.when(F.col("_all") > most, "too_many_claims").when(F.col("_same") > 1, "duplicate_id").when(~span.eqNullSafe(F.col("text")), "not_verbatim").when(F.col("_known").isNull(), "unknown_evidence")
    return j.select("answer_id", "claim_id", p.alias("problem"))


def judgment_questions(claims: DataFrame) -> DataFrame:
    """(answer_id, claim_id, question_id, kind): one about support and one about contradiction."""
    kind = F.explode(F.array(F.lit("support"), F.lit("contradiction")))
    return claims.select("answer_id", "claim_id", kind.alias("kind")).withColumn("question_id", F.concat_ws(":", "claim_id", "kind"))


def decision_problems(probabilities: Column, choice: Column, options: Column) -> Column:
    """Null for a sound decision: probabilities in 0..1 that sum to 1, and the choice is the largest."""
    total = F.aggregate(probabilities, F.lit(0.0), lambda a, x: a + x)
    best = F.element_at(options, F.array_position(probabilities, F.array_max(probabilities)).cast("int"))
    return F.when(F.exists(probabilities, lambda x: (x < 0) | (x > 1)), "out_of_range").when(F.abs(total - 1) > 1e-6, "does_not_sum_to_1").when(best != choice, "choice_is_not_largest")


def apply_policy(probabilities: Column, choice: Column, confidence: float = 0.6, margin: float = 0.15) -> Column:
    """The choice, or inconclusive below the least confidence or margin over the second."""
    ranked = F.reverse(F.array_sort(probabilities))
    first, second = F.get(ranked, F.lit(0)), F.coalesce(F.get(ranked, F.lit(1)), F.lit(0.0))
    return F.when((first >= confidence) & (first - second >= margin), choice).otherwise("inconclusive")


def evidence_matches(reference: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(case_id, reference_id, rank): first match by canonical id, revision, section, source or
    alias, and contained terms. reference: (case_id, reference_id, canonical_id, revision,
    section_key, source, terms array); retrieved: (case_id, rank, canonical_id, revision,
    section_key, filename, aliases array, content) with folded contents and terms."""
    r = retrieved.select("case_id", "rank", F.col("canonical_id").alias("c"), F.col("revision").alias("v"), F.col("section_key").alias("k"), "filename", "aliases", "content")
    same = F.col("canonical_id").isNull() | ((F.lower("canonical_id") == F.lower("c")) & (F.col("revision").isNull() | (F.col("revision") == F.col("v"))) & (F.col("section_key").isNull() | (F.col("section_key") == F.col("k"))))
    named = F.col("source").isNull() | (F.lower("source") == F.lower("filename")) | (F.col("canonical_id").isNotNull() & F.exists("aliases", lambda a: F.lower(a) == F.lower("source")))
    terms = F.forall("terms", lambda t: F.contains("content", t))
    hits = reference.join(r, "case_id").filter(F.coalesce(same, F.lit(False)) & F.coalesce(named, F.lit(False)) & terms).groupBy("case_id", "reference_id").agg(F.min("rank").alias("rank"))
    return reference.select("case_id", "reference_id").join(hits, ["case_id", "reference_id"], "left")


def claim_round(claims: DataFrame, decisions: DataFrame) -> DataFrame:
    """(answer_id, status, reason, judged): one round of judging an answer's claims in batches.

    claims: (answer_id, claim_id, batch, status), batch null for claims too long for any; decisions:
    (answer_id, batch, outcome, model_matches). The first batch without a sound decision closes the
    round as inconclusive, with its outcome, missing_decision or model_mismatch as the reason; only
    the claims before it count as judged. Claims too long for any batch close it before the first
    one. Else: rejected with any negative claim, supported if all are, inconclusive otherwise.
    """
    asked = claims.groupBy("answer_id", "batch").agg(F.count("*").alias("n"), F.bool_or(F.col("status").isin("contradicted", "unsupported", "conflicting")).alias("bad"), F.every(F.coalesce(F.col("status") == "supported", F.lit(False))).alias("good"))
    sound = (F.col("outcome") == "ok") & F.col("model_matches")
    reason = F.when(F.col("batch").isNull(), "state_limit").when(F.col("outcome").isNull(), "missing_decision").when(F.col("outcome") != "ok", F.col("outcome")).when(~sound, "model_mismatch")
    at = asked.join(decisions, ["answer_id", "batch"], "left").withColumn("reason", reason).withColumn("batch", F.coalesce("batch", F.lit(0)))
    first = at.groupBy("answer_id").agg(F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("batch"))).alias("reason"), F.min(F.when(F.col("reason").isNotNull(), F.col("batch"))).alias("stop"), F.bool_or("bad").alias("bad"), F.every("good").alias("good"))
    judged = at.select("answer_id", "batch", "n").join(first.select("answer_id", "stop"), "answer_id").filter("stop IS NULL OR batch < stop").groupBy("answer_id").agg(F.sum("n").alias("judged"))
    status = F.when(F.col("reason").isNotNull(), "inconclusive").when(F.col("bad"), "rejected").when(F.col("good"), "supported").otherwise("inconclusive")
    return first.join(judged, "answer_id", "left").select("answer_id", status.alias("status"), "reason", F.coalesce("judged", F.lit(0)).alias("judged"))


def documentation_tasks(questions: DataFrame, feedback: DataFrame, base: DataFrame, reason: str = "scoped feedback differs from the corpus", most: int = 1_500) -> DataFrame:
    """(query_id, query, feedback_item_ids, base_sources, reason, status): an open task for every
    question answered both by scoped feedback and by the corpus. The query is cut to ``most``
    characters; ids and sources are distinct and in order, blank ones left out.

    questions: (query_id, query); feedback: (query_id, feedback_item_id); base: (query_id, filename),
    both of the few rows retrieved for a question.
    """
    named = lambda c: F.sort_array(F.collect_set(F.when(F.col(c) != "", F.col(c))))
    items = feedback.groupBy("query_id").agg(named("feedback_item_id").alias("feedback_item_ids"))
    sources = base.groupBy("query_id").agg(named("filename").alias("base_sources"))
    both = questions.join(items, "query_id").join(sources, "query_id")
    return both.select("query_id", F.left(F.coalesce("query", F.lit("")), F.lit(most)).alias("query"), "feedback_item_ids", "base_sources", F.lit(reason).alias("reason"), F.lit("OPEN").alias("status"))
