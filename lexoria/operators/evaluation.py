"""Retrieval and answer metrics, summaries and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wilson(successes: Column, total: Column, z: float = 1.96) -> Column:
    """struct(low, high) of the score interval, clamped to 0..1, rounded to 4; null for no cases."""
    n = total.cast("double")
    p = successes / n
    z2 = z * z
    centre, spread = p + z2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    low, high = (centre - spread) / (1 + z2 / n), (centre + spread) / (1 + z2 / n)
    return F.when(total > 0, F.struct(F.round(F.greatest(F.lit(0.0), low), 4).alias("low"), F.round(F.least(F.lit(1.0), high), 4).alias("high")))


def rate(successes: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(successes / total, 4))


def nearest_rank(column: str, p: float) -> Column:
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")


def first_matches(references: DataFrame, retrieved: DataFrame, condition: Column) -> DataFrame:
    """(case_id, reference_id, rank): each reference's first matching rank; null if none matches.
    Both sides carry case_id; the join is on it, ``condition`` is the residual."""
    hits = references.join(retrieved, "case_id").filter(condition).groupBy("case_id", "reference_id").agg(F.min("rank").alias("rank"))
    return references.select("case_id", "reference_id").distinct().join(hits, ["case_id", "reference_id"], "left")


def first_evidence(references: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(case_id, reference_id, rank): the first ranked text that holds all words of a reference's
    term in their order; null if none does. references: (case_id, reference_id, term); retrieved:
    (content, rank).

    Texts meet the terms on their first word, so that only texts that hold it are compared; a term
    without words matches nothing."""
    row = lambda x: F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(x), F.lit(r"\S+"), F.lit(0)), " "), F.lit(" "))
    asked = references.select("case_id", "reference_id", row(F.col("term")).alias("term")).withColumn("first", F.split("term", " ")[1]).filter("first <> ''")
    firsts = asked.select("first").distinct()
    texts = retrieved.select("rank", row(F.col("content")).alias("content"))
    held = texts.select("rank", "content", F.explode(F.array_distinct(F.split(F.trim("content"), " "))).alias("first")).join(firsts, "first", "left_semi")
    hits = held.join(asked, "first").filter(F.col("content").contains(F.col("term"))).groupBy("case_id", "reference_id").agg(F.min("rank").alias("rank"))
    return references.select("case_id", "reference_id").distinct().join(hits, ["case_id", "reference_id"], "left")


def coverage(matches: DataFrame, cuts: tuple[int, ...] = (10, 20, 40)) -> DataFrame:
    """Per case: share of references found by each cut, and the discounted share at 10."""
    found = [F.round(F.count_if(F.col("rank") <= k) / F.count("*"), 4).alias(f"recall_{k}") for k in cuts]
    gain = F.round(F.sum(F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)) / F.count("*"), 4)
    return matches.groupBy("case_id").agg(F.count("*").alias("n_references"), *found, gain.alias("discounted_10"))


def ndcg(ranked: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(case_id, ndcg): null where any candidate has no judgment or no judgment is relevant. Gains
    are 2**relevance - 1; the ideal order is that of all judgments. ranked: (case_id, candidate_id,
    rank); qrels: (case_id, candidate_id, relevance)."""
    gain, discount = F.pow(F.lit(2.0), F.col("relevance")) - 1, lambda r: F.log2(F.col(r) + 1.0)
    joined = ranked.join(qrels, ["case_id", "candidate_id"], "left")
    dcg = joined.groupBy("case_id").agg(F.sum(F.when(F.col("rank") <= k, gain / discount("rank")).otherwise(0.0)).alias("dcg"), F.count_if(F.col("relevance").isNull()).alias("unjudged"))
    ideal = qrels.withColumn("i", F.row_number().over(Window.partitionBy("case_id").orderBy(F.col("relevance").desc(), "candidate_id"))).filter(F.col("i") <= k)
    idcg = ideal.groupBy("case_id").agg(F.sum(gain / discount("i")).alias("idcg"))
    return dcg.join(idcg, "case_id", "left").select("case_id", F.when((F.col("unjudged") == 0) & (F.col("idcg") > 0), F.round(F.col("dcg") / F.col("idcg"), 4)).alias("ndcg"))


#: Weights of a case's score.
SCORE_WEIGHTS = {"behavior_match": 0.25, "intent_match": 0.10, "factual_correctness": 0.35, "retrieval_relevance": 0.15, "citation_validity": 0.15}


def case_score() -> Column:
    """Weighted share of true metrics over those known; null if facts are unknown in an answered
    case that expects an exact or partial answer."""
    known, got = F.lit(0.0), F.lit(0.0)
    for name, weight in SCORE_WEIGHTS.items():
        known = known + F.when(F.col(name).isNotNull(), weight).otherwise(0.0)
        got = got + F.when(F.col(name), weight).otherwise(0.0)
    blind = F.col("factual_correctness").isNull() & ~F.col("abstained") & F.col("expected_behavior").isin("exact_answer", "partial_abstain")
    return F.when(~blind & (known > 0), F.round(got / known, 4))


def behavior_match() -> Column:
    e, abstained, clarified = F.col("expected_behavior"), F.col("abstained"), F.col("clarified")
    return F.when(e == "no_answer", abstained).when(e == "clarify", clarified).when(e == "exact_answer", ~abstained & ~clarified).when(e == "partial_abstain", ~clarified)


def false_abstention() -> Column:
    return F.when(F.col("expected_behavior") == "exact_answer", F.col("abstained"))


def case_outcome() -> Column:
    """The first label that fits."""
    e, a, c, f = F.col("expected_behavior"), F.col("abstained"), F.col("clarified"), F.col("factual_correctness")
    return (
        F.when(F.col("failed"), "operational_failure").when((e == "no_answer") & a, "correct_abstention").when(e == "no_answer", "unsupported_answer")
        .when((e == "clarify") & c, "correct_clarification").when(e == "clarify", "missing_clarification").when(a, "false_abstention")
        .when(f.isNull(), "not_evaluable").when(f, "correct_answer").otherwise("incorrect_answer")
    )


def boolean_summary(results: DataFrame, metric: str, by: list[str]) -> DataFrame:
    """passed, failed, evaluated, rate and interval of a nullable boolean; nulls do not count."""
    x = F.col(metric)
    a = results.groupBy(*by).agg(F.count_if(x).alias("passed"), F.count_if(~x).alias("failed"), F.count(x).alias("evaluated"))
    w = wilson(F.col("passed"), F.col("evaluated"))
    return a.select(*by, F.lit(metric).alias("metric"), "passed", "failed", "evaluated", rate(F.col("passed"), F.col("evaluated")).alias("rate"), w["low"].alias("low"), w["high"].alias("high"))


def metrics_long(results: DataFrame, metrics: list[str], by: list[str]) -> DataFrame:
    """boolean_summary of several metrics in one pass over the results."""
    long = results.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in metrics])).alias("e")).select(*by, "e.*")
    a = long.groupBy(*by, "metric").agg(F.count_if("x").alias("passed"), F.count_if(~F.col("x")).alias("failed"), F.count("x").alias("evaluated"))
    w = wilson(F.col("passed"), F.col("evaluated"))
    return a.select(*by, "metric", "passed", "failed", "evaluated", rate(F.col("passed"), F.col("evaluated")).alias("rate"), w["low"].alias("low"), w["high"].alias("high"))


def run_summary(runs: DataFrame, results: DataFrame, averaged: list[str], zero_when_missing: list[str]) -> DataFrame:
    """One row a run, also without results: counts; rates over known values (null if none); rates
    that count unknown values as false (0 without results)."""
    a = results.groupBy("run_id").agg(F.count("*").alias("cases"), *[F.avg(F.col(c).cast("int")).alias(f"{c}_rate") for c in averaged], *[F.avg(F.when(F.col(c), 1.0).otherwise(0.0)).alias(f"{c}_rate") for c in zero_when_missing], *[F.count(c).alias(f"{c}_evaluated") for c in averaged])
    j = runs.join(a, "run_id", "left")
    fill = ["cases", *[f"{c}_rate" for c in zero_when_missing], *[f"{c}_evaluated" for c in averaged]]
    return j.fillna(0, subset=fill)


def non_regression(summary: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule, status): passed, failed or incomplete. summary: (path, value); rules: (rule, path, op
    of <= or >=, threshold, critical)."""
    j = rules.join(summary, "path", "left")
    ok = F.when(F.col("op") == "<=", F.col("value") <= F.col("threshold")).otherwise(F.col("value") >= F.col("threshold"))
    return j.select("rule", "critical", "value", F.when(F.col("value").isNull(), "incomplete").when(ok, "passed").otherwise("failed").alias("status"))


def gate(statuses: DataFrame) -> DataFrame:
    """failed before incomplete before passed."""
    return statuses.agg(F.when(F.count_if(F.col("status") == "failed") > 0, "failed").when(F.count_if(F.col("status") == "incomplete") > 0, "incomplete").otherwise("passed").alias("status"))


def paired(a: DataFrame, b: DataFrame, metric: str) -> DataFrame:
    """One row: cases in both, only in one, and how the metric moved."""
    j = a.select("case_id", F.lit(1).alias("_a"), F.col(metric).alias("x")).join(b.select("case_id", F.lit(1).alias("_b"), F.col(metric).alias("y")), "case_id", "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return j.agg(F.count_if(both).alias("paired"), F.count_if(F.col("_b").isNull()).alias("only_first"), F.count_if(F.col("_a").isNull()).alias("only_second"), F.count_if(both & ~F.col("x") & F.col("y")).alias("gained"), F.count_if(both & F.col("x") & ~F.col("y")).alias("lost"), F.count_if(both & F.col("x").eqNullSafe(F.col("y"))).alias("same"))


def identity_diff(current: DataFrame, reference: DataFrame, declared: list[str]) -> DataFrame:
    """(path, current, reference, declared) of unequal entries of two flattened identities."""
    j = current.select("path", F.col("value").alias("current")).join(reference.select("path", F.col("value").alias("reference")), "path", "full_outer")
    return j.filter(~F.col("current").eqNullSafe(F.col("reference"))).withColumn("declared", F.col("path").isin(declared))
