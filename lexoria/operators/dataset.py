"""Evaluation datasets: normal cases, cases from knowledge gaps, judgments, identities, answer states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexoria.functions.text import folded

BEHAVIORS = ("exact_answer", "partial_abstain", "no_answer", "clarify")
SPLITS = ("development", "holdout")
ANSWERABILITY = ("answerable", "ambiguous", "no_evidence")
#: Reasons for which an abstention counts as grounded.
ABSTENTIONS = ("no_chunks", "few_chunks", "low_similarity", "low_similarity_operational", "no_context_after_merge", "grounding_validation_failed")


def _text(column: str) -> Column:
    return F.trim(F.coalesce(F.col(column).cast("string"), F.lit("")))


def _one_of(value: Column, allowed: tuple[str, ...], default: Column) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(default)


def normal_cases(cases: DataFrame, default_source: str = "merged") -> DataFrame:
    """(position, id, question, expected_behavior, expected_intent, source, split, answerability) of
    cases with a question; unknown or missing values get their defaults. cases: these columns as
    text, and position from 1."""
    behavior = _one_of(F.lower(_text("expected_behavior")), BEHAVIORS, F.lit("exact_answer"))
    intent = F.lower(_text("expected_intent"))
    follows = F.when(behavior == "clarify", "ambiguous").when(behavior == "no_answer", "no_evidence").otherwise("answerable")
    return cases.filter(_text("question") != "").select(
        "position",
        F.coalesce(F.nullif(_text("id"), F.lit("")), F.format_string("case-%04d", F.col("position"))).alias("id"),
        _text("question").alias("question"),
        behavior.alias("expected_behavior"),
        F.when(intent == "", "general").otherwise(intent).alias("expected_intent"),
        F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit(default_source)).alias("source"),
        _one_of(F.lower(_text("split")), SPLITS, F.lit("development")).alias("split"),
        _one_of(F.lower(_text("answerability")), ANSWERABILITY, follows).alias("answerability"),
    )


def distinct_cases(cases: DataFrame) -> DataFrame:
    """Normal cases, of each folded question the first; questions that fold to nothing leave."""
    keyed = normal_cases(cases).withColumn("key", folded(F.col("question"))).filter("key <> ''")
    first = Window.partitionBy("key").orderBy("position")
    return keyed.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n", "key")


def cases_from_gaps(gaps: DataFrame, limit: int = 10) -> DataFrame:
    """A case without evidence for each of the first ``limit`` gaps (place from 1, query) that has a
    query; they wait for review."""
    asked = gaps.filter(F.col("place") <= max(0, limit)).withColumn("question", F.trim("query")).filter("question <> ''")
    fixed = {"expected_behavior": "no_answer", "expected_intent": "general", "source": "knowledge_gap", "split": "development", "answerability": "no_evidence", "review": "pending_human"}
    return asked.select(F.format_string("kgap-%04d", F.col("place")).alias("id"), "question", *[F.lit(v).alias(k) for k, v in fixed.items()])


def judgment_problems(qrels: DataFrame) -> DataFrame:
    """(case_id, candidate_id, problem): blank candidates, relevances that are not 0 to 3, and
    candidates judged twice. qrels: (case_id, candidate_id, relevance as text)."""
    name = F.trim(F.coalesce("candidate_id", F.lit("")))
    times = F.count("*").over(Window.partitionBy("case_id", "name"))
    problem = F.when(F.col("name") == "", "blank_candidate").when(~F.coalesce(F.col("relevance").rlike("^[0-3]$"), F.lit(False)), "relevance_out_of_range").when(F.col("times") > 1, "duplicate_candidate")
    return qrels.withColumn("name", name).withColumn("times", times).withColumn("problem", problem).filter("problem IS NOT NULL").select("case_id", F.col("name").alias("candidate_id"), "problem")


def flat_identity(rows: DataFrame, key: str = "id", value: str = "identity", depth: int = 8, skip: str = "fingerprint_sha256") -> DataFrame:
    """(key, path, value): the leaves of a JSON object by dotted path, as JSON text; arrays are
    leaves. Objects nested deeper than ``depth`` stay whole."""
    open_rows = rows.select(key, F.lit("").alias("path"), F.col(value).alias("value"))
    done = None
    for _ in range(depth):
        parts = open_rows.withColumn("parts", F.from_json("value", "map<string,string>"))
        is_object = F.coalesce(F.ltrim("value").startswith("{"), F.lit(False)) & (F.size("parts") > 0)
        leaves = parts.filter(~is_object).select(key, "path", "value")
        done = leaves if done is None else done.unionByName(leaves)
        inner = parts.filter(is_object).select(key, "path", F.explode("parts").alias("k", "value")).filter(F.col("k") != skip)
        open_rows = inner.select(key, F.when(F.col("path") == "", F.col("k")).otherwise(F.concat_ws(".", "path", "k")).alias("path"), "value")
    return done.unionByName(open_rows)


def abstained(answer: Column, flagged: Column, phrase: str) -> Column:
    """Flagged so, or an answer that begins with the phrase for no answer."""
    return F.coalesce(flagged, F.lit(False)) | F.trim(F.coalesce(answer, F.lit(""))).startswith(phrase)


def clarified(answer: Column, state: Column, cue: str) -> Column:
    """In the state of asking back, or a question with a cue word (a pattern over folded text)."""
    asks = F.coalesce(answer, F.lit("")).contains("?") & F.coalesce(folded(answer).rlike(cue), F.lit(False))
    return F.coalesce(state == "clarification_needed", F.lit(False)) | asks


def grounded(is_abstained: Column, errors: Column, reason: Column) -> Column:
    """Without grounding errors, or abstained for a reason that needs none."""
    clean = F.coalesce(F.size(errors) <= 0, F.lit(True))
    return clean | (is_abstained & F.coalesce(reason.isin(*ABSTENTIONS), F.lit(False)))


def citation_validity(is_abstained: Column, errors: Column, cited: Column, wanted: Column) -> Column:
    """Whether an answer without grounding errors cites a wanted source; null for abstentions and
    where no source is wanted."""
    known = ~is_abstained & (F.size(wanted) > 0)
    return F.when(known, F.coalesce(F.size(errors) <= 0, F.lit(True)) & F.arrays_overlap(cited, wanted))


def reviewed_coverage(coverage: Column, review: Column) -> Column:
    """A coverage counts only where a person has approved its references."""
    return F.when(review == "approved", coverage)
