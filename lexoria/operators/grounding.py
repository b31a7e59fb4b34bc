"""Checks of answers against their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_source(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.trim(name), r"^[`*]+|[`*]+$", "")))


def cited_sources(answer: Column, section: str = r"(?i)^\s*(?:\*\*)?(fontes|sources)(?:\*\*)?\s*:?\s*$") -> Column:
    """Distinct sources, sorted: inline ``[fonte: a; b]`` lists, and bullets below a sources line up
    to the next heading line."""
    inline = F.flatten(F.transform(F.regexp_extract_all(answer, F.lit(r"(?i)\[(?:fonte|source)s?:\s*([^\]]+)\]"), F.lit(1)), lambda x: F.split(x, "[;,|]")))
    rows = F.transform(F.split(answer, "\n"), F.trim)
    start = F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("got"))
    bullet = r"^(?:[-*•]\s+|\d+[.)]\s+)(.+)$"

    def step(a, x):
        item = F.split_part(F.regexp_extract(x, bullet, 1), F.lit("("), F.lit(1))
        stop = x.rlike(r"^[A-Za-z].*:$")
        return F.when(x.rlike(section), F.struct(F.lit(True).alias("on"), a["got"].alias("got"))).when(a["on"] & x.rlike(bullet), F.struct(F.lit(True).alias("on"), F.concat(a["got"], F.array(item)).alias("got"))).when(a["on"] & stop, F.struct(F.lit(False).alias("on"), a["got"].alias("got"))).otherwise(a)

    listed = F.aggregate(rows, start, step, lambda a: a["got"])
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.concat(inline, listed), normal_source), lambda x: x != "")))


def grounding_errors(answer: Column, cited: Column, allowed: Column, needs_section: bool, operational: Column) -> Column:
    """Names of what is wrong, in order: empty_answer, missing_sources_section, no_citation,
    unknown_source, operational_without_source."""
    has_section = answer.rlike(r"(?im)^\s*(?:\*\*)?(fontes|sources)(?:\*\*)?\s*:?\s*$")
    errors = [
        F.when(F.trim(F.coalesce(answer, F.lit(""))) == "", "empty_answer"),
        F.when(F.lit(needs_section) & ~has_section, "missing_sources_section"),
        F.when(F.size(cited) == 0, "no_citation"),
        F.when(F.size(F.array_except(cited, allowed)) > 0, "unknown_source"),
        F.when(operational & (F.size(F.array_intersect(cited, allowed)) == 0), "operational_without_source"),
    ]
    return F.array_compact(F.array(*errors))


def critical(errors: Column) -> Column:
    return F.exists(errors, lambda e: e != "missing_inline_citation")


def sources_only(answer: Column, allowed: Column) -> Column:
    """The answer without inline citations, and the allowed ones of its sources as sorted bullets."""
    body = F.trim(F.regexp_replace(F.regexp_replace(answer, r"(?i)\s*\[(?:fonte|source)s?:[^\]]*\]", ""), r"(?is)\n\s*(?:\*\*)?(fontes|sources)(?:\*\*)?\s*:?\s*\n.*$", ""))
    kept = F.array_sort(F.array_intersect(cited_sources(answer), allowed))
    return F.when(F.size(kept) > 0, F.concat(body, F.lit("\n\nFontes:\n"), F.array_join(F.transform(kept, lambda x: F.concat(F.lit("- "), x)), "\n"))).otherwise(body)


def claim_status(support: Column, contradiction: Column, low: float = 0.35, high: float = 0.65) -> Column:
    """Two independent bands: supported, contradicted, unsupported, conflicting or inconclusive."""
    s_high, s_low, c_high, c_low = support >= high, support <= low, contradiction >= high, contradiction <= low
    return F.when(s_high & c_high, "conflicting").when(s_high & c_low, "supported").when(c_high & s_low, "contradicted").when(s_low & c_low, "unsupported").otherwise("inconclusive")


def answer_status(claims: DataFrame) -> DataFrame:
    """(answer_id, status): rejected with any negative claim; inconclusive with any claim that is
    not supported; else supported."""
    bad = F.col("status").isin("contradicted", "unsupported", "conflicting")
    return claims.groupBy("answer_id").agg(F.when(F.bool_or(bad), "rejected").when(F.every(F.col("status") == "supported"), "supported").otherwise("inconclusive").alias("status"))


def clauses(body: Column) -> Column:
    """Clauses between sentence ends, line ends and coordinating words."""
    return F.filter(F.transform(F.split(body, r"[.!?;\n]+|\s+(?:e|mas|porém|and|but)\s+"), F.trim), lambda x: x != "")


def false_absence(answer: Column) -> Column:
    """Whether the answer says that something does not exist, negated forms aside."""
    left = F.regexp_replace(F.lower(answer), r"(?:it is not true|nao e verdade) that [^.]*", "")
    return left.rlike(r"\b(?:does not exist|there is no|not available|nao existe|nao ha)\b")
