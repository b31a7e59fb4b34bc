"""Question routing: abbreviations, intents, modules, answer modes, taxonomy counts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexoria.functions.text import folded
from lexoria.functions.vocabulary import ANSWER_MODE_TERMS, INTENT_PRIORITY, QUERY_ABBREVIATIONS

from .bounds import small

#: Keywords of all labels at most: every question is held against each.
MOST_KEYWORDS = 4_096


def expand_abbreviations(query: Column, table: dict[str, str] = QUERY_ABBREVIATIONS) -> Column:
    """The question with the long form after each whole-word abbreviation, in place, whatever its
    case: entry by entry, each on what the ones before have made. Runs of spaces become one; a
    question of spaces alone stays."""
    out = query
    for short, long in table.items():
        out = F.regexp_replace(out, rf"(?iU)\b{re.escape(short)}\b", f"$0 {long}")
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(out, r"(?U)\s+", " ")), F.lit("")), query)


def keyword_hits(questions: DataFrame, keywords: DataFrame, text: str = "query_text") -> DataFrame:
    """(query_id, label, hits): distinct keywords of each label that stand in the folded question as
    whole words. keywords: (label, keyword), a small table."""
    named = small(keywords.select("label", folded(F.col("keyword")).alias("keyword")).distinct(), MOST_KEYWORDS, "keywords")
    padded = questions.select("query_id", F.concat(F.lit(" "), folded(F.col(text)), F.lit(" ")).alias("_t"))
    return padded.join(named, F.col("_t").contains(F.concat(F.lit(" "), "keyword", F.lit(" ")))).groupBy("query_id", "label").agg(F.count("*").alias("hits"))


def classify_intent(questions: DataFrame, keywords: DataFrame, text: str = "query_text", priority: list[str] = INTENT_PRIORITY) -> DataFrame:
    """(query_id, intent): the label with most keyword hits, ties by priority; general without hits."""
    order = F.element_at(F.create_map(*[F.lit(x) for i, p in enumerate(priority) for x in (p, i)]), F.col("label"))
    best = keyword_hits(questions, keywords, text).groupBy("query_id").agg(F.max_by("label", F.struct("hits", -order)).alias("intent"))
    return questions.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("intent", F.lit("general")).alias("intent"))


def answer_mode(text: Column, heading: Column | None = None) -> Column:
    """The first mode of which a term occurs anywhere in the folded heading and text."""
    t = folded(F.concat_ws("\n", heading, text) if heading is not None else text)
    out = None
    for mode, terms in ANSWER_MODE_TERMS:
        hit = F.lit(False)
        for term in terms:
            hit = hit | t.contains(term)
        out = F.when(hit, mode) if out is None else out.when(hit, mode)
    return out.otherwise("general")


def semantic_context(title: Column, heading: Column, module: Column, mode: Column) -> Column:
    """Labelled parts that are worth naming, joined by bars."""
    part = lambda label, c, skip: F.when((c != "") & ~c.isin(*skip), F.concat(F.lit(label + ": "), c))
    return F.concat_ws(" | ", part("Documento", title, [""]), part("Secao", heading, [""]), part("Modulo", module, ["geral"]), part("Modo de resposta", mode, ["general"]))


def section_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(document_id, sections, changed_modules, changed_modes) of two classifications of sections."""
    j = before.join(after.select("document_id", "section_index", F.col("module").alias("m"), F.col("answer_mode").alias("a")), ["document_id", "section_index"])
    return j.groupBy("document_id").agg(F.count("*").alias("sections"), F.count_if(F.col("module") != F.col("m")).alias("changed_modules"), F.count_if(F.col("answer_mode") != F.col("a")).alias("changed_modes"))
