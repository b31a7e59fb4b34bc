"""Lexical search: a web-style query language over token sequences.

Terms are joined by AND; a quoted phrase asks for its words in a row; ``or`` separates
alternatives; a leading minus excludes. A blank query finds nothing. The score is the number of
occurrences of the asked words and phrases over 1 + ln(tokens).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexoria.functions.text import FOLD, words


def parse_query(text: str | None) -> list[list[tuple[bool, str]]]:
    """Alternatives of (wanted, space-joined words)."""
    groups: list[list[tuple[bool, str]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', text or ""):
        if not minus and not phrase and word.lower() == "or":
            groups.append([])
            continue
        tokens = re.findall("[a-z0-9]+", (phrase or word).lower().translate(FOLD))
        if tokens:
            groups[-1].append((not minus, " ".join(tokens)))
    return [g for g in groups if any(wanted for wanted, _ in g)]


def _spaced(tokens: Column) -> Column:
    """Tokens as one text in which each has spaces of its own around it."""
    return F.concat(F.lit(" "), F.array_join(tokens, "  "), F.lit(" "))


def _needle(term: str) -> str:
    return " " + "  ".join(term.split()) + " "


def matches(tokens: Column, parsed: list[list[tuple[bool, str]]]) -> Column:
    out = F.lit(False)
    for group in parsed:
        ok = F.lit(True)
        for wanted, term in group:
            has = tokens.contains(_needle(term))
            ok = ok & (has if wanted else ~has)
        out = out | ok
    return out


def score(tokens: Column, n_tokens: Column, parsed: list[list[tuple[bool, str]]]) -> Column:
    total = F.lit(0)
    for term in sorted({t for g in parsed for wanted, t in g if wanted}):
        needle = _needle(term)
        total = total + (F.length(tokens) - F.length(F.replace(tokens, F.lit(needle), F.lit("")))) / F.lit(len(needle))
    return total / (1 + F.log(n_tokens.cast("double")))


def tokenised(corpus: DataFrame, content: str = "content") -> DataFrame:
    """The corpus with the tokens of each row, made once a row: what a generator yields is not
    computed again in each place that uses it."""
    listed = corpus.withColumn("_words", F.explode(F.array(words(F.col(content)))))
    return listed.withColumn("_tokens", F.explode(F.array(_spaced(F.col("_words"))))).withColumn("_n", F.size("_words")).drop("_words")


def lexical_matches(rows: DataFrame, asked: list[tuple[int, str]]) -> DataFrame:
    """``rows`` (with query_id, of a tokenised corpus) that match their query's text, with
    lexical_score. ``asked`` holds the texts of a batch; each becomes one predicate."""
    named = rows
    hit, value = F.lit(False), F.lit(None).cast("double")
    for query_id, text in asked:
        parsed = parse_query(text)
        if parsed:
            mine = F.col("query_id") == query_id
            hit = F.when(mine, matches(F.col("_tokens"), parsed)).otherwise(hit)
            value = F.when(mine, score(F.col("_tokens"), F.col("_n"), parsed)).otherwise(value)
    return named.filter(hit).withColumn("lexical_score", value).drop("_n", "_tokens")
