"""What a corpus, a batch of results and a set of answers hold: counts, lists and gates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexoria.functions import text as tx


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of rows of each named table."""
    out = None
    for name, table in tables.items():
        one = table.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)  # single rows
    return out


def published_only(rows: DataFrame, manifest: DataFrame, key: str = "doc_id", content_hash: str | None = None) -> DataFrame:
    """The rows that a manifest lists, by key and, where a hash column is named, by an equal hash."""
    on = [key] if content_hash is None else [key, content_hash]
    return rows.join(manifest.select(*on), on, "left_semi")


def corpus_inventory(documents: DataFrame, by: str = "lang", long_chars: int = 2_000) -> DataFrame:
    """(by, n, long, with_tables, sources) of documents (n_chars, text, source)."""
    return documents.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > long_chars).alias("long"), F.count_if(F.col("text").contains("|")).alias("with_tables"), F.countDistinct("source").alias("sources"))


def token_index(documents: DataFrame, pattern: str = "[a-z]{3,}", least: int = 1, key: str = "doc_id", group: str = "lang") -> DataFrame:
    """(token, n, langs, first_doc): how many documents hold a token, the groups they are of, and
    the first of them; tokens in fewer than ``least`` documents leave."""
    each = documents.select(key, group, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0)))).alias("token"))
    found = each.groupBy("token").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(group)), ",").alias("langs"), F.min(key).alias("first_doc"))
    return found.filter(F.col("n") >= least)


def keyword_top(documents: DataFrame, k: int = 12, pattern: str = "[a-z]{3,}", group: str = "lang", only: list[str] | None = None) -> DataFrame:
    """(group, token, n, place): the k most frequent tokens of each group, of a fixed list if given."""
    tokens = documents.select(group, F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))).alias("token"))
    if only is not None:
        tokens = tokens.filter(F.col("token").isin(*only))
    summed = tokens.groupBy(group, "token").agg(F.count("*").alias("n"))
    w = Window.partitionBy(group).orderBy(F.col("n").desc(), "token")
    return summed.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def has_facts(answer: Column, facts: Iterable[Iterable[str]]) -> Column:
    """Whether every fact has one of its accepted phrases in the answer; null without facts."""
    every = None
    for phrases in facts:
        one = F.lit(False)
        for p in phrases:
            one = one | answer.contains(p)
        every = one if every is None else every & one
    return F.lit(None).cast("boolean") if every is None else every


def forbidden_found(answer: Column, phrases: Iterable[str]) -> Column:
    """The forbidden phrases that an answer holds."""
    return F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: answer.contains(p))


def scope_counts(chunks: DataFrame) -> DataFrame:
    """(query_id, routing_scope, n) of the chunks that have a scope."""
    return chunks.filter("routing_scope IS NOT NULL").groupBy("query_id", "routing_scope").agg(F.count("*").alias("n"))


def prompt_token_parts(turns: DataFrame, key: str = "conv_id", overhead: int = 4) -> DataFrame:
    """(key, history_tokens, user_tokens, turns): estimated tokens of a conversation's messages, each
    with its overhead, and of what the user wrote."""
    n = tx.estimated_tokens(F.col("text"))
    return turns.groupBy(key).agg(F.sum(n + overhead).alias("history_tokens"), F.sum(F.when(F.col("role") == "user", n).otherwise(F.lit(0))).alias("user_tokens"), F.count("*").alias("turns"))


def run_report(results: DataFrame, expected: int) -> DataFrame:
    """One row on an ingest run: documents succeeded, skipped and failed, chunks made and failed, the
    kinds of errors with their counts, and whether all that was expected is there.

    results: (error, error_type, skipped, chunks_count, failed_chunks)."""
    failed = F.coalesce(F.col("error") != "", F.lit(False))
    skipped = F.coalesce(F.col("skipped"), F.lit(False))
    kinds = results.filter(failed).groupBy(F.coalesce(F.nullif("error_type", F.lit("")), F.lit("ingestion_error")).alias("kind")).agg(F.count("*").alias("n"))
    errors = kinds.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "kind", "n"))), ",").alias("error_types"))
    total = results.agg(
        F.count("*").alias("returned"), F.count_if(~failed & ~skipped).alias("succeeded"), F.count_if(skipped).alias("skipped"), F.count_if(failed).alias("failed"),
        F.coalesce(F.sum("chunks_count"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("failed_chunks"), F.lit(0)).alias("failed_chunks"),
    )
    complete = (F.col("succeeded") == expected) & (F.col("returned") == expected) & (F.col("skipped") + F.col("failed") + F.col("failed_chunks") == 0)
    return total.crossJoin(errors).withColumn("expected", F.lit(expected).cast("long")).withColumn("complete", complete)  # single rows


def gate_reasons(checks: DataFrame) -> DataFrame:
    """(status, reason, n): why rules did not pass. checks: (rule, status, critical)."""
    reason = F.when(F.col("status") == "passed", "passed").when(F.col("status") == "incomplete", "value_missing").when(F.col("critical"), "critical_rule_failed").otherwise("rule_failed")
    return checks.groupBy("status", reason.alias("reason")).agg(F.count("*").alias("n"))


def unit_coverage(units: DataFrame, cases: DataFrame) -> DataFrame:
    """(unit_id, batch_id, cases, answerabilities, covered): the evaluation cases of each migrated
    unit; covered means at least one answerable and one that is not. units: (unit_id, batch_id);
    cases: (unit_id, batch_id, answerability)."""
    per = cases.groupBy("unit_id", "batch_id").agg(F.count("*").alias("cases"), F.array_join(F.array_sort(F.collect_set("answerability")), ",").alias("answerabilities"), F.count_if(F.col("answerability") == "answerable").alias("yes"))
    j = units.join(per, ["unit_id", "batch_id"], "left")
    n = F.coalesce("cases", F.lit(0))
    return j.select("unit_id", "batch_id", n.alias("cases"), F.coalesce("answerabilities", F.lit("")).alias("answerabilities"), ((F.coalesce("yes", F.lit(0)) > 0) & (n > F.coalesce("yes", F.lit(0)))).alias("covered"))
