"""Packing of context: budgets, history, consecutive blocks, entity lists."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexoria.functions.text import folded

from lexoria.functions.text import estimated_tokens


def greedy_fit(rows: DataFrame, group: str, order: list, cost: str, budget: int) -> DataFrame:
    """Rows in order as long as they fit; one that does not fit is skipped and later, smaller ones
    are still tried. The fold runs over each group's sorted costs, inside the JVM; groups are
    conversations or questions, whose size is bounded by what a prompt can name."""
    w = Window.partitionBy(group).orderBy(*order)
    ranked = rows.withColumn("_i", F.row_number().over(w))
    item = F.struct(F.col("_i").alias("i"), F.col(cost).cast("long").alias("c"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))
    step = lambda a, x: F.when(a["used"] + x["c"] <= budget, F.struct((a["used"] + x["c"]).alias("used"), F.concat(a["kept"], F.array(x["i"])).alias("kept"))).otherwise(a)
    kept = ranked.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("items")).select(group, F.explode(F.aggregate("items", start, step, lambda a: a["kept"])).alias("_i"))
    return ranked.join(kept, [group, "_i"]).drop("_i")


def select_history(turns: DataFrame, max_tokens: int = 4_000) -> DataFrame:
    """The messages of each conversation that fit, tried newest first; each costs its tokens + 4."""
    cost = turns.withColumn("tokens", estimated_tokens(F.col("text")) + 4)
    return greedy_fit(cost, "conv_id", [F.col("turn").desc()], "tokens", max_tokens)


def last_messages(turns: DataFrame, pairs: int = 20) -> DataFrame:
    """The last 2 * pairs messages of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return turns.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= 2 * pairs).drop("_n")


def select_context(rows: DataFrame, budget: int, max_chunks: int = 8, order: str = "position") -> DataFrame:
    """Rows in rank order while the rendered evidence (tokens + 4 a record) fits the budget; at most
    max_chunks of them."""
    cost = rows.withColumn("tokens", estimated_tokens(F.col("content")) + 4)
    kept = greedy_fit(cost, "query_id", [F.col(order)], "tokens", budget)
    w = Window.partitionBy("query_id").orderBy(order)
    return kept.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= max_chunks).drop("_n")


def consecutive_blocks(rows: DataFrame) -> DataFrame:
    """(query_id, document_id, section_id, block, first_index, last_index, n): runs of chunks whose
    index follows the one before in the same document and section (gaps and islands)."""
    w = Window.partitionBy("query_id", "document_id", "section_id").orderBy("chunk_index")
    new = (F.col("chunk_index") != F.lag("chunk_index").over(w) + 1) | F.lag("chunk_index").over(w).isNull()
    marked = rows.withColumn("block", F.sum(new.cast("int")).over(w))
    return marked.groupBy("query_id", "document_id", "section_id", "block").agg(F.min("chunk_index").alias("first_index"), F.max("chunk_index").alias("last_index"), F.count("*").alias("n"))


def overlap(previous: str, current: str, most: int, least: int = 40) -> int:
    """Length of the longest end of ``previous`` that begins ``current``, if within the bounds."""
    for n in range(min(most, len(previous), len(current)), least - 1, -1):
        if previous.endswith(current[:n]):
            return n
    return 0


def merge_chunks(rows: DataFrame, most_overlap: int = 300) -> DataFrame:
    """(document_id, content): each document's chunks in order, joined by a blank line, with what
    the end of one repeats cut from the next."""

    def merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for chunks in pdf["parts"]:
                text, before = [], ""
                for c in chunks:
                    content = c["content"] or ""
                    text.append(content[overlap(before, content, most_overlap) :])
                    before = content
                out.append("\n\n".join(t.strip() for t in text if t.strip()))
            yield pd.DataFrame({"document_id": pdf["document_id"], "content": out})

    grouped = rows.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("parts"))
    return grouped.mapInPandas(merge, "document_id long, content string")


def merge_entities(rows: DataFrame, soft_cap: int = 12) -> DataFrame:
    """(query_id, label, value, place): distinct values in order of occurrence, trimmed; values are
    equal that fold to the same letters and digits, and those that fold to none leave. rows: (query_id,
    label, value, chunk_place, value_place). The cap is soft: once reached, each later chunk may
    still add its first new value."""
    key = folded(F.col("value"))
    rows = rows.withColumn("value", F.trim("value")).filter(F.coalesce(key != "", F.lit(False)))
    first = Window.partitionBy("query_id", "label", key).orderBy("chunk_place", "value_place")
    new = rows.withColumn("_f", F.row_number().over(first)).filter("_f = 1").drop("_f")
    whole = Window.partitionBy("query_id", "label").orderBy("chunk_place", "value_place")
    chunk = Window.partitionBy("query_id", "label", "chunk_place").orderBy("value_place")
    ranked = new.withColumn("_all", F.row_number().over(whole)).withColumn("_in", F.row_number().over(chunk))
    kept = ranked.filter((F.col("_all") <= soft_cap) | (F.col("_in") == 1))
    return kept.withColumn("place", F.row_number().over(whole)).drop("_all", "_in")
