"""Contracts of canonical documents and of their manifest, images, and what old documents lack."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .markdown import fence_left_open, split_sections

IMAGE = r"!\[[^\]]*\]\(([^)]+)\)"
#: Beyond these sizes a document should be split.
MOST_BYTES, MOST_LINES, MOST_TITLES = 100_000, 2_000, 3


@dataclass(frozen=True)
class Vocabulary:
    """The values that documents may use; a contract file of some hundred entries."""

    version: str
    products: tuple[str, ...]
    modules: tuple[str, ...]
    answer_modes: tuple[str, ...]
    erp_systems: tuple[str, ...]


def _repeated(rows: DataFrame, column: str) -> DataFrame:
    found = rows.groupBy(F.col(column).alias("subject")).agg(F.count("*").alias("n")).filter("n > 1")
    return found.select("subject", F.lit(f"duplicate_{column}").alias("problem"))


def manifest_problems(batches: DataFrame, entries: DataFrame) -> DataFrame:
    """(subject, problem): repeated batches, paths and document ids (blank ones aside), and by path
    the entries of unknown batches and those with a successor that is no canonical document.

    batches: (batch_id); entries: (path, document_id, format, batch_id, successors array).
    """
    named = entries.filter("document_id <> ''")
    canonical = named.filter("format = 'canonical'").select("document_id").distinct()
    next_ones = entries.select("path", F.explode("successors").alias("document_id")).distinct()
    lost = entries.join(batches.select("batch_id").distinct(), "batch_id", "left_anti")
    loose = next_ones.join(canonical, "document_id", "left_anti").select("path").distinct()
    parts = [
        _repeated(batches, "batch_id"), _repeated(entries, "path"), _repeated(named, "document_id"),
        lost.select(F.col("path").alias("subject"), F.lit("unknown_batch").alias("problem")),
        loose.select(F.col("path").alias("subject"), F.lit("unresolved_successor").alias("problem")),
    ]
    return reduce(DataFrame.unionByName, parts)


def _outside(values: Column, allowed: tuple[str, ...]) -> Column:
    return F.exists(F.coalesce(values, F.array().cast("array<string>")), lambda x: ~F.coalesce(x.isin(*allowed), F.lit(False)))


def document_problems(documents: DataFrame, words: Vocabulary) -> DataFrame:
    """(document_id, problems): the fields that break the contract, in a fixed order.

    documents: (document_id, source_ids array, taxonomy_version, primary_module, secondary_modules
    array, answer_mode, products array, erp_systems array, version_products array, sections array of
    (key, products array, modules array, answer_mode, refs array of (source_id, kind, first, last))).
    Nulls in a list count as unknown values, null lists as empty ones.
    """
    none = F.array().cast("array<string>")
    declared = F.coalesce(F.col("products"), none)
    sources = F.coalesce(F.col("source_ids"), none)
    of_sections = lambda test: F.coalesce(F.exists("sections", test), F.lit(False))
    ranges = ("line_range", "page_range")
    unknown_ref = lambda r: ~F.coalesce(F.array_contains(sources, r["source_id"]), F.lit(False))
    backwards = lambda r: F.coalesce(r["kind"].isin(*ranges) & (r["last"] < r["first"]), F.lit(False))
    tests = {
        "sources": F.size(F.array_distinct(sources)) < F.size(sources),
        "taxonomy_version": ~F.col("taxonomy_version").eqNullSafe(F.lit(words.version)),
        "products": _outside(declared, words.products),
        "modules": _outside(F.concat(F.array("primary_module"), F.coalesce("secondary_modules", none)), words.modules),
        "answer_mode": _outside(F.array("answer_mode"), words.answer_modes),
        "erp_systems": _outside(F.col("erp_systems"), words.erp_systems),
        "product_versions": F.size(F.array_except(F.coalesce("version_products", none), declared)) > 0,
        "section_products": of_sections(lambda s: _outside(s["products"], words.products)),
        "section_modules": of_sections(lambda s: _outside(s["modules"], words.modules)),
        "section_answer_mode": of_sections(lambda s: s["answer_mode"].isNotNull() & _outside(F.array(s["answer_mode"]), words.answer_modes)),
        "section_sources": of_sections(lambda s: F.coalesce(F.exists(s["refs"], unknown_ref), F.lit(False))),
        "section_ranges": of_sections(lambda s: F.coalesce(F.exists(s["refs"], backwards), F.lit(False))),
    }
    return documents.select("document_id", F.array_compact(F.array(*[F.when(test, name) for name, test in tests.items()])).alias("problems"))


def local_images(text: Column, path: Column) -> Column:
    """The paths of the images a text shows from its own tree, resolved against the text's path;
    null in place of one that leaves the tree. Addresses with a scheme or host, and bare anchors and
    queries, are left out."""
    address = lambda x: F.regexp_replace(F.regexp_extract(x, r"^\s*(\S+)", 1), "^<+|>+$", "")
    file = lambda x: F.regexp_extract(x, r"^([^?#]*)", 1)
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IMAGE), F.lit(1)), address)
    local = F.transform(F.filter(found, lambda x: ~x.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)") & (file(x) != "")), file)
    folder = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)

    def resolved(x: Column) -> Column:
        plain = F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)
        whole = F.when(plain.startswith("/"), plain).otherwise(F.concat(folder, plain))
        steps = F.filter(F.split(whole, "/"), lambda s: ~s.isin("", "."))
        walk = F.aggregate(
            steps, F.array().cast("array<string>"),
            lambda a, s: F.when((s == "..") & (F.size(a) > 0) & ~F.coalesce(F.try_element_at(a, F.lit(-1)) == "..", F.lit(False)), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))),
        )
        out = F.array_join(walk, "/")
        return F.when(~whole.startswith("/") & ~out.rlike(r"^\.\.(/|$)|[\\:]") & (out != ""), out)

    return F.transform(local, resolved)


def legacy_diagnostics(docs: DataFrame, files: DataFrame) -> DataFrame:
    """(path, code, line, detail) of documents without a contract, none of them an error: fence-unclosed,
    title-missing, multiple-h1, heading-level-jump, document-heterogeneous, visual-source-missing.

    docs: (path, text); files: (path) of all that exists. line is null for findings about a whole
    document; detail holds the levels of a jump, the number of titles or lines, or the image.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(path, *x) for path, text in zip(pdf["path"], pdf["text"], strict=True) for x in _lacks(text or "")]
            yield pd.DataFrame(rows, columns=["path", "code", "line", "detail"]).astype({"line": "Int64"})

    found = docs.select("path", "text").mapInPandas(run, "path string, code string, line long, detail string")
    shown = F.get(local_images(F.concat(F.lit("![]("), "detail", F.lit(")")), F.col("path")), F.lit(0))
    images = docs.select("path", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(IMAGE), F.lit(1))).alias("at", "detail"))
    images = images.withColumn("image", shown).filter(~F.trim("detail").rlike(r"(?i)^<?(?:https?:|data:|#|//)"))
    there = files.select(F.col("path").alias("image")).distinct()
    gone = images.join(there, "image", "left_anti").select("path", F.lit("visual-source-missing").alias("code"), F.lit(None).cast("long").alias("line"), "detail")
    return found.unionByName(gone)


def _lacks(text: str) -> Iterator[tuple[str, int | None, str]]:
    heads = [(s.level, s.line) for s in split_sections(text) if s.level]
    titles = sum(level == 1 for level, _ in heads)
    if line := fence_left_open(text):
        yield "fence-unclosed", line, ""
    if titles != 1:
        yield ("multiple-h1" if titles else "title-missing"), None, str(titles)
    for (before, _), (level, line) in zip(heads, heads[1:]):
        if level > before + 1:
            yield "heading-level-jump", line, f"{before}>{level}"
    lines = len(re.findall("\n", text)) + 1
    if len(text.encode("utf-8")) > MOST_BYTES or lines > MOST_LINES or titles > MOST_TITLES:
        yield "document-heterogeneous", None, str(lines)


def provenance(chunks: DataFrame) -> DataFrame:
    """chunks with canonical_id, document_revision, schema_version and section_key taken from the map
    ``metadata`` where the column itself is null or empty, and locator, if null, from the first of
    source_refs."""
    named = ("canonical_id", "document_revision", "schema_version", "section_key")
    filled = {c: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.col("metadata")[c]) for c in named}
    return chunks.withColumns(filled | {"locator": F.coalesce("locator", F.get("source_refs", F.lit(0))["locator"])})


def rules_chunk(text: Column, source: Column) -> Column:
    """A loaded body of rules as a row of evidence, named by the hash of its content."""
    digest = F.sha2(text, 256)
    return F.struct(
        F.concat(F.lit("business-rules:"), digest).alias("id"), F.concat(F.lit("business-rules:"), source).alias("document_id"), source.alias("filename"),
        text.alias("content"), F.lit(0).alias("chunk_index"), F.lit("business_rules").alias("retrieval_origin"), digest.alias("content_hash"),
    )


def run_totals(results: DataFrame, expected: int) -> DataFrame:
    """One row: how many documents of an ingestion run came back, succeeded, were skipped or failed,
    their chunks, the count of each error type, and whether the run is complete.

    results: (error, error_type, skipped boolean, chunks, failed_chunks); an error may be skipped, too.
    """
    failed, skipped = F.coalesce(F.col("error") != "", F.lit(False)), F.coalesce("skipped", F.lit(False))
    kinds = results.filter(failed).groupBy(F.coalesce(F.when(F.col("error_type") != "", F.col("error_type")), F.lit("ingestion_error")).alias("k")).agg(F.count("*").alias("n"))
    kinds = kinds.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("error_types"))  # one entry a kind
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sums = results.agg(
        F.count("*").alias("returned"), F.count_if(~failed & ~skipped).alias("succeeded"), F.count_if(skipped).alias("skipped"),
        F.count_if(failed).alias("failed"), total("chunks").alias("chunks"), total("failed_chunks").alias("failed_chunks"),
    )
    whole = (F.col("succeeded") == expected) & (F.col("returned") == expected) & (F.col("skipped") == 0) & (F.col("failed") == 0) & (F.col("failed_chunks") == 0)
    return sums.withColumn("expected", F.lit(expected).cast("long")).withColumn("complete", whole).join(kinds)
