"""Ingestion: modules of texts, retrieval texts, chunk and section rows, and one source's run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexoria.functions.text import content_hash, folded

from . import lifecycle, markdown, preservation

#: Characters of a section that its retrieval text quotes, and that its module is inferred from.
EXCERPT, MODULE_TEXT = 900, 800
#: Values of an entity kind that a retrieval text names.
ENTITY_VALUES = 8
ENTITY_LABELS = {"tables": "Tabelas", "parameters": "Parametros", "endpoints": "Endpoints", "statuses": "Status", "error_terms": "Termos"}


def infer_module(filename: Column, title: Column, source: Column, doc_type: Column, by_name: list[tuple[str, str]], by_word: list[tuple[str, str]], sql_module: str = "sql", default: str = "geral") -> Column:
    """The module of the first hint contained in the names, folded; else that of SQL files; else of
    the first hint that stands there as whole words. Hints: (text, module) in order."""
    joined = folded(F.concat_ws(" ", filename, title, source, doc_type))
    padded = F.concat(F.lit(" "), joined, F.lit(" "))
    out = F.lit(default)
    for hint, module in reversed(by_word):
        out = F.when(padded.contains(f" {hint} "), module).otherwise(out)
    out = F.when(F.lower(doc_type) == "sql", sql_module).otherwise(out)
    for hint, module in reversed(by_name):
        out = F.when(joined.contains(hint), module).otherwise(out)
    return out


def section_module(base: Column, heading_path: Column, content: Column, by_name: list[tuple[str, str]], by_word: list[tuple[str, str]], default: str = "geral") -> Column:
    """The module that a section's heading and beginning tell, else its document's."""
    own = infer_module(F.lit(""), heading_path, F.left(content, F.lit(MODULE_TEXT)), F.lit("md"), by_name, by_word, default=default)
    return F.when(own != default, own).otherwise(F.coalesce(F.nullif(base, F.lit("")), F.lit(default)))


def entity_lines(entities: dict[str, Column]) -> list[Column]:
    """A line ``label: values`` for each kind with values; null without."""
    lines = []
    for kind, label in ENTITY_LABELS.items():
        if kind in entities:
            clean = F.slice(F.filter(F.transform(entities[kind], lambda x: F.trim(x)), lambda x: x != ""), 1, ENTITY_VALUES)
            lines.append(F.when(F.size(clean) > 0, F.concat(F.lit(label + ": "), F.array_join(clean, ", "))))
    return lines


def excerpt(content: Column, length: int = EXCERPT) -> Column:
    """One line of at most ``length`` characters, cut at a space and marked where it goes on."""
    line = F.trim(F.regexp_replace(F.coalesce(content, F.lit("")), r"\s+", " "))
    head = F.left(line, F.lit(length))
    return F.when(F.length(line) > length, F.concat(F.trim(F.regexp_replace(head, r" [^ ]*$", "")), F.lit("..."))).otherwise(line)


def section_retrieval_text(doc_title: Column, heading_path: Column, module: Column, answer_mode: Column, context: Column, entities: dict[str, Column], content: Column) -> Column:
    """What a section is searched by: labelled lines, its entities and an excerpt."""
    short = excerpt(content)
    labelled = [F.concat(F.lit(label), F.coalesce(x, F.lit(""))) for label, x in (("Documento: ", doc_title), ("Secao: ", heading_path), ("Modulo: ", module), ("Modo de resposta: ", answer_mode))]
    quoted = F.when(short != "", F.concat(F.lit("Trecho da secao: "), short))
    return F.concat_ws("\n", *labelled, F.nullif(F.trim(context), F.lit("")), *entity_lines(entities), quoted)


def chunk_retrieval_text(context: Column, chunk: Column) -> Column:
    """What a chunk is embedded as: its context, a blank line, the chunk."""
    return F.when(F.trim(F.coalesce(context, F.lit(""))) != "", F.concat(context, F.lit("\n\n"), chunk)).otherwise(chunk)


def processing_hash(**parts: Column) -> Column:
    """Equal while nothing changes that chunks or vectors are made from."""
    return preservation.canonical_hash(**parts)


def chunk_rows(documents: DataFrame, context: Column | None = None) -> DataFrame:
    """(doc_id, chunk_index, content, retrieval_text, content_hash, token_count, n_chunks) of texts
    (doc_id, text). ``context`` is an expression over the documents' columns."""
    made = markdown.chunks(documents.select("doc_id", "text"))
    named = made.withColumn("context", F.lit("")) if context is None else made.join(documents.select("doc_id", context.alias("context")), "doc_id")
    return named.select("doc_id", "chunk_index", "content", chunk_retrieval_text(F.col("context"), F.col("content")).alias("retrieval_text"), content_hash(F.col("content")).alias("content_hash"), "token_count", "n_chunks")


def ingest_documents(incoming: DataFrame, existing: DataFrame, existing_chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) after a run over ``incoming`` (doc_id, filename, title, doc_type, text).

    existing: (filename, processing_hash, created_at); existing_chunks: (filename, chunk_index,
    content, embedding). documents: incoming's name, hash and action, skip, reuse or embed. chunks:
    of the documents that are not skipped; a reused document takes over its donor's vectors, the
    vectors of others are null and wait for the embedding call.
    """
    named = incoming.withColumn("processing_hash", processing_hash(content=content_hash(F.col("text")), title=F.col("title"), doc_type=F.col("doc_type")))
    plan = lifecycle.plan_ingest(named.select("filename", "processing_hash"), existing)
    documents = named.select("doc_id", "filename", "processing_hash").join(plan, "filename")
    fresh = chunk_rows(incoming.join(plan.filter("action = 'embed'").select("filename"), "filename", "left_semi"))
    embed = fresh.join(incoming.select("doc_id", "filename"), "doc_id").select("filename", "chunk_index", "content", F.lit(None).cast(existing_chunks.schema["embedding"].dataType).alias("embedding"))
    donated = plan.filter("action = 'reuse'").select("filename", F.col("reuse_from").alias("donor")).join(existing_chunks.withColumnRenamed("filename", "donor"), "donor")
    return documents, embed.unionByName(donated.select("filename", "chunk_index", "content", "embedding"))
