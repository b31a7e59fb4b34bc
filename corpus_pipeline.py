"""A training-corpus pipeline over ``documents``: five stages, each an operator of lexoria.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of docs. Stages handle empty tables, nulls in any column, repeated rows and further columns of any
names: inside a stage all columns but those it works on travel together as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexoria.llm import toxicity
from lexoria.llm.jaccard_join import near_duplicates
from lexoria.llm.merge_dropout import RESULTS, encode_documents
from lexoria.llm.mixing import mix_sources
from lexoria.llm.queries import MODEL_FILE
from lexoria.llm.runtime import Scratch, read
from lexoria.llm.secret_scans import RULES, findings_by_path, redact, scan

#: Documents with at least this calibrated score of toxicity go.
TOXIC = 0.3

_OWN = ("doc_id", "text", "source", "n_chars")


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, source and n_chars as far as docs has them, and all other columns as ``others``."""
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in _OWN]
    return docs.select(*[c for c in _OWN if c in docs.columns], F.struct(F.lit(0).alias("none"), *others).alias("others"))


def _unpacked(packed: DataFrame, docs: DataFrame) -> DataFrame:
    return packed.select(*[F.col(c) if c in _OWN else F.col(f"others.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents scored below TOXIC by their nearest labelled examples."""
    labels = read(spark, sf_dir, "labels").filter(~toxicity.held_out())
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    packed = _packed(docs)
    scored = toxicity.score(packed, model, keep=tuple(packed.columns))
    return _unpacked(scored.filter(F.col("score") < TOXIC), docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies; documents without an id stay.

    Rows that share an id are one document: the one of smallest text by code point stands for it,
    as in the join. Ties go to the smallest of the other columns as JSON.
    """
    packed = _packed(docs)
    groups = near_duplicates(docs.select("doc_id", "text"), count_links=False)
    stay = packed.join(groups.filter("doc_id = component_id").select("doc_id"), "doc_id", "left_semi")
    repeated = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1")
    if not repeated.isEmpty():  # else no text is shuffled again
        row = [c for c in packed.columns if c != "doc_id"]
        first = stay.groupBy("doc_id").agg(F.min_by(F.struct(*row), F.struct(F.coalesce("text", F.lit("")), F.to_json(F.struct(*row)))).alias("row"))
        stay = first.select("doc_id", "row.*")
    return _unpacked(stay.select(*packed.columns).unionByName(packed.filter("doc_id IS NULL")), docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found in their texts replaced by a mark, and n_chars, if
    there is one, in step."""
    _, findings = scan(docs.select("text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    suspect = F.lit(False)
    for rule in RULES:
        suspect = suspect | text.rlike(rule.pattern if rule.kind != "hex" else rf"[0-9a-f]{{{rule.least},}}")
    # Only texts in which a rule matches can have findings; the others need no join.
    packed = _packed(docs)
    hit = findings_by_path(packed.filter(suspect), findings, keep=tuple(packed.columns))
    cleaned = hit.withColumn("text", redact(F.col("text"), F.col("spans")))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return _unpacked(cleaned.drop("spans").unionByName(packed.filter(~suspect)), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it, always whole. Rows are taken one
    by one, whatever their ids."""
    packed = _packed(docs)
    carried = [c for c in packed.columns if c not in ("doc_id", "source")]
    mixed = mix_sources(packed, whole=True, carry=tuple(carried)).filter("copies > 0")
    return _unpacked(mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns but the text, and n_pieces, ids and lossless of each text, with merge-dropout.
    Where docs has a column of one of these names, the result's gets underscores after it.

    Rows of one id and text are copies 0, 1, ... and split each in its own way; the mix makes a few
    of a document. Rows without an id are split alike."""
    packed = _packed(docs)
    rest = F.to_json(F.struct(*[c for c in packed.columns if c not in ("doc_id", "text")]))
    same = Window.partitionBy("doc_id", F.sha2("text", 256)).orderBy(rest)
    named = packed.filter("doc_id IS NOT NULL").withColumn("copy", F.row_number().over(same) - 1)
    numbered = named.unionByName(packed.filter("doc_id IS NULL").withColumn("copy", F.lit(0)))
    taken = {c.lower() for c in docs.columns}
    results = []
    for name in RESULTS:
        while name in taken:
            name += "_"
        results.append(name)
    keep = tuple(c for c in packed.columns if c != "text")
    encoded = encode_documents(numbered, MODEL_FILE, dropout=0.1, seed=0, keep=keep, copy_col="copy")
    columns = [F.col(c) if c in _OWN else F.col(f"others.c{i}").alias(c) for i, c in enumerate(docs.columns) if c != "text"]
    return encoded.select(*columns, *[F.col(a).alias(b) for a, b in zip(RESULTS, results, strict=True)])


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("secret_scans", redact_secrets),
    ("source_mixing", mix),
    ("sentencepiece", encode),
]

#: The scores of the first stage are learnt, and the merges of the last are sequential: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each stage's rows are written to the shared folder and read
    again; what the next stage has read is deleted, and what the result reads when the session ends."""
    scratch = Scratch(spark)
    docs = read(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), at_exit=True)
        if before is not None:
            scratch.clear(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
