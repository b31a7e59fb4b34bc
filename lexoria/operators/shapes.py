"""Records that come in several JSON shapes, brought to one: selectors of evidence, and the contexts
that a model has written for chunks. Both go through the variant type, value by value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexoria.functions.text import json_fragment

_NONE = "array<string>"


def kind_of(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID or NUMBER of a variant; null for no value."""
    schema = F.schema_of_variant(v)
    plain = F.regexp_extract(schema, "^[A-Z]+", 0)
    return F.when(plain.isin("OBJECT", "ARRAY", "STRING", "BOOLEAN", "VOID"), plain).when(plain != "", "NUMBER")


def plain_text(v: Column) -> Column:
    """A value as trimmed text: strings as they are, none and null as empty, others as JSON."""
    return F.coalesce(F.trim(F.when(kind_of(v) == "STRING", F.try_variant_get(v, "$", "string")).when(kind_of(v) != "VOID", F.to_json(v))), F.lit(""))


def _items(rows: DataFrame, v: str) -> DataFrame:
    """``rows`` with pos, key and value of each entry of a variant array or object."""
    return rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col(v).outer()))


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column that is made once a row: what a generator yields is not computed again
    wherever it is named."""
    return rows.withColumn(name, F.explode(F.array(value)))


def _field(v: str, name: str) -> Column:
    return F.try_variant_get(F.col(v), f"$.{name}", "variant")


def _present(v: str, name: str) -> Column:
    """A field's text where it is worth naming: empty for none, null, false, zero and empty ones."""
    x = _field(v, name)
    nothing = F.coalesce(F.to_json(x).isin("false", "0", "0.0", "[]", "{}"), F.lit(False))
    return F.when(nothing, F.lit("")).otherwise(plain_text(x))


def evidence_specs(cases: DataFrame, id_col: str = "case_id", evidence: str = "reference_evidence") -> DataFrame:
    """(case_id, position, source, contains, canonical_id, document_revision, section_key, source_id,
    locator, problem) of the evidence that each case names, from JSON text.

    A string is a source; an object may have source, contains (a text or a list of texts), and
    selectors. Entries of other kinds, blank strings and objects that name no source, text or document
    are left out, and so are cases whose evidence is no JSON list. A malformed entry is a row with a
    ``problem``: a revision that is no positive integer (2.0 counts as 2), a locator that is no object, or selectors
    without canonical_id.
    """
    parsed = cases.select(F.col(id_col).alias("case_id"), F.try_parse_json(evidence).alias("v")).filter(kind_of(F.col("v")) == "ARRAY")
    item = _items(parsed, "v").select("case_id", F.col("pos").alias("position"), F.col("value").alias("i")).withColumn("kind", kind_of(F.col("i"))).filter(F.col("kind").isin("STRING", "OBJECT"))
    inside = F.col("kind") == "OBJECT"
    terms = _field("i", "contains")
    listed = F.transform(F.try_variant_get(terms, "$", "array<variant>"), plain_text)
    contains = F.when(kind_of(terms) == "STRING", F.array(plain_text(terms))).when(kind_of(terms) == "ARRAY", listed).otherwise(F.array().cast(_NONE))
    revision = F.coalesce(_field("i", "document_revision"), _field("i", "revision"))
    number = F.try_variant_get(revision, "$", "bigint")
    given = F.coalesce(kind_of(revision) != "VOID", F.lit(False))
    whole = F.coalesce((kind_of(revision) == "NUMBER") & F.to_json(revision).rlike("^[0-9]+$") & (number >= 1), F.lit(False))
    locator = _field("i", "locator")
    placed = F.coalesce(kind_of(locator) != "VOID", F.lit(False))
    text = lambda name: F.when(inside, _present("i", name)).otherwise(F.lit(""))
    made = item.select(
        "case_id", "position", F.when(inside, _present("i", "source")).otherwise(plain_text(F.col("i"))).alias("source"), F.when(inside, F.filter(contains, lambda x: x != "")).otherwise(F.array().cast(_NONE)).alias("contains"),
        text("canonical_id").alias("canonical_id"), F.when(inside & whole, number).alias("document_revision"), text("section_key").alias("section_key"), text("source_id").alias("source_id"),
        F.when(inside & (kind_of(locator) == "OBJECT"), F.to_json(locator)).alias("locator"), (inside & given).alias("_given"), (inside & given & ~whole).alias("_bad"), (inside & placed).alias("_placed"), (inside & placed & (kind_of(locator) != "OBJECT")).alias("_lost"),
    )
    selects = F.col("_given") | (F.col("section_key") != "") | (F.col("source_id") != "") | F.col("_placed")
    problem = F.when(F.col("_bad"), "document_revision").when(F.col("_lost"), "locator").when(selects & (F.col("canonical_id") == ""), "canonical_id")
    named = (F.col("source") != "") | (F.size("contains") > 0) | (F.col("canonical_id") != "")
    return made.withColumn("problem", problem).filter(F.col("problem").isNotNull() | named).drop("_given", "_bad", "_placed", "_lost")


#: Fields of an object that may hold a context, as they are looked for.
CONTEXT_FIELDS = ("context", "text", "texto", "summary", "value")


def _context(v: str) -> Column:
    """The text of a value: of an object that of its first filled field, else its JSON. Only objects
    have fields."""
    fields = F.array(*[_field(v, f) for f in CONTEXT_FIELDS])
    filled = F.filter(F.transform(fields, lambda x: F.when(kind_of(x) == "STRING", plain_text(x))), lambda x: x != "")
    return F.coalesce(F.get(filled, F.lit(0)), plain_text(F.col(v)))


def contextual_payload(replies: DataFrame, id_col: str = "doc_id", reply: str = "reply", expected: str = "expected") -> DataFrame:
    """(id, idx, context): the contexts in each model's reply, by chunk number below ``expected``.

    The reply's JSON is a list of texts, a list of objects with id (or chunk_id) and a text, an object
    with such a list under ``contexts``, or an object of numbers to texts. A list's item without a
    usable number has its place as number; of several for one number the last counts. Blank texts,
    numbers out of range and replies without JSON have no rows.
    """
    bare = _once(replies.select(F.col(id_col).alias("id"), F.col(expected).cast("long").alias("expected"), F.col(reply).alias("_reply")), "_json", json_fragment(F.col("_reply")))
    parsed = _once(bare.select("id", "expected", "_json"), "v", F.try_parse_json("_json")).drop("_json")
    inner = F.when((kind_of(F.col("v")) == "OBJECT") & (kind_of(_field("v", "contexts")) == "ARRAY"), _field("v", "contexts")).otherwise(F.col("v"))
    whole = _once(parsed, "w", inner).select("id", "expected", F.col("w").alias("v"))
    whole = _once(whole, "shape", kind_of(F.col("v"))).filter(F.col("shape").isin("OBJECT", "ARRAY"))
    items = _once(_items(whole, "v").select("id", "expected", "shape", "key", "value", F.col("pos").cast("long").alias("place")), "kind", kind_of(F.col("value")))
    number = lambda c: F.when(c.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(c).try_cast("long"))
    raw = F.coalesce(_field("value", "id"), _field("value", "chunk_id"))
    own = F.when(kind_of(raw) == "STRING", number(F.try_variant_get(raw, "$", "string"))).when(kind_of(raw) == "NUMBER", F.try_variant_get(raw, "$", "double").cast("long"))
    idx = F.when(F.col("shape") == "OBJECT", number(F.col("key"))).otherwise(F.coalesce(F.when(F.col("kind") == "OBJECT", own), F.col("place")))
    made = _once(_once(items, "idx", idx), "context", _context("value"))
    found = made.filter((F.col("context") != "") & (F.col("idx") >= 0) & (F.col("idx") < F.col("expected")))
    return found.groupBy("id", "idx").agg(F.max_by("context", "place").alias("context"))
