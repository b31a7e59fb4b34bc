"""Vector arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """1 - cosine distance; null for a zero vector."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def clean_vector(a: Column, dimensions: int) -> Column:
    """Non-finite components become 0; another dimension than the index's is an error, never
    padded or cut."""
    finite = F.transform(a, lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x.cast("double")))
    return F.when(F.size(a) == dimensions, finite).otherwise(F.raise_error(F.concat(F.lit("vector dimension is "), F.size(a).cast("string"), F.lit(f", not {dimensions}"))))


def safe_number(value: Column) -> Column:
    """A finite double, or 0 where the value is missing, not a number or not finite."""
    x = value.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def vector_literal(a: Column) -> Column:
    """A vector as text, ``[a,b,...]``."""
    return F.concat(F.lit("["), F.array_join(a.cast("array<string>"), ","), F.lit("]"))
