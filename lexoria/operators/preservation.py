"""What a migration keeps: lines and body of texts, ordered differences, canonical hashes, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexoria.functions import text as tx

_HEADING = r"^[ \t]{0,3}#{1,6}[ \t]+(.+)"
_ANCHOR = r"[ \t]+\{#[a-z][a-z0-9-]*\}[ \t]*$"


def normal_line(text: Column) -> Column:
    """Lower case, runs of spaces as one."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def body_lines(text: Column) -> Column:
    """The lines that are not blank, without spaces at their end; headings without their level and
    anchor."""
    return body_of(tx.lines(F.coalesce(text, F.lit(""))))


def body_of(lines: Column) -> Column:
    """body_lines of a text that is split into its lines."""
    lines = F.filter(lines, lambda x: F.trim(x) != "")
    title = lambda x: F.trim(F.regexp_replace(F.regexp_extract(x, _HEADING, 1), _ANCHOR, ""))
    return F.transform(lines, lambda x: F.when(x.rlike(_HEADING), F.concat(F.lit("heading: "), title(x))).otherwise(F.regexp_replace(x, r"\s+$", "")))


def missing_in_order(source: Column, target: Column) -> Column:
    """The source's items that one walk through the target does not meet: each is looked for behind
    the place of the last one found, and after one that is missing the walk is at its end. So one walk
    through the target counts how many of the first are met, and the rest is missing."""
    met = F.aggregate(target, F.lit(0), lambda n, x: F.when(F.get(source, n).eqNullSafe(x) & (n < F.size(source)), n + 1).otherwise(n))
    return F.slice(source, met + 1, F.size(source))


def canonical_hash(**parts: Column) -> Column:
    """SHA-256 of named values in the order of their names, nulls marked: equal for equal contents,
    whatever the order in which they are given."""
    return F.sha2(F.concat_ws("\u001f", *[F.concat(F.lit(k + "="), F.coalesce(parts[k].cast("string"), F.lit("<null>"))) for k in sorted(parts)]), 256)


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """(column, n), by value."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(column)


def section_counts(sections: DataFrame, columns: tuple[str, ...] = ("module", "answer_mode")) -> DataFrame:
    """(kind, value, n) for each of the columns."""
    long = sections.select(F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    return long.groupBy("kind", "value").agg(F.count("*").alias("n"))


def numeric_sort_key(value: Column) -> tuple[Column, Column]:
    """The digits of a text as a number, else 999999999, and the trimmed text."""
    digits = F.regexp_replace(value, r"\D+", "")
    return F.when(digits != "", digits.try_cast("long")).otherwise(F.lit(999_999_999)), F.trim(value)


def priority_report(documents: DataFrame) -> DataFrame:
    """Documents by falling priority, then by name."""
    return documents.orderBy(F.col("priority").desc(), "filename")


def backfill(rows: DataFrame, donors: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``rows`` with the columns that are null or empty taken from the donor row of their key."""
    given = donors.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    j = rows.join(given, key, "left")
    return j.select(*[F.coalesce(F.when(F.col(c).cast("string") != "", F.col(c)), F.col(f"_{c}")).alias(c) if c in columns else F.col(c) for c in rows.columns])


def ordered_json(rows: DataFrame, group: str, order: str, columns: list[str], name: str = "items") -> DataFrame:
    """(group, name): the group's rows as a JSON array of objects, by ``order``."""
    item = F.struct(F.col(order).alias("_at"), F.struct(*columns).alias("row"))
    return rows.groupBy(group).agg(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["row"])).alias(name))
