"""Table access by a small filter language.

A filter value ``op.operand`` names an operator (eq neq gt gte lt lte like ilike is in); any other
value is compared for equality. ``null``, ``true`` and ``false`` are literals, everything else is
cast to the column's type. The keys ``order`` and ``limit`` are not filters.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


def _name(text: str) -> str:
    if not _NAME.match(text):
        raise ValueError(f"not a column name: {text!r}")
    return text


def literal(text: object) -> object:
    if not isinstance(text, str):
        return text
    return {"null": None, "true": True, "false": False}.get(text.lower(), text)


def condition(df: DataFrame, column: str, raw: object) -> Column:
    c, kind = F.col(_name(column)), df.schema[column].dataType
    cast = lambda v: F.lit(literal(v)).cast(kind)
    op, dot, operand = raw.partition(".") if isinstance(raw, str) else ("", "", raw)
    if not dot:
        return c == cast(raw) if literal(raw) is not None else c.isNull()
    compare = {"eq": c.__eq__, "neq": c.__ne__, "gt": c.__gt__, "gte": c.__ge__, "lt": c.__lt__, "lte": c.__le__}
    if op in compare:
        return compare[op](cast(operand))
    if op in ("like", "ilike"):
        return getattr(c, op)(operand)
    if op == "is":
        value = literal(operand)
        return c.isNull() if value is None else c.eqNullSafe(F.lit(value))
    if op == "in" and operand.startswith("(") and operand.endswith(")"):
        return c.isin([cast(v.strip()) for v in operand[1:-1].split(",") if v.strip()])
    return c == cast(raw)


def columns(text: str) -> list[str]:
    return ["*"] if text.strip() == "*" else [_name(c.strip()) for c in text.split(",")]


def ordering(text: str) -> list[Column]:
    """``a.desc,b``: ascending puts nulls last and descending first, as in the reference database."""
    out = []
    for part in text.split(","):
        name, _, way = part.strip().partition(".")
        if way not in ("", "asc", "desc"):
            raise ValueError(f"not an order: {part!r}")
        c = F.col(_name(name))
        out.append(c.desc_nulls_first() if way == "desc" else c.asc_nulls_last())
    return out


def select(df: DataFrame, cols: str = "*", filters: dict | None = None, order: str | None = None, limit: int | None = None) -> DataFrame:
    filters = dict(filters or {})
    order, limit = filters.pop("order", order), filters.pop("limit", limit)
    for column, raw in filters.items():
        df = df.filter(condition(df, column, raw))
    if order:
        df = df.orderBy(*ordering(order))
    if limit is not None:
        df = df.limit(int(limit))
    return df.select(*columns(cols))


def insert(df: DataFrame, rows: list[dict]) -> DataFrame:
    """All rows must have the first one's columns; the table's other columns are null."""
    if not rows:
        return df
    names = list(rows[0])
    if any(set(r) != set(names) for r in rows):
        raise ValueError("rows differ in their columns")
    fields = [df.schema[n] for n in names]
    from pyspark.sql import types as T

    new = df.sparkSession.createDataFrame([tuple(r[n] for n in names) for r in rows], T.StructType([T.StructField(f.name, f.dataType) for f in fields]))
    return df.unionByName(new, allowMissingColumns=True)


def _needed(df: DataFrame, filters: dict) -> Column:
    if not filters:
        raise ValueError("refused without a filter")
    out = F.lit(True)
    for column, raw in filters.items():
        out = out & condition(df, column, raw)
    return F.coalesce(out, F.lit(False))


def update(df: DataFrame, values: dict, filters: dict) -> DataFrame:
    """The snapshot after the update."""
    hit = _needed(df, filters)
    return df.withColumns({_name(c): F.when(hit, F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})


def delete(df: DataFrame, filters: dict) -> DataFrame:
    return df.filter(~_needed(df, filters))


def upsert_latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key: a keyed report in which later entries replace earlier ones."""
    others = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("r"))
    return last.select(key, "r.*")
