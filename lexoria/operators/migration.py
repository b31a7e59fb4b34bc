"""Whether a migrated corpus still says what its sources said: evidence of nine kinds and the lines of
each unit, held against its destination, and the report of a batch of units.

Lines and evidence of both sides are exploded in one pass, the source's with +1 and the target's with
-1, so that an aggregation over (unit, category, item) is the multiset difference. Lines are netted
first, and evidence within lines is made of those only that one side has more often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexoria.functions import text as tx
from lexoria.functions.text import iso_instant

from .lifecycle import grouped_fingerprint
from .preservation import body_of, missing_in_order, normal_line

# The patterns of evidence.
IDENTIFIER = r"(?U)\b[A-Z][A-Z0-9_]{2,}\b|(?<!\w)--[a-z][a-z0-9-]*|`[A-Za-z_][A-Za-z0-9_.]*`"
# A link's first sign stands before the look behind it, so that a search passes over other signs at once.
LINK = r"(?U)\[(?<!!\[)[^\]]+\]\([^)]+\)|h(?<![!\w]h)ttps?://[^\s>)]+"
IMAGE = r"!\[[^\]]*\]\(([^)]+)\)"
LIST = r"^[ \t]{0,3}(?:[-+*]|\d+[.)])[ \t]+(.+)$"
FENCE = r"^[ \t]{0,3}(?:`{3,}|~{3,}).*$"
RULE = r"^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$"
CLAUSES = {
    "negation": r"(?iU)\b(?:não|nunca|jamais|sem|proibido|proibida|not|never|without)\b",
    "condition": r"(?iU)\b(?:se|quando|caso|somente se|apenas se|if|when|unless)\b",
    "exception": r"(?iU)\b(?:exceto|exceção|salvo|ressalva|except|exception)\b",
}
#: A fence of at least three signs, up to a line of at least as many of them, or to the end.
BLOCK = r"(?msd)^[ \t]{0,3}(([`~])\2{2,})[^\n]*\n(.*?)(?:^[ \t]{0,3}\1\2*[ \t]*$|\z)"
#: Signs without which a line opens no code, image or link in brackets.
OPENS = r"[\[`~]"
#: Characters of a loss that a report quotes.
DETAIL = 240


def _spanning(text: Column) -> dict[str, Column]:
    """The items of the kinds that may span lines."""
    every = lambda pattern, group=0: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    inner = lambda m: F.coalesce(F.nullif(F.regexp_extract(m, r"^\[[^\]]+\]\(([^)]+)\)$", 1), F.lit("")), m)
    code = F.regexp_extract_all(F.concat(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\n")), F.lit(BLOCK), F.lit(3))
    return {"code": F.transform(code, lambda x: F.regexp_replace(x, r"\n\z", "")), "link": F.transform(every(LINK), inner), "image": every(IMAGE, 1)}


def _within(line: Column) -> dict[str, Column]:
    """The items of the kinds that lie within a line."""
    none = F.array().cast("array<string>")
    cells = F.split(F.regexp_replace(F.trim(line), r"^\|+|\|+$", ""), r"(?<!\\)\|")
    row = F.array_join(F.transform(cells, lambda c: normal_line(F.replace(c, F.lit("\\|"), F.lit("|")))), " | ")
    one = lambda found, item: F.when(found, F.array(item)).otherwise(none)
    return {
        "identifier": F.transform(F.regexp_extract_all(line, F.lit(IDENTIFIER), F.lit(0)), lambda m: F.regexp_replace(m, "^`|`$", "")), "list": one(line.rlike(LIST), normal_line(F.regexp_extract(line, LIST, 1))),
        "table_cell": one(line.contains("|") & ~line.rlike(RULE) & (F.size(cells) > 1), row), **{kind: one(line.rlike(pattern) & ~line.rlike(FENCE), normal_line(line)) for kind, pattern in CLAUSES.items()},
    }


def evidence(text: Column) -> dict[str, Column]:
    """The items of each kind in a text, in order: code, identifier, link, image, list, table_cell,
    negation, condition, exception."""
    each = lambda kind: F.flatten(F.transform(tx.lines(text), lambda x: _within(x)[kind]))
    return _spanning(text) | {kind: each(kind) for kind in ("identifier", "list", "table_cell", *CLAUSES)}


def _shared(a: Column, b: Column) -> Column:
    """How many of the first items two arrays share."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(a)).cast("int")


def _named(items: Column, kind: str, sign: int) -> Column:
    return F.transform(items, lambda x: F.struct(F.lit(kind).alias("category"), x.alias("item"), F.lit(sign).alias("sign")))


def _signed(pairs: DataFrame, keys: list[str], quoted: bool, raw: bool = False) -> DataFrame:
    """(keys, _items) of pairs (keys, compared, source_lines, target_lines): what a pair's sides hold, +1 each
    of the source and -1 each of the target, as (category, item, sign); null where they are equal or not
    ``compared``. With ``raw`` the pairs have the texts, source and target, too, whatever their line ends.

    Lines (category _line) that the sides share at their beginning or end are +1 and -1, and left out; the
    ordered walk meets those at the beginning first, and goes on from there. Items that span lines begin
    behind the first lines that both share and that hold no sign to open one. Lines of the source that the
    target lacks in their order are of category text: the lines, or unless ``quoted`` their number."""
    a, b, x, y = (F.col(f"_{c}") for c in "abxy")
    texts = ["source", "target"] if raw else []
    differ = F.col("source") != F.col("target") if raw else F.col("source_lines") != F.col("target_lines")
    once = pairs.select(*keys, *texts, (F.coalesce("compared", F.lit(False)) & F.coalesce(differ, F.lit(False))).alias("_differ"), "source_lines", "target_lines")
    once = once.withColumn("_a", F.when(F.col("_differ"), F.col("source_lines"))).withColumn("_b", F.when(F.col("_differ"), F.col("target_lines")))
    # Columns of their own, so that they are not made again for each use.
    once = once.withColumn("_n", _shared(a, b)).withColumn("_opens", F.array_position(F.transform(F.slice(a, F.lit(1), F.col("_n")), lambda c: c.rlike(OPENS)), True))
    once = once.withColumn("_k", F.when(F.col("_opens") > 0, F.col("_opens")).otherwise(F.col("_n") + 1).cast("int"))
    behind = lambda c, text: F.when(F.contains("source", F.lit("\r")) | F.contains("target", F.lit("\r")), F.col(text)).otherwise(c) if raw else c
    once = once.withColumn("_s", behind(F.array_join(F.slice(a, F.col("_k"), F.size(a)), "\n"), "source")).withColumn("_t", behind(F.array_join(F.slice(b, F.col("_k"), F.size(b)), "\n"), "target"))
    once = once.withColumn("_a", F.slice(a, F.col("_n") + 1, F.size(a))).withColumn("_b", F.slice(b, F.col("_n") + 1, F.size(b)))
    once = once.withColumn("_m", _shared(F.reverse(a), F.reverse(b))).withColumn("_x", body_of(a)).withColumn("_y", body_of(b))
    inner = lambda c: F.slice(c, F.lit(1), F.size(c) - F.col("_m"))
    missing = missing_in_order(x, y)
    text = _named(missing, "text", 1) if quoted else F.array(F.struct(F.lit("text").alias("category"), F.lit("").alias("item"), F.size(missing).alias("sign")))
    spans = {side: _spanning(F.col(side)) for side in ("_s", "_t")}
    once = once.withColumns({f"{side}_{kind}": items for side, kinds in spans.items() for kind, items in kinds.items()})
    # Equal lists are +1 and -1 throughout.
    unlike = lambda kind, c: F.when(F.col(f"_s_{kind}") != F.col(f"_t_{kind}"), F.col(c)).otherwise(F.array().cast("array<string>"))
    sides = [_named(unlike(kind, f"{side}_{kind}"), kind, sign) for side, sign in (("_s", 1), ("_t", -1)) for kind in spans[side]]
    return once.select(*keys, F.when(F.col("_differ"), F.concat(_named(inner(a), "_line", 1), _named(inner(b), "_line", -1), *sides, text)).alias("_items"))


def _lost(signed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, category, item, lost): how much more often the source has each item than the target. Lines
    that both have as often go first; evidence within a line is made once for each line that is left."""
    # explode_outer, as a filter on the arrays' sizes would make them a second time.
    rows = signed.select(*keys, F.explode_outer("_items").alias("x")).select(*keys, "x.*").filter("category IS NOT NULL")
    net = rows.groupBy(*keys, "category", "item").agg(F.sum("sign").alias("n")).filter("n <> 0")
    found = F.concat(*[_named(items, kind, 1) for kind, items in _within(F.col("item")).items()])
    items = net.withColumn("x", F.when(F.col("category") == "_line", found).otherwise(F.array(F.struct("category", "item", F.lit(1).alias("sign")))))
    items = items.select(*keys, "n", F.explode_outer("x").alias("x")).select(*keys, "n", "x.category", "x.item").filter("category IS NOT NULL")
    return items.groupBy(*keys, "category", "item").agg(F.sum("n").alias("lost"))


def _quoted(signed: DataFrame, keys: list[str]) -> DataFrame:
    lost = _lost(signed.repartition(*keys), keys).filter("lost > 0")
    return lost.select(*keys, "category", F.left("item", F.lit(DETAIL)).alias("detail"), "lost")


def evidence_losses(units: DataFrame, key: str = "unit_id", source: str = "source", target: str = "target") -> DataFrame:
    """(key, category, detail, lost): what the source has more often than the target, for each item of
    evidence, and the source's lines (category text) that the target lacks in their order."""
    pairs = units.select(key, F.lit(True).alias("compared"), F.coalesce(source, F.lit("")).alias("source"), F.coalesce(target, F.lit("")).alias("target"))
    pairs = pairs.withColumn("source_lines", tx.lines(F.col("source"))).withColumn("target_lines", tx.lines(F.col("target")))
    return _quoted(_signed(pairs, [key], True, raw=True), [key])


def _reviewed(review: str) -> Column:
    return F.coalesce((F.col(f"{review}.status") == "reviewed") & (F.trim(F.col(f"{review}.reviewer")) != "") & iso_instant(F.col(f"{review}.reviewed_at")).isNotNull(), F.lit(False))


def _slice(text: Column, start: Column, end: Column) -> Column:
    """The lines from start to end, an array; null where they do not lie in the text."""
    lines = tx.lines(text)
    n = F.size(lines) - F.when(text.endswith("\n") | text.endswith("\r"), 1).otherwise(0)
    return F.when((start >= 1) & (end >= start) & (end <= n), F.slice(lines, start, end - start + 1))


def snapshot_hash(batches: DataFrame, inventory: DataFrame, units: DataFrame) -> DataFrame:
    """(batch_id, snapshot): from the commit, the expected units, and where each one's source lies.
    Destinations and decisions take no part."""
    where = ("path", "sha256", "format", "revision", "start_line", "end_line")
    none = [F.lit(None).cast("string").alias(c) for c in where]
    expected = inventory.select("batch_id", F.lit("unit").alias("kind"), "unit_id", *none)
    sources = units.filter("source IS NOT NULL").select("batch_id", F.lit("source").alias("kind"), "unit_id", *[F.col(f"source.{c}").cast("string").alias(c) for c in where])
    commits = batches.select("batch_id", F.lit("commit").alias("kind"), F.col("commit").alias("unit_id"), *none)
    return grouped_fingerprint(expected.unionByName(sources).unionByName(commits), "batch_id", ["kind", "unit_id", *where]).select("batch_id", F.col("fingerprint").alias("snapshot"))


def unit_results(batches: DataFrame, inventory: DataFrame, units: DataFrame, originals: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((batch_id, unit_id, status, detail, mapped, pending), losses) of all expected units.

    batches: (batch_id, commit, snapshot), what the report states; inventory: (batch_id, unit_id);
    units: (batch_id, unit_id, source, destination, disposition, review); originals: (path, text,
    revision) at the commit; targets: (path, text, canonical_id, reviewed). A unit is ``failed`` by the
    first integrity problem, by a loss, or where the batch's snapshot hash differs; ``incomplete``
    without a source, destination or review; else ``passed``.
    """
    held = snapshot_hash(batches, inventory, units)
    stated = batches.select("batch_id", F.col("snapshot").alias("stated")).join(held, "batch_id", "left").select("batch_id", F.col("stated").eqNullSafe(F.col("snapshot")).alias("intact"))
    o = originals.select(F.col("path").alias("o_path"), F.col("text").alias("o_text"), F.col("revision").alias("o_revision"))
    t = targets.select(F.col("path").alias("t_path"), F.col("text").alias("t_text"), "canonical_id", F.col("reviewed").alias("t_reviewed"))
    every = inventory.select("batch_id", "unit_id").distinct().join(units.withColumn("_has", F.lit(True)), ["batch_id", "unit_id"], "left")
    j = every.join(o, F.col("source.path") == F.col("o_path"), "left").join(t, F.col("destination.path") == F.col("t_path"), "left")
    j = j.withColumn("source_lines", _slice(F.col("o_text"), F.col("source.start_line"), F.col("source.end_line"))).withColumn("target_lines", _slice(F.col("t_text"), F.col("destination.start_line"), F.col("destination.end_line")))
    no = lambda c: F.coalesce(~c, F.lit(True))
    kind, goes = F.col("disposition.kind"), F.col("destination").isNotNull()
    reasons = F.coalesce((F.trim(F.col("disposition.reason")) != "") & (F.trim(F.col("disposition.reviewer")) != "") & iso_instant(F.col("disposition.reviewed_at")).isNotNull(), F.lit(False))
    compared = F.col("disposition").isNull() | (kind == "merged")
    canonical = F.col("source.format") == "canonical"
    problem = (
        F.when(F.col("_has").isNull(), "no_unit").when(F.col("o_path").isNull(), "source_missing").when(no(F.sha2("o_text", 256) == F.col("source.sha256")), "source_hash").when(no(F.col("source.format").isin("legacy", "canonical")), "source_format")
        .when(F.when(canonical, no(F.col("source.revision") == F.col("o_revision"))).otherwise(F.col("source.revision").isNotNull()), "source_revision").when(F.col("source_lines").isNull(), "source_range").when((F.size("source_lines") == 1) & (F.trim(F.get("source_lines", F.lit(0))) == ""), "source_empty")
        .when(F.col("disposition").isNotNull() & no(kind.isin("excluded", "merged")), "disposition").when(F.col("disposition").isNotNull() & ~reasons, "disposition_review").when((kind == "excluded") & goes, "excluded_with_destination")
        .when((kind == "merged") & ~goes, "merged_without_destination").when(F.col("disposition").isNull() & ~goes, "no_destination").when(compared & F.col("t_path").isNull(), "target_missing")
        .when(compared & no(F.sha2("t_text", 256) == F.col("destination.sha256")), "target_hash").when(compared & no(F.col("canonical_id") == F.col("destination.canonical_id")), "target_id").when(compared & F.col("target_lines").isNull(), "target_range")
    )
    pending = ~_reviewed("review") | (compared & goes & no(F.col("t_reviewed")))
    mapped = goes | F.coalesce(kind == "excluded", F.lit(False))
    judged = j.select("batch_id", "unit_id", problem.alias("problem"), pending.alias("pending"), mapped.alias("mapped"), compared.alias("compared"), "source_lines", "target_lines")
    judged, key = judged.withColumn("compared", F.col("problem").isNull() & F.col("compared")), ["batch_id", "unit_id"]
    # A row of category _unit stands for every unit, so that one pass over the texts gives all its columns.
    known = [*key, "problem", "pending", "mapped"]
    unit = F.array(F.struct(F.lit("_unit").alias("category"), F.lit("").alias("item"), F.lit(1).alias("sign")))
    signed = _signed(judged, known, False).withColumn("_items", F.concat(unit, F.coalesce("_items", F.array().cast("array<struct<category:string,item:string,sign:int>>"))))
    counted = _lost(signed.repartition(*key), known).groupBy(*known).agg(F.sum(F.when(F.col("category") == "_unit", 0).otherwise(F.greatest("lost", F.lit(0)))).alias("lost"))
    done = counted.join(stated, "batch_id", "left")
    waits = F.col("problem").isin("no_unit", "source_missing", "no_destination")
    failed = F.coalesce(~F.col("intact"), F.lit(True)) | (F.col("problem").isNotNull() & ~waits) | (F.col("lost") > 0)
    status = F.when(failed, "failed").when(waits | F.col("pending"), "incomplete").otherwise("passed")
    detail = F.when(F.coalesce(~F.col("intact"), F.lit(True)), "snapshot").otherwise(F.coalesce("problem", F.when(F.col("lost") > 0, "losses"), F.when(F.col("pending"), "review")))
    results = done.select(*key, status.alias("status"), detail.alias("detail"), "mapped", "pending", "lost")
    return results, _quoted(_signed(judged, key, True), key)


def batch_report(results: DataFrame) -> DataFrame:
    """(batch_id, status, total, mapped, failed, incomplete, lost, review_status): failed where a unit
    is, passed where all units are mapped, passed and reviewed, else incomplete."""
    n = results.groupBy("batch_id").agg(F.count("*").alias("total"), F.count_if("mapped").alias("mapped"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "incomplete").alias("incomplete"), F.sum("lost").alias("lost"), F.bool_or("pending").alias("pending"))
    status = F.when(F.col("failed") > 0, "failed").when((F.col("mapped") == F.col("total")) & (F.col("incomplete") == 0) & ~F.col("pending"), "passed").otherwise("incomplete")
    return n.select("batch_id", status.alias("status"), "total", "mapped", "failed", "incomplete", "lost", F.when(F.col("pending"), "pending").otherwise("reviewed").alias("review_status"))
