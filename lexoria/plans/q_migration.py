"""The preservation report of a migration of the documents, and its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexoria.functions import text as tx
from lexoria.operators import migration
from lexoria.sources import corpus

#: Evidence of every kind, put behind each text.
TAIL = "\n\n# Título {#t}\nSee [a](http://x.y/z) and https://q.r/s ![i](p/i.png)\n- item One\n- item One\n```sh\ncode A\n\n```\nnão faça isto\nif ready --force `name_1` ABC_DEF\nexceto hoje\n| a | B c |\n|---|---|\n"


def _ends(text: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("batch_id"), F.concat(tx.unified(F.coalesce("text", F.lit(""))), F.lit(TAIL)).alias("text"))
    x = F.col("doc_id") % 8
    r = lambda a, b: F.replace("text", F.lit(a), F.lit(b))
    target = F.when(x == 1, r("- item One\n- item One\n", "- item One\n")).when(x == 2, r("code A", "code B")).when(x == 3, r("não", "sim")).when(x == 4, F.substr("text", F.lit(11))).when(x == 5, F.concat("text", F.lit("more\n"))).when(x == 6, r("`name_1` ABC_DEF", "`name_1` abc")).otherwise(F.col("text"))
    return d.withColumn("target", target).withColumn("n", _ends("text")).withColumn("m", _ends("target"))


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    d, i = _texts(spark, sf_dir), F.col("doc_id")
    unit, day = i.cast("string").alias("unit_id"), F.lit("2026-01-01T00:00:00Z").alias("reviewed_at")
    source = F.struct(F.concat(F.lit("s/"), unit).alias("path"), F.when(i % 29 == 3, "bad").otherwise(F.sha2("text", 256)).alias("sha256"), F.lit("legacy").alias("format"), F.lit(None).cast("int").alias("revision"), F.lit(1).alias("start_line"), F.when(i % 31 == 5, F.col("n") + 1).otherwise(F.col("n")).alias("end_line"))
    goes = F.struct(F.concat(F.lit("t/"), unit).alias("path"), F.sha2("target", 256).alias("sha256"), unit.alias("canonical_id"), F.lit(1).alias("start_line"), F.col("m").alias("end_line"))
    excluded = F.struct(F.lit("excluded").alias("kind"), F.when(i % 2 == 0, "old").otherwise(" ").alias("reason"), F.lit("me").alias("reviewer"), day)
    units = d.filter("doc_id % 43 <> 7").select("batch_id", unit, source.alias("source"), F.when((i % 11 != 2) & (i % 13 != 4), goes).alias("destination"), F.when((i % 13 == 4) & (i % 11 != 2), excluded).alias("disposition"), F.struct(F.when(i % 17 == 6, "open").otherwise("reviewed").alias("status"), F.lit("me").alias("reviewer"), day).alias("review"))
    units = corpus.stored(units, "units")  # without texts; read for both hashes and the report
    inventory = d.select("batch_id", unit)
    batches = d.select("batch_id").distinct().select("batch_id", F.lit("c" * 40).alias("commit"))
    good = migration.snapshot_hash(batches, inventory, units)
    batches = batches.join(good, "batch_id").withColumn("snapshot", F.when(F.col("batch_id") == "src3", "tampered").otherwise(F.col("snapshot")))
    originals = d.select(F.concat(F.lit("s/"), unit).alias("path"), "text", F.lit(1).alias("revision"))
    targets = d.select(F.concat(F.lit("t/"), unit).alias("path"), F.col("target").alias("text"), unit.alias("canonical_id"), F.lit(True).alias("reviewed"))
    return batches, inventory, units, originals, targets


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return migration.unit_results(*_parts(spark, sf_dir))[0].select("batch_id", "unit_id", "status", "detail", "mapped", "pending", "lost")


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = migration.unit_results(*_parts(spark, sf_dir))[1]
    return lost.groupBy("batch_id", "category").agg(F.countDistinct("unit_id").alias("units"), F.sum("lost").alias("lost"))


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return migration.batch_report(migration.unit_results(*_parts(spark, sf_dir))[0])


QUERIES = {"migration_report": report, "migration_losses": losses, "migration_batches": batches}

_TAIL = TAIL.replace("'", "''")
_NORM = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"


def _items(text: str) -> str:
    """(category, item) lists of a text, by patterns without look-around."""
    lines = f"string_split({text}, chr(10))"
    clause = lambda kind, words: f"list_transform(list_filter({lines}, lambda l: regexp_matches(' ' || lower(l) || ' ', '[^\\p{{L}}\\p{{N}}_]({words})[^\\p{{L}}\\p{{N}}_]')), lambda l: '{kind}|' || {_NORM.format('l')})"
    return " || ".join([
        f"list_transform(regexp_extract_all({text} || chr(10), '(?ms)^ {{0,3}}```[^\\n]*\\n(.*?)(?:^ {{0,3}}```[ \\t]*$|\\z)', 1), lambda c: 'code|' || regexp_replace(c, '\\n\\z', ''))",
        f"list_transform(list_filter(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}_]+'), lambda t: regexp_matches(t, '^[A-Z][A-Z0-9_]{{2,}}$')), lambda t: 'identifier|' || t)",
        f"list_transform(regexp_extract_all({text}, '`([A-Za-z_][A-Za-z0-9_.]*)`', 1), lambda t: 'identifier|' || t)", f"list_transform(regexp_extract_all({text}, '[^\\p{{L}}\\p{{N}}_](--[a-z][a-z0-9-]*)', 1), lambda t: 'identifier|' || t)",
        f"list_transform(regexp_extract_all({text}, '[^!]\\[[^\\]]+\\]\\(([^)]+)\\)', 1), lambda t: 'link|' || t)", f"list_transform(regexp_extract_all({text}, ' (https?://[^\\s>)]+)', 1), lambda t: 'link|' || t)", f"list_transform(regexp_extract_all({text}, '!\\[[^\\]]*\\]\\(([^)]+)\\)', 1), lambda t: 'image|' || t)",
        f"list_transform(list_filter({lines}, lambda l: regexp_matches(l, '^[ \\t]{{0,3}}([-+*]|\\d+[.)])[ \\t]+.')), lambda l: 'list|' || {_NORM.format('''regexp_extract(l, '^[ \\t]{0,3}(?:[-+*]|\\d+[.)])[ \\t]+(.+)$', 1)''')})",
        f"list_transform(list_filter({lines}, lambda l: contains(trim(l, '| '), '|') AND NOT regexp_matches(l, '^\\s*\\|?\\s*:?-{{3,}}:?\\s*(\\|\\s*:?-{{3,}}:?\\s*)+\\|?\\s*$')), lambda l: 'table_cell|' || array_to_string(list_transform(string_split(trim(trim(l), '|'), '|'), lambda c: {_NORM.format('c')}), ' | '))",
        clause("negation", "não|nunca|jamais|sem|proibido|proibida|not|never|without"), clause("condition", "se|quando|caso|somente se|apenas se|if|when|unless"), clause("exception", "exceto|exceção|salvo|ressalva|except|exception"),
    ])


def _body(text: str) -> str:
    return f"list_transform(list_filter(string_split({text}, chr(10)), lambda l: trim(l) <> ''), lambda l: CASE WHEN regexp_matches(l, '^[ \\t]{{0,3}}#{{1,6}}[ \\t]+.') THEN 'heading: ' || trim(regexp_replace(regexp_extract(l, '^[ \\t]{{0,3}}#{{1,6}}[ \\t]+(.+)', 1), '[ \\t]+\\{{#[a-z][a-z0-9-]*\\}}[ \\t]*$', '')) ELSE regexp_replace(l, '\\s+$', '') END)"


# In these texts a changed line is the first that the walk misses, and all lines behind it are lost.
_UNITS = f"""WITH RECURSIVE x AS (SELECT doc_id, source AS batch_id, regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g') || '{_TAIL}' AS s FROM documents),
y AS MATERIALIZED (SELECT doc_id, batch_id, s, CASE doc_id % 8 WHEN 1 THEN replace(s, '- item One' || chr(10) || '- item One' || chr(10), '- item One' || chr(10)) WHEN 2 THEN replace(s, 'code A', 'code B') WHEN 3 THEN replace(s, 'não', 'sim') WHEN 4 THEN substr(s, 11) WHEN 5 THEN s || 'more' || chr(10) WHEN 6 THEN replace(s, '`name_1` ABC_DEF', '`name_1` abc') ELSE s END AS t FROM x),
p AS (SELECT doc_id, batch_id, s, t, doc_id % 11 <> 2 AND doc_id % 13 <> 4 AS goes, doc_id % 13 = 4 AND doc_id % 11 <> 2 AS ex,
  CASE WHEN doc_id % 43 = 7 THEN 'no_unit' WHEN doc_id % 29 = 3 THEN 'source_hash' WHEN doc_id % 31 = 5 THEN 'source_range' WHEN doc_id % 13 = 4 AND doc_id % 11 <> 2 AND doc_id % 2 = 1 THEN 'disposition_review' WHEN doc_id % 11 = 2 THEN 'no_destination' END AS problem FROM y),
c AS MATERIALIZED (SELECT doc_id, batch_id, s, t FROM p WHERE problem IS NULL AND NOT ex),
i AS (SELECT doc_id, batch_id, unnest({_items('s')}) AS item, 1 AS sign FROM c UNION ALL SELECT doc_id, batch_id, unnest({_items('t')}), -1 FROM c),
g AS (SELECT doc_id, batch_id, split_part(item, '|', 1) AS category, item, sum(sign) AS lost FROM i GROUP BY ALL HAVING sum(sign) > 0),
b AS MATERIALIZED (SELECT doc_id, batch_id, {_body('s')} AS a, {_body('t')} AS b FROM c), w(doc_id, pos, n) AS (SELECT doc_id, 1, 0 FROM b UNION ALL SELECT doc_id, pos + 1, CASE WHEN n < len(a) AND a[n + 1] = b[pos] THEN n + 1 ELSE n END FROM w JOIN b USING (doc_id) WHERE pos <= len(b)),
met AS (SELECT doc_id, max(n) AS n FROM w GROUP BY doc_id),
l AS MATERIALIZED (SELECT doc_id, batch_id, category, sum(lost) AS lost FROM g GROUP BY ALL UNION ALL SELECT doc_id, batch_id, 'text', len(a) - n FROM met JOIN b USING (doc_id) WHERE len(a) > n),
k AS (SELECT doc_id, sum(lost) AS lost FROM l GROUP BY doc_id),
u AS (SELECT batch_id, doc_id::VARCHAR AS unit_id, CASE WHEN batch_id = 'src3' OR (problem IS NOT NULL AND problem NOT IN ('no_unit', 'no_destination')) OR k.lost IS NOT NULL THEN 'failed' WHEN problem IS NOT NULL OR pending THEN 'incomplete' ELSE 'passed' END AS status,
  CASE WHEN batch_id = 'src3' THEN 'snapshot' ELSE coalesce(problem, CASE WHEN k.lost IS NOT NULL THEN 'losses' WHEN pending THEN 'review' END) END AS detail, mapped, pending, coalesce(k.lost, 0)::BIGINT AS lost
  FROM (SELECT *, doc_id % 43 = 7 OR doc_id % 17 = 6 AS pending, doc_id % 43 <> 7 AND (goes OR ex) AS mapped FROM p) p LEFT JOIN k USING (doc_id))"""

ORACLES = {
    "migration_report": _UNITS + " SELECT * FROM u",
    "migration_losses": _UNITS + " SELECT batch_id, category, count(DISTINCT doc_id) AS units, sum(lost)::BIGINT AS lost FROM l GROUP BY ALL",
    "migration_batches": _UNITS + """, n AS (SELECT batch_id, count(*) AS total, count_if(mapped)::BIGINT AS mapped, count_if(status = 'failed')::BIGINT AS failed, count_if(status = 'incomplete')::BIGINT AS incomplete, sum(lost)::BIGINT AS lost, bool_or(pending) AS pending FROM u GROUP BY batch_id)
SELECT batch_id, CASE WHEN failed > 0 THEN 'failed' WHEN mapped = total AND incomplete = 0 AND NOT pending THEN 'passed' ELSE 'incomplete' END AS status, total, mapped, failed, incomplete, lost, CASE WHEN pending THEN 'pending' ELSE 'reviewed' END AS review_status FROM n""",
}
