"""Queries over canonical contracts, claim rounds and documentation tasks, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexoria.operators import canonical, claims, grounding
from lexoria.sources import corpus

t = corpus.table

WORDS = canonical.Vocabulary("v1", ("src0", "src1", "src2", "src3"), ("en", "de", "fr"), ("sql", "general"), ("erp1", "erp2"))


def manifest(spark, sf_dir):
    d, n = t(spark, sf_dir, "documents"), t(spark, sf_dir, "nation")
    name = lambda k: F.concat(F.lit("d"), k)
    entries = d.select(
        F.concat("source", F.lit("/"), F.col("doc_id") % 300).alias("path"), F.when(F.col("doc_id") % 6 == 0, "").otherwise(name(F.col("doc_id") % 550)).alias("document_id"),
        F.when(F.col("doc_id") % 3 == 1, "canonical").otherwise("legacy").alias("format"), F.concat(F.lit("b"), F.col("doc_id") % 7).alias("batch_id"),
        F.when(F.col("doc_id") % 4 == 0, F.array(name(F.col("doc_id") % 800), name(F.lit(1)))).otherwise(F.array().cast("array<string>")).alias("successors"),
    )
    return canonical.manifest_problems(n.select(F.concat(F.lit("b"), "n_regionkey").alias("batch_id")), entries)


def contracts(spark, sf_dir):
    d, i = t(spark, sf_dir, "documents"), F.col("doc_id")
    none = F.array().cast("array<string>")
    ref = F.struct(F.when(i % 13 == 0, "gone").otherwise("s1").alias("source_id"), F.lit("line_range").alias("kind"), (i % 10).alias("first"), (i % 17).alias("last"))
    section = F.struct(F.lit("k").alias("key"), F.array("source").alias("products"), F.array("lang").alias("modules"), F.when(i % 19 == 0, "talk").alias("answer_mode"), F.array(ref).alias("refs"))
    rows = d.select(
        i.alias("document_id"), F.when(i % 11 == 0, F.array(F.lit("s1"), F.lit("s1"))).otherwise(F.array(F.lit("s1"))).alias("source_ids"), F.when(i % 5 == 0, "v0").otherwise("v1").alias("taxonomy_version"),
        F.col("lang").alias("primary_module"), none.alias("secondary_modules"), F.when(i % 7 == 0, "chat").otherwise("sql").alias("answer_mode"), F.array("source").alias("products"), F.array(F.concat(F.lit("erp"), i % 3)).alias("erp_systems"),
        F.array(F.lit("src1")).alias("version_products"), F.array(section).alias("sections"),
    )
    return canonical.document_problems(rows, WORDS).select("document_id", F.array_join("problems", ",").alias("problems"))


def images(spark, sf_dir):
    d, i = t(spark, sf_dir, "documents"), F.col("doc_id")
    target = F.element_at(F.array(*[F.lit(x) for x in ("img/a%20b.png", "../x/./y.png", "https://h/z.png", "<../../../up.png>", "#top", "c.png?size=1 'title'")]), (i % 6 + 1).cast("int"))
    shown = canonical.local_images(F.concat("text", F.lit("\n![alt]("), target, F.lit(") ![n](n"), i, F.lit(".png)")), F.lit("docs/kb/page.md"))
    return d.select("doc_id", F.array_join(shown, ",", "null").alias("images"))


def legacy(spark, sf_dir):
    """Documents, each under a title or none, as files; headings and fences have no SQL, a test covers them."""
    d = t(spark, sf_dir, "documents")
    head = F.when(F.col("doc_id") % 3 == 0, "# Title\n\n").when(F.col("doc_id") % 3 == 1, "## A\n#### B\n![x](kept.png) ![y](lost.png)\n").otherwise("")
    docs = d.select(F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("path"), F.concat(head, "text").alias("text"))
    return canonical.legacy_diagnostics(docs, docs.select("path").union(d.select(F.concat("source", F.lit("/kept.png"))).distinct()))


def provenances(spark, sf_dir):
    d, i = t(spark, sf_dir, "documents"), F.col("doc_id")
    meta = F.create_map(F.lit("canonical_id"), F.concat(F.lit("m"), i), F.lit("section_key"), F.col("lang"))
    rows = d.select(
        "doc_id", F.when(i % 3 == 0, "").when(i % 3 == 1, "own").alias("canonical_id"), F.lit(None).cast("string").alias("document_revision"), F.lit("1").alias("schema_version"), F.lit(None).cast("string").alias("section_key"),
        F.when(i % 2 == 0, F.col("source")).alias("locator"), F.when(i % 5 > 0, F.array(F.struct(F.concat(F.lit("L"), i).alias("locator")))).alias("source_refs"), meta.alias("metadata"),
    )
    return canonical.provenance(rows).select("doc_id", "canonical_id", "document_revision", "schema_version", "section_key", "locator")


def rules(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    return d.select("doc_id", canonical.rules_chunk(F.col("text"), F.concat("source", F.lit(".md"))).alias("c")).select("doc_id", "c.id", "c.document_id", F.length("c.content").alias("chars"))


def totals(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    i = F.col("event_id")
    results = e.select(F.when(i % 9 == 0, "boom").alias("error"), F.when(i % 2 == 0, F.col("event_type")).alias("error_type"), (i % 4 == 1).alias("skipped"), (i % 6).alias("chunks"), F.when(i % 9 == 0, 1).alias("failed_chunks"))
    out = canonical.run_totals(results, 10_000)
    return out.withColumn("error_types", F.array_join(F.transform(F.map_entries("error_types"), lambda x: F.concat_ws("=", x["key"], x["value"])), ","))


def rounds(spark, sf_dir):
    e, i = t(spark, sf_dir, "events"), F.col("event_id")
    k = F.floor(i / 10).cast("long")
    asked = e.select(k.alias("answer_id"), i.alias("claim_id"), F.when((k % 23 != 0) | (i % 10 < 9), F.floor(i % 10 / 4).cast("int") + 1).alias("batch"), grounding.claim_status(F.when(k % 3 == 0, 0.9).otherwise(i % 4 / 4.0 + 0.1), F.lit(0.1)).alias("status"))
    answers = e.select(k.alias("answer_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("batch")).distinct()
    decided = answers.filter("NOT (answer_id % 13 = 0 AND batch = 2)").select("answer_id", "batch", F.when((F.col("answer_id") % 7 == 0) & (F.col("batch") == 3), "timeout").otherwise("ok").alias("outcome"), ((F.col("answer_id") % 11 > 0) | (F.col("batch") != 1)).alias("model_matches"))
    return claims.claim_round(asked, decided)


def tasks(spark, sf_dir):
    c = t(spark, sf_dir, "conversations")
    asked = c.filter("turn = 0").select(F.col("conv_id").alias("query_id"), F.col("text").alias("query"))
    feedback = c.filter("turn > 0 AND conv_id % 3 < 2").select(F.col("conv_id").alias("query_id"), F.when(F.col("turn") % 2 == 0, "").otherwise(F.concat(F.lit("f"), F.col("turn") % 4)).alias("feedback_item_id"))
    base = c.filter("turn > 0 AND conv_id % 4 < 3").select(F.col("conv_id").alias("query_id"), F.concat("role", F.lit(".md")).alias("filename"))
    out = claims.documentation_tasks(asked, feedback, base)
    return out.withColumn("feedback_item_ids", F.array_join("feedback_item_ids", ",")).withColumn("base_sources", F.array_join("base_sources", ",")).withColumn("query", F.sha2("query", 256))


QUERIES = {
    "manifest_problems": manifest, "document_problems": contracts, "local_images": images, "legacy_diagnostics": legacy, "canonical_provenance": provenances,
    "business_rules_chunk": rules, "ingest_run_totals": totals, "claim_round": rounds, "documentation_tasks": tasks,
}

_IN = "NOT coalesce({0} IN {1}, FALSE)"
_PRODUCTS, _MODULES = _IN.format("source", WORDS.products), _IN.format("lang", WORDS.modules)

ORACLES = {
    "manifest_problems": """WITH e AS (SELECT source || '/' || (doc_id % 300) AS path, CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'd' || (doc_id % 550) END AS document_id, doc_id % 3 = 1 AS canonical, 'b' || (doc_id % 7) AS batch_id, CASE WHEN doc_id % 4 = 0 THEN ['d' || (doc_id % 800), 'd1'] ELSE [] END AS successors FROM documents),
b AS (SELECT 'b' || n_regionkey AS batch_id FROM nation), s AS (SELECT DISTINCT path, unnest(successors) AS k FROM e)
SELECT batch_id AS subject, 'duplicate_batch_id' AS problem FROM b GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT path, 'duplicate_path' FROM e GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT document_id, 'duplicate_document_id' FROM e WHERE document_id <> '' GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT path, 'unknown_batch' FROM e WHERE batch_id NOT IN (SELECT batch_id FROM b) UNION ALL SELECT DISTINCT path, 'unresolved_successor' FROM s WHERE k NOT IN (SELECT document_id FROM e WHERE canonical AND document_id <> '')""",
    "document_problems": f"""SELECT doc_id AS document_id, array_to_string(list_filter([CASE WHEN doc_id % 11 = 0 THEN 'sources' END, CASE WHEN doc_id % 5 = 0 THEN 'taxonomy_version' END, CASE WHEN {_PRODUCTS} THEN 'products' END, CASE WHEN {_MODULES} THEN 'modules' END, CASE WHEN doc_id % 7 = 0 THEN 'answer_mode' END, CASE WHEN doc_id % 3 = 0 THEN 'erp_systems' END,
CASE WHEN source IS DISTINCT FROM 'src1' THEN 'product_versions' END, CASE WHEN {_PRODUCTS} THEN 'section_products' END, CASE WHEN {_MODULES} THEN 'section_modules' END, CASE WHEN doc_id % 19 = 0 THEN 'section_answer_mode' END, CASE WHEN doc_id % 13 = 0 THEN 'section_sources' END, CASE WHEN doc_id % 17 < doc_id % 10 THEN 'section_ranges' END], lambda x: x IS NOT NULL), ',') AS problems FROM documents""",
    "local_images": """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'docs/kb/img/a b.png,' WHEN 1 THEN 'docs/x/y.png,' WHEN 3 THEN 'null,' WHEN 5 THEN 'docs/kb/c.png,' ELSE '' END || 'docs/kb/n' || doc_id || '.png' AS images FROM documents""",
    "canonical_provenance": """SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'own' ELSE 'm' || doc_id END AS canonical_id, NULL::VARCHAR AS document_revision, '1' AS schema_version, lang AS section_key, CASE WHEN doc_id % 2 = 0 THEN coalesce(source, CASE WHEN doc_id % 5 > 0 THEN 'L' || doc_id END) WHEN doc_id % 5 > 0 THEN 'L' || doc_id END AS locator FROM documents""",
    "business_rules_chunk": "SELECT doc_id, 'business-rules:' || sha256(text) AS id, 'business-rules:' || source || '.md' AS document_id, length(text)::INTEGER AS chars FROM documents",
    "ingest_run_totals": """WITH r AS (SELECT *, event_id % 9 = 0 AS bad, event_id % 4 = 1 AS skip FROM events), k AS (SELECT CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'ingestion_error' END AS k, count(*) AS n FROM r WHERE bad GROUP BY 1)
SELECT count(*) AS returned, count(*) FILTER (NOT bad AND NOT skip) AS succeeded, count(*) FILTER (skip) AS skipped, count(*) FILTER (bad) AS failed, sum(event_id % 6)::BIGINT AS chunks, count(*) FILTER (bad) AS failed_chunks, 10000::BIGINT AS expected, FALSE AS complete, (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM k) AS error_types FROM r""",
    "claim_round": """WITH c AS (SELECT event_id // 10 AS a, CASE WHEN (event_id // 10) % 23 <> 0 OR event_id % 10 < 9 THEN (event_id % 10) // 4 + 1 ELSE 0 END AS b, CASE WHEN (event_id // 10) % 3 = 0 THEN 0.9 ELSE event_id % 4 / 4.0 + 0.1 END AS s FROM events),
x AS (SELECT *, CASE WHEN b = 0 THEN 'state_limit' WHEN a % 13 = 0 AND b = 2 THEN 'missing_decision' WHEN a % 7 = 0 AND b = 3 THEN 'timeout' WHEN a % 11 = 0 AND b = 1 THEN 'model_mismatch' END AS r FROM c), f AS (SELECT a, min(b) FILTER (r IS NOT NULL) AS stop, arg_min(r, b) FILTER (r IS NOT NULL) AS reason, bool_or(s <= 0.35) AS bad, bool_and(s >= 0.65) AS good FROM x GROUP BY a)
SELECT a AS answer_id, CASE WHEN reason IS NOT NULL THEN 'inconclusive' WHEN bad THEN 'rejected' WHEN good THEN 'supported' ELSE 'inconclusive' END AS status, reason, (SELECT count(*) FROM x WHERE x.a = f.a AND (f.stop IS NULL OR x.b < f.stop)) AS judged FROM f""",
    "documentation_tasks": """WITH f AS (SELECT conv_id, coalesce(string_agg(DISTINCT 'f' || (turn % 4), ',' ORDER BY 'f' || (turn % 4)) FILTER (turn % 2 = 1), '') AS i FROM conversations WHERE turn > 0 AND conv_id % 3 < 2 GROUP BY 1), b AS (SELECT conv_id, coalesce(string_agg(DISTINCT role || '.md', ',' ORDER BY role || '.md'), '') AS s FROM conversations WHERE turn > 0 AND conv_id % 4 < 3 GROUP BY 1)
SELECT c.conv_id AS query_id, sha256(left(coalesce(text, ''), 1500)) AS query, i AS feedback_item_ids, s AS base_sources, 'scoped feedback differs from the corpus' AS reason, 'OPEN' AS status FROM conversations c JOIN f USING (conv_id) JOIN b USING (conv_id) WHERE turn = 0""",
}
