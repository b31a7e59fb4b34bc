"""Table access, lifecycle and aggregation queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexoria.functions import text as tx
from lexoria.operators import inventory as iv
from lexoria.operators import lifecycle as lc
from lexoria.sources import corpus, tables

t = corpus.table


def table_select(spark, sf_dir):
    return tables.select(t(spark, sf_dir, "customer"), "c_custkey, c_name, c_acctbal", {"c_mktsegment": "in.(BUILDING,MACHINERY)", "c_acctbal": "gte.1000", "c_name": "ilike.%1%"}, "c_acctbal.desc,c_custkey", 50)


def table_update(spark, sf_dir):
    return tables.update(t(spark, sf_dir, "supplier"), {"s_acctbal": 0.0}, {"s_nationkey": "lt.10", "s_acctbal": "lt.0"})


def table_delete(spark, sf_dir):
    return tables.delete(t(spark, sf_dir, "supplier"), {"s_nationkey": "in.(1,2,3)"})


def table_insert(spark, sf_dir):
    return tables.insert(t(spark, sf_dir, "region"), [{"r_regionkey": 90, "r_name": "NORTH"}, {"r_regionkey": 91, "r_name": "SOUTH"}])


def stats(spark, sf_dir):
    return iv.counts({"documents": t(spark, sf_dir, "documents"), "chunks": t(spark, sf_dir, "embeddings")})


def identity(spark, sf_dir):
    return lc.fingerprint(t(spark, sf_dir, "documents"), ["doc_id", "lang", "source", "n_chars", "text"])


def ingest_plan(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select(F.concat(F.lit("f"), F.col("doc_id")).alias("filename"), tx.content_hash(F.col("text")).alias("processing_hash"), F.col("doc_id").alias("created_at"))
    return lc.plan_ingest(d.select("filename", F.when(F.col("created_at") % 11 == 0, "changed").otherwise(F.col("processing_hash")).alias("processing_hash")), d.filter("created_at % 4 <> 0"))


def duplicate_content(spark, sf_dir):
    return lc.duplicates(t(spark, sf_dir, "documents").select(tx.content_hash(F.col("text")).alias("content_hash")), "content_hash")


def revision_guard(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    e = p.select(F.col("p_partkey").alias("canonical_id"), (F.col("p_size") % 5).alias("revision"), F.col("p_brand").alias("content_hash")).filter("canonical_id % 3 > 0")
    i = p.select(F.col("p_partkey").alias("canonical_id"), (F.col("p_partkey") % 5).cast("int").alias("revision"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_type")).alias("content_hash"))
    return lc.check_revision(e, i)


def structural_diff(spark, sf_dir):
    l = t(spark, sf_dir, "lineitem")  # noqa: E741
    items = l.select(F.col("l_orderkey").alias("unit_id"), F.when(F.col("l_linenumber") % 2 == 0, "table").otherwise("code").alias("category"), (F.col("l_partkey") % 7).cast("string").alias("item"), "l_linenumber", "l_returnflag")
    return lc.losses(items, items.filter("l_returnflag <> 'R'"), ["table", "code"])


def manifest_diff(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    return lc.selection_diff(d.filter("doc_id % 3 = 0").select("doc_id"), d.filter("doc_id % 2 = 0").select("doc_id"), "doc_id")


def manifest_gate(spark, sf_dir):
    d, lab = t(spark, sf_dir, "documents"), t(spark, sf_dir, "labels")
    return iv.published_only(d, lab.filter("quality = 1")).select("doc_id", "source")


def review_states(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    steps = F.element_at(F.create_map(*[F.lit(x) for p in {"click": "APPROVE", "view": "SUBMIT", "purchase": "PUBLISH", "signup": "REJECT"}.items() for x in p]), F.col("event_type"))
    return lc.fold_reviews(e.select(F.col("user_id").alias("item_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.coalesce(steps, F.lit("SUBMIT")).alias("action")))


def review_pending(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.when(F.col("o_orderstatus") == "O", "PENDING").otherwise("APPROVED").alias("status"), F.col("o_orderdate").alias("created_at"))
    return lc.pending(o, 500).select("item_id")


def gaps(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    log = e.select(F.concat_ws(" ", "event_type", (F.col("user_id") % 20).cast("string")).alias("query"), F.col("value").alias("similarity"), F.concat(F.lit("p"), (F.col("event_id") % 3).cast("string")).alias("platform"), "ts", F.col("event_id").alias("seq"))
    return lc.knowledge_gaps(log)


def gaps_top(spark, sf_dir):
    return lc.top_gaps(gaps(spark, sf_dir), 10).select("query", "occurrences", "platform")


def priorities(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lpad((F.col("doc_id") % 9).cast("string"), 2, "0"), F.lit("-"), F.when(F.col("doc_id") % 4 == 0, "FAQ").otherwise("text"), F.when(F.col("doc_id") % 3 == 0, ".md").otherwise(".txt")).alias("filename"), (F.col("n_chars") / 10).cast("int").alias("chunk_count"))
    return d.select("doc_id", lc.stored_priority().alias("stored"), lc.inferred_priority().alias("inferred"))


def identities(spark, sf_dir):
    n = t(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("scope"), F.lit("p").alias("provider"), F.col("source").alias("model"), F.lit(64).alias("dimensions"), F.lit("v1").alias("version"), "doc_id")
    return lc.ensure_identity(n.filter("doc_id % 3 > 0"), n.withColumn("version", F.when(F.col("doc_id") % 4 == 0, "v2").otherwise("v1")))


def usage(spark, sf_dir):
    l = t(spark, sf_dir, "lineitem")  # noqa: E741
    calls = l.select(F.col("l_returnflag").alias("stage"), F.concat_ws("-", "l_orderkey", (F.col("l_linenumber") % 3)).alias("call_id"), F.when(F.col("l_linestatus") == "O", F.col("l_quantity").cast("long")).alias("tokens"), F.col("l_discount").alias("cost"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return lc.usage_ledger(calls, ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "cost"])


def failure_report(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    r = e.select((F.col("user_id") % 50).alias("filename"), (F.col("event_id") % 4).alias("failed_chunks"), "event_id")
    return tables.upsert_latest(r, "filename", "event_id").filter("failed_chunks > 0").select("filename", "failed_chunks")


def inventory(spark, sf_dir):
    return iv.corpus_inventory(t(spark, sf_dir, "documents"))


def inverted_index(spark, sf_dir):
    return iv.token_index(t(spark, sf_dir, "documents"), r"[\p{L}\p{N}]+", 3)


def keyword_top(spark, sf_dir):
    return iv.keyword_top(t(spark, sf_dir, "documents"))


QUERIES = {
    "table_select": table_select, "table_update": table_update, "table_delete": table_delete, "table_insert": table_insert, "get_stats": stats, "data_identity": identity, "ingest_plan": ingest_plan, "duplicate_content": duplicate_content,
    "revision_guard": revision_guard, "structural_diff": structural_diff, "manifest_diff": manifest_diff, "manifest_gate": manifest_gate, "feedback_review_states": review_states, "list_pending_feedback": review_pending, "knowledge_gaps": gaps,
    "top_knowledge_gaps": gaps_top, "priority_rules": priorities, "embedding_index_identity": identities, "usage_ledger": usage, "failure_report": failure_report, "corpus_inventory": inventory, "inverted_index": inverted_index, "keyword_top_k": keyword_top,
}

_HASH = "sha256(regexp_replace(text, '\\r\\n?', chr(10), 'g'))"
_GAPS = "g AS (SELECT event_type || ' ' || (user_id % 20) AS query, count(*) AS occurrences, max(value) AS max_similarity, arg_max('p' || (event_id % 3), (ts, event_id)) AS platform, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1)"
_NAME = "(lpad((doc_id % 9)::VARCHAR, 2, '0') || '-' || CASE WHEN doc_id % 4 = 0 THEN 'FAQ' ELSE 'text' END || CASE WHEN doc_id % 3 = 0 THEN '.md' ELSE '.txt' END)"

ORACLES = {
    "table_select": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 1000 AND c_name ILIKE '%1%' ORDER BY c_acctbal DESC, c_custkey LIMIT 50",
    "table_update": "SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_nationkey < 10 AND s_acctbal < 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier",
    "table_delete": "SELECT * FROM supplier WHERE s_nationkey NOT IN (1, 2, 3)",
    "table_insert": "SELECT * FROM region UNION ALL SELECT 90, 'NORTH' UNION ALL SELECT 91, 'SOUTH'",
    "get_stats": "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM embeddings) AS chunks",
    "data_identity": """WITH h AS (SELECT sha256(concat_ws(chr(31), coalesce(doc_id::VARCHAR, '<null>'), coalesce(lang, '<null>'), coalesce(source, '<null>'), coalesce(n_chars::VARCHAR, '<null>'), coalesce(text, '<null>'))) AS h FROM documents),
p AS (SELECT left(h, 2) AS p, sha256(string_agg(h, chr(10) ORDER BY h)) AS ph, count(*) AS n FROM h GROUP BY 1) SELECT sum(n)::BIGINT AS rows, sha256(string_agg(ph, chr(10) ORDER BY p)) AS fingerprint FROM p""",
    "ingest_plan": f"""WITH d AS (SELECT 'f' || doc_id AS filename, {_HASH} AS h, doc_id FROM documents), i AS (SELECT filename, CASE WHEN doc_id % 11 = 0 THEN 'changed' ELSE h END AS h FROM d), e AS (SELECT * FROM d WHERE doc_id % 4 <> 0),
j AS (SELECT i.filename, i.h IS NOT DISTINCT FROM o.h AS same, (SELECT arg_min(e.filename, e.doc_id) FROM e WHERE e.h = i.h AND e.filename <> i.filename) AS donor FROM i LEFT JOIN e o ON o.filename = i.filename)
SELECT filename, CASE WHEN same THEN 'skip' WHEN donor IS NOT NULL THEN 'reuse' ELSE 'embed' END AS action, CASE WHEN NOT same THEN donor END AS reuse_from FROM j""",
    "duplicate_content": f"SELECT {_HASH} AS content_hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "revision_guard": """WITH e AS (SELECT p_partkey AS c, p_size % 5 AS r, p_brand AS h FROM part WHERE p_partkey % 3 > 0), i AS (SELECT p_partkey AS c, p_partkey % 5 AS r, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END AS h FROM part)
SELECT i.c AS canonical_id, CASE WHEN e.r IS NULL THEN 'new' WHEN i.r < e.r THEN 'older_revision' WHEN i.r = e.r AND i.h <> e.h THEN 'changed_without_revision' WHEN i.r = e.r THEN 'unchanged' ELSE 'newer' END AS verdict FROM i LEFT JOIN e ON e.c = i.c""",
    "structural_diff": """WITH s AS (SELECT l_orderkey AS unit_id, CASE WHEN l_linenumber % 2 = 0 THEN 'table' ELSE 'code' END AS category, (l_partkey % 7)::VARCHAR AS item, l_returnflag FROM lineitem),
x AS (SELECT unit_id, category, item FROM s EXCEPT ALL SELECT unit_id, category, item FROM s WHERE l_returnflag <> 'R') SELECT unit_id, category, count(*) AS lost FROM x GROUP BY ALL""",
    "manifest_diff": "SELECT doc_id, 'missing' AS problem FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 <> 0 UNION ALL SELECT doc_id, 'extra' FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0",
    "manifest_gate": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "feedback_review_states": """WITH RECURSIVE e AS (SELECT user_id AS item_id, CASE event_type WHEN 'click' THEN 'APPROVE' WHEN 'purchase' THEN 'PUBLISH' WHEN 'signup' THEN 'REJECT' ELSE 'SUBMIT' END AS action, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT DISTINCT item_id, 0::BIGINT AS i, 'PENDING' AS status, 0 AS published, 0 AS bad FROM e UNION ALL
SELECT e.item_id, e.i, CASE WHEN e.action = 'APPROVE' AND w.status IN ('PENDING', 'REJECTED') THEN 'APPROVED' WHEN e.action = 'REJECT' AND w.status IN ('PENDING', 'APPROVED') THEN 'REJECTED' WHEN e.action = 'PUBLISH' AND w.status IN ('APPROVED', 'PUBLISHED') THEN 'PUBLISHED' ELSE w.status END,
 w.published + CASE WHEN e.action = 'PUBLISH' AND w.status IN ('APPROVED', 'PUBLISHED') THEN 1 ELSE 0 END,
 w.bad + CASE WHEN (e.action = 'APPROVE' AND w.status NOT IN ('PENDING', 'REJECTED')) OR (e.action = 'REJECT' AND w.status NOT IN ('PENDING', 'APPROVED')) OR (e.action = 'PUBLISH' AND w.status NOT IN ('APPROVED', 'PUBLISHED')) THEN 1 ELSE 0 END
 FROM w JOIN e ON e.item_id = w.item_id AND e.i = w.i + 1) SELECT item_id, status, published, bad AS rejected_steps FROM w QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY i DESC) = 1""",
    "list_pending_feedback": "SELECT o_orderkey AS item_id FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 200",
    "knowledge_gaps": f"WITH {_GAPS} SELECT * FROM g",
    "top_knowledge_gaps": f"WITH {_GAPS} SELECT query, occurrences, platform FROM g ORDER BY occurrences DESC, last_seen DESC, query LIMIT 10",
    "priority_rules": f"""WITH d AS (SELECT doc_id, {_NAME} AS f, (n_chars / 10)::DOUBLE AS x, floor(n_chars / 10)::INTEGER AS c FROM documents), p AS (SELECT *, regexp_matches(f, '^0[0-5]-') AND f LIKE '%.md' AS ten, contains(lower(f), 'faq') AS eight FROM d)
SELECT doc_id, CASE WHEN c > 400 THEN 3 WHEN ten THEN 10 WHEN eight THEN 8 ELSE 5 END AS stored, CASE WHEN ten THEN 10 WHEN eight THEN 8 WHEN c > 400 THEN 3 ELSE 5 END AS inferred FROM p""",
    "embedding_index_identity": "SELECT 'd' || doc_id AS scope, CASE WHEN doc_id % 3 = 0 THEN 'register' WHEN doc_id % 4 = 0 THEN 'mismatch' ELSE 'match' END AS verdict FROM documents",
    "usage_ledger": """WITH c AS (SELECT l_returnflag AS stage, CASE WHEN l_linestatus = 'O' THEN l_quantity::BIGINT END AS tokens, l_discount AS cost FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 3 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount) = 1)
SELECT stage, count(*) AS calls, sum(tokens)::BIGINT AS tokens, count(tokens) = count(*) AS complete, CASE WHEN count(cost) = count(*) THEN round(sum(cost), 6) END AS cost FROM c GROUP BY stage""",
    "failure_report": "WITH r AS (SELECT user_id % 50 AS filename, arg_max(event_id % 4, event_id) AS failed_chunks FROM events GROUP BY 1) SELECT * FROM r WHERE failed_chunks > 0",
    "corpus_inventory": "SELECT lang, count(*) AS n, count(*) FILTER (n_chars > 2000) AS long, count(*) FILTER (contains(text, '|')) AS with_tables, count(DISTINCT source) AS sources FROM documents GROUP BY lang",
    "inverted_index": """WITH t AS (SELECT DISTINCT doc_id, lang, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS token FROM documents)
SELECT token, count(*) AS n, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs, min(doc_id) AS first_doc FROM t GROUP BY token HAVING count(*) >= 3""",
    "keyword_top_k": """WITH t AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS token FROM documents), c AS (SELECT lang, token, count(*) AS n FROM t GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token)::INTEGER AS place FROM c QUALIFY place <= 12""",
}
