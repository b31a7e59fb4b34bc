"""Ingestion, dataset, preservation and search-policy queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexoria.functions import text as tx
from lexoria.functions import vectors as vx
from lexoria.operators import dataset, ingest, preservation, retrieval, review
from lexoria.sources import corpus

from .q_retrieval import base_sql, corpus_sql

t = corpus.table

BY_NAME = [("src1 en", "sales"), ("src2", "finance")]
BY_WORD = [("que", "support"), ("und", "finance"), ("the", "general_english")]


def modules(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 9 == 0, "SQL").otherwise("md")
    base = ingest.infer_module(F.col("source"), F.col("lang"), F.lit(""), kind, BY_NAME, BY_WORD)
    return d.select("doc_id", base.alias("module"), ingest.section_module(base, F.col("lang"), F.col("text"), BY_NAME, BY_WORD).alias("section_module"))


def retrieval_texts(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    found = {"tables": F.slice(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{7,}"), F.lit(0)), 1, 20), "statuses": F.array(F.col("lang"), F.lit(" "))}
    text = ingest.section_retrieval_text(F.col("source"), F.col("lang"), F.lit("m"), F.lit("general"), F.when(F.col("doc_id") % 2 == 0, "ctx").otherwise(" "), found, F.col("text"))
    return d.select("doc_id", F.sha2(text, 256).alias("digest"), F.length(text).alias("chars"))


def hashes(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    return d.select("doc_id", ingest.processing_hash(title=F.col("source"), content=tx.content_hash(F.col("text")), doc_type=F.col("lang")).alias("processing_hash"), preservation.canonical_hash(a=F.col("n_chars"), b=F.lit(None)).alias("snapshot_hash"))


def ingest_run(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("f"), "doc_id").alias("filename"), F.col("lang").alias("title"), F.lit("md").alias("doc_type"), "text")
    made = ingest.processing_hash(content=tx.content_hash(F.col("text")), title=F.col("title"), doc_type=F.col("doc_type"))
    old = d.filter("doc_id % 3 <> 0").select("filename", F.when(F.col("doc_id") % 5 == 0, "changed").otherwise(made).alias("processing_hash"), F.col("doc_id").alias("created_at"))
    chunks = d.filter("doc_id % 3 <> 0").select("filename", F.lit(0).alias("chunk_index"), F.col("text").alias("content"), F.array(F.lit(1.0)).alias("embedding"))
    documents, rows = ingest.ingest_documents(d, old, chunks)
    n = rows.groupBy("filename").agg(F.count("*").alias("n_chunks"), F.count("embedding").alias("n_vectors"))
    # Chunk boundaries are the splitter's own; what SQL can tell is who has chunks and vectors.
    return documents.join(n, "filename", "left").select("filename", "action", "reuse_from", (F.coalesce("n_chunks", F.lit(0)) > 0).alias("has_chunks"), (F.coalesce("n_vectors", F.lit(0)) > 0).alias("has_vectors"))


def _lines(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    marked = F.concat(F.lit("## "), "source", F.lit(" {#s}\n\n"), "text")
    return d.select("doc_id", preservation.body_lines(marked).alias("source"), preservation.body_lines(F.when(F.col("doc_id") % 3 == 0, F.replace(marked, F.lit("the "), F.lit("THE "))).otherwise(marked)).alias("target"))


def body(spark, sf_dir):
    x = _lines(spark, sf_dir)
    return x.select("doc_id", F.size("source").alias("lines"), F.col("source")[0].alias("first"), F.sha2(F.array_join(F.transform("source", preservation.normal_line), "\n"), 256).alias("digest"))


def ordered_diff(spark, sf_dir):
    x = _lines(spark, sf_dir)
    return x.select("doc_id", F.size(preservation.missing_in_order(F.col("source"), F.col("target"))).alias("lost"))


def listings(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    return preservation.section_counts(d.withColumnRenamed("lang", "module").withColumnRenamed("source", "answer_mode"))


def sort_keys(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    number, text = preservation.numeric_sort_key(F.when(F.col("p_partkey") % 7 == 0, " none ").otherwise(F.col("p_brand")))
    return p.select("p_partkey", number.alias("number"), text.alias("text"))


def priority_listing(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select((F.col("n_chars") % 5).alias("priority"), F.concat(F.lit("f"), "doc_id").alias("filename"))
    return preservation.priority_report(d)


def filled(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.col("lang")).alias("module"), F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")).alias("size"))
    donors = t(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), "quality").alias("module"), F.col("toxic").cast("long").alias("size"))
    return preservation.backfill(d, donors, "doc_id", ["module", "size"])


def identity_arrays(spark, sf_dir):
    turns = t(spark, sf_dir, "conversations")
    return preservation.ordered_json(turns, "conv_id", "turn", ["turn", "role"])


def _cases(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("doc_id") % len(v) + 1).cast("int"))
    return d.select(
        (F.col("doc_id") + 1).cast("int").alias("position"), F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("c"), "doc_id")).alias("id"), F.when(F.col("doc_id") % 10 == 0, "  ").otherwise(F.concat(F.initcap("lang"), F.lit(" "), F.col("n_chars") % 50)).alias("question"),
        pick("clarify", "No_Answer", "other", None, "partial_abstain").alias("expected_behavior"), pick("", " Sql ", None).alias("expected_intent"), pick("a", None, "").alias("source"), pick("holdout", "x").alias("split"), pick(None, "ambiguous", "?").alias("answerability"),
    )


def normal(spark, sf_dir):
    return dataset.normal_cases(_cases(spark, sf_dir), "merged")


def unique_cases(spark, sf_dir):
    return dataset.distinct_cases(_cases(spark, sf_dir)).select("position", "question")


def gap_cases(spark, sf_dir):
    from .q_lifecycle import gaps_top

    g = gaps_top(spark, sf_dir).withColumn("place", F.expr("row_number() OVER (ORDER BY occurrences DESC, query)"))  # ten rows
    return dataset.cases_from_gaps(g, 5)


def judgments(spark, sf_dir):
    lab = t(spark, sf_dir, "labels")
    q = lab.select((F.col("doc_id") % 20).alias("case_id"), F.when(F.col("doc_id") % 31 == 0, " ").otherwise(F.concat(F.lit(" d"), F.col("doc_id") % 700)).alias("candidate_id"), F.when(F.col("doc_id") % 17 == 0, "x").otherwise((F.col("quality") * 2 + F.col("toxic") * 3).cast("string")).alias("relevance"))
    return dataset.judgment_problems(q)


def identity_paths(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    made = F.to_json(F.struct(F.col("source").alias("name"), F.struct(F.struct(F.col("n_chars").alias("id")).alias("region"), F.array("doc_id").alias("keys")).alias("geo"), F.lit("x").alias("fingerprint_sha256")))
    return dataset.flat_identity(d.select(F.col("doc_id").alias("id"), made.alias("identity")))


def answer_states(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    answer = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" I do not know. "), "text")).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("Qual VERSÃO? "), "lang")).otherwise(F.col("text"))
    out = dataset.abstained(answer, F.col("doc_id") % 11 == 0, "I do not know")
    errors = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("no_citation"))).otherwise(F.array().cast("array<string>"))
    wanted = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("src1"), F.lit("src2")))
    return d.select(
        "doc_id", out.alias("abstained"), dataset.clarified(answer, F.when(F.col("doc_id") % 13 == 0, "clarification_needed"), r"\b(qual|versao)\b").alias("clarified"),
        dataset.grounded(out, errors, F.when(F.col("doc_id") % 2 == 0, "no_chunks").otherwise("other")).alias("grounded"), dataset.citation_validity(out, errors, F.array("source"), wanted).alias("valid"),
        dataset.reviewed_coverage(F.col("n_chars") / 10.0, F.when(F.col("doc_id") % 2 == 0, "approved")).alias("coverage"),
    )


def names(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    title = F.concat(F.lit("Relatório com "), "p_brand", F.lit(" — "), "p_type")
    return p.select("p_partkey", tx.title_filename(title, 40).alias("filename"), F.array_join(tx.table_tokens(F.concat(F.lit("ped_item, abc xyz.t1 pc"), "p_partkey", F.lit(" ab ped_item Ação cfg")), ["PC"], ["CFG"]), ",").alias("tokens"))


def small_parsers(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    stamp = F.when(F.col("event_id") % 3 == 0, "2024-05-06T07:08:09Z").when(F.col("event_id") % 3 == 1, "2024-05-06 07:08:09").otherwise("2024-05-06T07:08:09+02:00")
    scope = F.create_map(F.lit("level"), F.concat(F.lit(" "), "event_type", F.lit(" ")), F.lit("other"), F.lit("x"), F.lit("tenant"), F.when(F.col("event_id") % 2 == 0, " ").otherwise("t"))
    reply = F.concat(F.lit("```json\nSure: "), F.when(F.col("event_id") % 2 == 0, F.lit('{"a": [1]}')).when(F.col("event_id") % 5 == 0, "none").otherwise('[{"b": 2}] '), F.lit("\n```"))
    clean = tx.normal_scope(scope, ["level", "tenant"])
    return e.select("event_id", F.unix_seconds(tx.iso_instant(stamp)).alias("at"), F.array_join(F.transform(F.array_sort(F.map_entries(clean)), lambda x: F.concat_ws("=", x["key"], x["value"])), ",").alias("scope"), tx.first_filled(F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("event_type")), scope, "other").alias("filled"), tx.json_fragment(reply).alias("fragment"))


def literals(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    # The product of a float and an integer would be a double, and round otherwise than the vectors' own precision.
    return e.select("vec_id", vx.vector_literal(F.transform("embedding", lambda x: F.round(x * F.lit(100).cast("float")).cast("int"))).alias("literal"))


def postprocessed(spark, sf_dir):
    base = retrieval.base_rows(corpus.chunks(spark, sf_dir), corpus.questions(spark, sf_dir))
    near = retrieval.top(base, "position", [F.col("similarity").desc(), F.col("id")], 60).select("query_id", "id", "position", "similarity", F.when(F.col("query_id") == 2, F.col("position")).alias("retrieval_rank"))
    return retrieval.postprocess(near, 8, 0.35, ranked=True).select("query_id", "id", "place")


def filters(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    plan = d.select(F.col("doc_id").alias("query_id"), F.array(F.upper("lang"), F.concat(F.lit(" "), "lang"), F.lit(" "), F.initcap("source")).alias("doc_types"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("A"), F.lit("b"))).alias("modules"))
    out = retrieval.search_filters(plan)
    return out.select("query_id", F.array_join("doc_types", ",").alias("doc_types"), F.array_join("modules", ",").alias("modules"))


def reviewed(spark, sf_dir):
    """Tokens of whole messages as answers; their places have no SQL, tests compare them with plain Python."""
    x = review.review_tokens(t(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text", "x")
    return x.select("conv_id", "turn", F.size("x").alias("tokens"), F.size(F.filter("x", lambda k: k["technical"])).alias("technical"), F.sha2(F.to_json("x"), 256).alias("digest"))


QUERIES = {
    "review_tokens": reviewed, "module_inference": modules, "section_retrieval_text": retrieval_texts, "processing_hash": hashes, "ingest_run": ingest_run, "body_lines": body, "missing_in_order": ordered_diff, "section_counts": listings, "numeric_sort_key": sort_keys, "priority_report": priority_listing,
    "backfill": filled, "ordered_json": identity_arrays, "normal_cases": normal, "distinct_cases": unique_cases, "cases_from_gaps": gap_cases, "judgment_problems": judgments, "flat_identity": identity_paths, "answer_states": answer_states,
    "title_filename": names, "small_parsers": small_parsers, "vector_literal": literals, "postprocess_results": postprocessed, "search_filters": filters,
}

_F = "trim(regexp_replace(translate(lower({0}), 'áàâãäåçéèêëíìîïñóòôõöúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', ' ', 'g'))"
_HASH = "sha256(regexp_replace(text, '\\r\\n?', chr(10), 'g'))"
_MODULE = "CASE WHEN contains({j}, 'src1 en') THEN 'sales' WHEN contains({j}, 'src2') THEN 'finance' WHEN {sql} THEN 'sql' WHEN contains(' ' || {j} || ' ', ' que ') THEN 'support' WHEN contains(' ' || {j} || ' ', ' und ') THEN 'finance' WHEN contains(' ' || {j} || ' ', ' the ') THEN 'general_english' ELSE 'geral' END"
_PROC = f"sha256('content=' || {_HASH} || chr(31) || 'doc_type=' || {{t}} || chr(31) || 'title=' || {{h}})"
_LINES = """l AS (SELECT doc_id, list_transform(list_filter(string_split_regex(m, '\\r\\n|\\r|\\n'), lambda x: trim(x) <> ''), lambda x: CASE WHEN regexp_matches(x, '^[ \\t]{0,3}#{1,6}[ \\t]+(.+)') THEN 'heading: ' || trim(regexp_replace(regexp_extract(x, '^[ \\t]{0,3}#{1,6}[ \\t]+(.+)', 1), '[ \\t]+\\{#[a-z][a-z0-9-]*\\}[ \\t]*$', '')) ELSE regexp_replace(x, '\\s+$', '') END) AS s FROM (SELECT doc_id, '## ' || source || ' {#s}' || chr(10) || chr(10) || text AS m FROM documents))"""
_CASE = """c AS (SELECT (doc_id + 1)::INTEGER AS position, CASE WHEN doc_id % 4 > 0 THEN 'c' || doc_id END AS id, CASE WHEN doc_id % 10 = 0 THEN '' ELSE upper(left(lang, 1)) || substr(lang, 2) || ' ' || (n_chars % 50) END AS question,
['clarify', 'no_answer', 'exact_answer', 'exact_answer', 'partial_abstain'][(doc_id % 5 + 1)::INTEGER] AS expected_behavior, CASE WHEN doc_id % 3 = 1 THEN 'sql' ELSE 'general' END AS expected_intent, CASE WHEN doc_id % 3 = 0 THEN 'a' ELSE 'merged' END AS source, CASE WHEN doc_id % 2 = 0 THEN 'holdout' ELSE 'development' END AS split, doc_id % 3 = 1 AS amb FROM documents),
n AS (SELECT position, coalesce(id, 'case-' || lpad(position::VARCHAR, greatest(4, length(position::VARCHAR))::INTEGER, '0')) AS id, question, expected_behavior, expected_intent, source, split, CASE WHEN amb THEN 'ambiguous' WHEN expected_behavior = 'clarify' THEN 'ambiguous' WHEN expected_behavior = 'no_answer' THEN 'no_evidence' ELSE 'answerable' END AS answerability FROM c WHERE question <> '')"""

ORACLES = {
    "module_inference": f"""WITH d AS (SELECT doc_id, {_F.format("source || ' ' || lang || '  ' || CASE WHEN doc_id % 9 = 0 THEN 'SQL' ELSE 'md' END")} AS j, {_F.format("' ' || lang || ' ' || left(text, 800) || ' md'")} AS k FROM documents), b AS (SELECT *, {_MODULE.format(j='j', sql='doc_id % 9 = 0')} AS module, {_MODULE.format(j='k', sql='FALSE')} AS own FROM d)
SELECT doc_id, module, CASE WHEN own <> 'geral' THEN own ELSE module END AS section_module FROM b""",
    "section_retrieval_text": """WITH d AS (SELECT doc_id, source, lang, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS l, list_slice(regexp_extract_all(text, '[A-Z][a-z]{7,}'), 1, 8) AS e FROM documents),
x AS (SELECT doc_id, concat_ws(chr(10), 'Documento: ' || source, 'Secao: ' || lang, 'Modulo: m', 'Modo de resposta: general', CASE WHEN doc_id % 2 = 0 THEN 'ctx' END, CASE WHEN len(e) > 0 THEN 'Tabelas: ' || array_to_string(e, ', ') END, 'Status: ' || lang, CASE WHEN l <> '' THEN 'Trecho da secao: ' || CASE WHEN length(l) > 900 THEN trim(regexp_replace(left(l, 900), ' [^ ]*$', '')) || '...' ELSE l END END) AS t FROM d)
SELECT doc_id, sha256(t) AS digest, length(t)::INTEGER AS chars FROM x""",
    "processing_hash": f"SELECT doc_id, {_PROC.format(t='lang', h='source')} AS processing_hash, sha256('a=' || n_chars || chr(31) || 'b=<null>') AS snapshot_hash FROM documents",
    "ingest_run": f"""WITH d AS (SELECT doc_id, 'f' || doc_id AS filename, {_PROC.format(t="'md'", h='lang')} AS h, text FROM documents), e AS (SELECT doc_id, filename, CASE WHEN doc_id % 5 = 0 THEN 'changed' ELSE h END AS h FROM d WHERE doc_id % 3 <> 0),
j AS (SELECT d.filename, d.text, d.h IS NOT DISTINCT FROM o.h AS same, (SELECT arg_min(e.filename, e.doc_id) FROM e WHERE e.h = d.h AND e.filename <> d.filename) AS donor FROM d LEFT JOIN e o ON o.filename = d.filename)
SELECT filename, CASE WHEN same THEN 'skip' WHEN donor IS NOT NULL THEN 'reuse' ELSE 'embed' END AS action, CASE WHEN NOT same THEN donor END AS reuse_from, NOT same AND trim(text) <> '' AS has_chunks, NOT same AND donor IS NOT NULL AS has_vectors FROM j""",
    "body_lines": f"WITH {_LINES} SELECT doc_id, len(s)::INTEGER AS lines, s[1] AS first, sha256(array_to_string(list_transform(s, lambda x: trim(regexp_replace(lower(x), '\\s+', ' ', 'g'))), chr(10))) AS digest FROM l",
    "missing_in_order": f"""WITH {_LINES}, p AS (SELECT doc_id, s, list_position(list_transform(s, lambda x: doc_id % 3 = 0 AND contains(x, 'the ')), TRUE) AS k FROM l) SELECT doc_id, CASE WHEN coalesce(k, 0) = 0 THEN 0 ELSE len(s) - k + 1 END::INTEGER AS lost FROM p""",
    "section_counts": "SELECT 'module' AS kind, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'answer_mode', source, count(*) FROM documents GROUP BY source",
    "numeric_sort_key": "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 999999999 ELSE coalesce(nullif(regexp_replace(p_brand, '\\D+', '', 'g'), '')::BIGINT, 999999999) END AS number, CASE WHEN p_partkey % 7 = 0 THEN 'none' ELSE trim(p_brand) END AS text FROM part",
    "priority_report": "SELECT n_chars % 5 AS priority, 'f' || doc_id AS filename FROM documents ORDER BY priority DESC, filename",
    "backfill": "SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 1 THEN lang ELSE 'q' || l.quality END AS module, CASE WHEN d.doc_id % 2 = 0 THEN n_chars ELSE l.toxic END AS size FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "ordered_json": """SELECT conv_id, '[' || string_agg('{"turn":' || turn || ',"role":"' || role || '"}', ',' ORDER BY turn) || ']' AS items FROM conversations GROUP BY conv_id""",
    "normal_cases": f"WITH {_CASE} SELECT * FROM n",
    "distinct_cases": f"WITH {_CASE} SELECT position, question FROM n QUALIFY row_number() OVER (PARTITION BY {_F.format('question')} ORDER BY position) = 1",
    "cases_from_gaps": """WITH g AS (SELECT event_type || ' ' || (user_id % 20) AS query, count(*) AS n, max(ts) AS last_seen FROM events GROUP BY 1), t AS (SELECT * FROM g ORDER BY n DESC, last_seen DESC, query LIMIT 10), r AS (SELECT query, row_number() OVER (ORDER BY n DESC, query) AS place FROM t)
SELECT 'kgap-' || lpad(place::VARCHAR, 4, '0') AS id, query AS question, 'no_answer' AS expected_behavior, 'general' AS expected_intent, 'knowledge_gap' AS source, 'development' AS split, 'no_evidence' AS answerability, 'pending_human' AS review FROM r WHERE place <= 5""",
    "judgment_problems": """WITH q AS (SELECT doc_id % 20 AS case_id, CASE WHEN doc_id % 31 = 0 THEN '' ELSE 'd' || (doc_id % 700) END AS candidate_id, doc_id % 17 = 0 OR quality * 2 + toxic * 3 > 3 AS bad FROM labels), x AS (SELECT *, count(*) OVER (PARTITION BY case_id, candidate_id) AS times FROM q)
SELECT case_id, candidate_id, CASE WHEN candidate_id = '' THEN 'blank_candidate' WHEN bad THEN 'relevance_out_of_range' ELSE 'duplicate_candidate' END AS problem FROM x WHERE candidate_id = '' OR bad OR times > 1""",
    "flat_identity": "SELECT doc_id AS id, 'name' AS path, source AS value FROM documents UNION ALL SELECT doc_id, 'geo.region.id', n_chars::VARCHAR FROM documents UNION ALL SELECT doc_id, 'geo.keys', '[' || doc_id || ']' FROM documents",
    "answer_states": f"""WITH a AS (SELECT *, doc_id % 4 = 0 OR doc_id % 11 = 0 AS ab, CASE WHEN doc_id % 4 = 1 THEN 'qual versao ' || lang WHEN doc_id % 4 = 0 THEN {_F.format("' I do not know. ' || text")} ELSE {_F.format('text')} END AS f, doc_id % 4 = 1 OR contains(text, '?') AS q FROM documents)
SELECT doc_id, ab AS abstained, doc_id % 13 = 0 OR (q AND regexp_matches(f, '\\b(qual|versao)\\b')) AS clarified, doc_id % 3 <> 0 OR (ab AND doc_id % 2 = 0) AS grounded, CASE WHEN NOT ab AND doc_id % 5 <> 0 THEN doc_id % 3 <> 0 AND source IN ('src1', 'src2') END AS valid, CASE WHEN doc_id % 2 = 0 THEN n_chars / 10.0::DOUBLE END AS coverage FROM a""",
    "title_filename": """SELECT p_partkey, left(regexp_replace(regexp_replace(regexp_replace(upper('relatorio com ' || lower(p_brand) || ' — ' || lower(p_type)), '\\bCOM\\b', ' ', 'g'), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 40) AS filename, 'PED_ITEM,XYZ.T1,PC' || p_partkey || ',CFG' AS tokens FROM part""",
    "small_parsers": """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 1714979289 WHEN 2 THEN 1714972089 END::BIGINT AS at, 'level=' || event_type || CASE WHEN event_id % 2 = 0 THEN '' ELSE ',tenant=t' END AS scope, CASE WHEN event_id % 4 = 0 THEN 'x' ELSE event_type END AS filled,
CASE WHEN event_id % 2 = 0 THEN '[1]' WHEN event_id % 5 = 0 THEN 'Sure: none' ELSE '[{"b": 2}]' END AS fragment FROM events""",
    "vector_literal": "SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: (CASE WHEN x < 0 THEN -floor(abs(x * 100::FLOAT)::DOUBLE + 0.5) ELSE floor((x * 100::FLOAT)::DOUBLE + 0.5) END)::INTEGER), ',') || ']' AS literal FROM embeddings",
    "postprocess_results": f"""WITH {corpus_sql()}, {base_sql()}, n AS (SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS position FROM base QUALIFY position <= 60)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN query_id = 2 THEN 0 ELSE -similarity END, position)::INTEGER AS place FROM n WHERE query_id = 2 OR similarity >= 0.35 * 0.7 QUALIFY place <= 16""",
    "search_filters": "SELECT doc_id AS query_id, lang || ',' || source AS doc_types, CASE WHEN doc_id % 2 = 0 THEN 'a,b' ELSE '' END AS modules FROM documents",
}
