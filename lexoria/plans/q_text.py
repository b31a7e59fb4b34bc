"""Text, routing, parsing, grounding and streaming queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexoria.functions import text as tx
from lexoria.functions import vectors as vx
from lexoria.functions.vocabulary import ANSWER_MODE_TERMS, QUERY_ABBREVIATIONS
from lexoria.operators import grounding as gr
from lexoria.operators import markdown as md
from lexoria.operators import routing
from lexoria.sources import corpus
from lexoria.sources.shared import fresh_folder
from lexoria.streaming import extensions as st

t = corpus.table

#: A small keyword table of the registered routing query: (label, keyword).
KEYWORDS = [("sql_lookup", "this"), ("sql_lookup", "that"), ("integration", "the"), ("integration", "der"), ("troubleshooting", "token"), ("troubleshooting", "password"), ("configuration", "are"), ("process", "und"), ("process", "que")]


def url_functions(spark, sf_dir):
    u = F.col("url")
    return t(spark, sf_dir, "pages").select("page_id", tx.is_url(u).alias("is_url"), F.try_parse_url(u, F.lit("HOST")).alias("host"), tx.host_allowed(F.try_parse_url(u, F.lit("HOST")), ["example.com", "*.example.net"]).alias("allowed"), tx.title_from_url(u).alias("title"), tx.url_filename(u).alias("filename"))


def url_list(spark, sf_dir):
    """Distinct urls of text lines, by first occurrence."""
    found = t(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("url", F.lit(r"https?://[^\s/?#]+"), F.lit(0))).alias("url"), "page_id")
    return found.groupBy("url").agg(F.min("page_id").alias("first_page"))


def text_functions(spark, sf_dir):
    x = F.col("text")
    return t(spark, sf_dir, "documents").select("doc_id", tx.content_hash(x).alias("content_hash"), tx.word_count(x).alias("words"), tx.estimated_tokens(x).alias("tokens"), tx.slug(x).alias("slug"), tx.candidate_id(F.col("doc_id").cast("string"), F.col("source")).alias("candidate"), tx.opaque_id(F.col("source"), "source").alias("opaque"))


def folded(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.folded(F.col("text")), 256).alias("folded"))


def normalized(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.normalize_text(F.col("text")), 256).alias("normalized"))


def embedding_checks(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    spoilt = F.transform("embedding", lambda x, i: F.when((i == 3) & (F.col("vec_id") % 5 == 0), F.lit(float("nan"))).otherwise(x.cast("double")))
    return e.select("vec_id", F.round(vx.norm(vx.clean_vector(spoilt, corpus.DIMENSIONS)), 6).alias("norm"))


def safe_numbers(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", vx.safe_number(F.when(F.col("event_id") % 7 == 0, "x").when(F.col("event_id") % 5 == 0, None).otherwise(F.col("event_id").cast("string"))).alias("x"))


def intents(spark, sf_dir):
    q = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query_text"))
    return routing.classify_intent(q, spark.createDataFrame(KEYWORDS, "label string, keyword string"))


def answer_modes(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", routing.answer_mode(F.col("text")).alias("mode"))


def semantic_contexts(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", routing.semantic_context(F.col("source"), F.col("lang"), F.when(F.col("doc_id") % 2 == 0, "geral").otherwise("m"), routing.answer_mode(F.col("text"))).alias("context"))


def abbreviations(spark, sf_dir):
    asked = F.concat("text", F.lit("\tNF e  rca (Pdv) xNF nfe-NF"))
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(routing.expand_abbreviations(asked), 256).alias("q"))


def _marked(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.lit("# "), "source", F.lit("\n\n"), F.regexp_replace("text", r"\n", "\n## Part {#p}\n\n")).alias("text"))


def markdown_sections(spark, sf_dir):
    return md.sections(_marked(spark, sf_dir)).select("doc_id", "section_index", "level", "section_key", "heading_path", "line", F.length("content").alias("chars"))


def markdown_jumps(spark, sf_dir):
    return md.level_jumps(md.sections(_marked(spark, sf_dir).withColumn("text", F.replace("text", F.lit("## Part"), F.lit("### Part")))))


def text_chunks(spark, sf_dir):
    return md.chunks(t(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max(F.length("content")).alias("longest"), F.sum("token_count").alias("tokens"))


def html_texts(spark, sf_dir):
    return md.page_texts(t(spark, sf_dir, "pages")).select("page_id", "title", F.length("text").alias("chars"), F.sha2("text", 256).alias("digest"))


def structure(spark, sf_dir):
    x = F.col("text")
    return t(spark, sf_dir, "documents").select("doc_id", F.size(md.lines(x)).alias("lines"), F.size(md.list_items(x)).alias("items"), F.size(md.table_rows(x)).alias("table_rows"), F.size(F.filter(md.lines(x), lambda l: l.contains(" | "))).alias("barred"))


def entities(spark, sf_dir):
    e = md.entities(F.col("text"))
    return t(spark, sf_dir, "documents").select("doc_id", e.alias("e")).select("doc_id", F.size("e.parameters").alias("parameters"), F.size("e.endpoints").alias("endpoints"), F.array_join("e.statuses", ",").alias("statuses"), F.size("e.error_terms").alias("error_terms"))


def _answers(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    end = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\nFontes:\n- `"), "source", F.lit("` (p. 1)\n* src1\n"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" [fonte: SRC2; "), "lang", F.lit("]"))).otherwise(F.lit(""))
    return d.select("doc_id", F.concat(F.regexp_replace("text", r"[\n\[\]]", " "), end).alias("answer"), (F.col("doc_id") % 5 == 0).alias("operational"))


def citations(spark, sf_dir):
    a = _answers(spark, sf_dir).withColumn("cited", gr.cited_sources(F.col("answer")))
    allowed = F.array(*[F.lit(f"src{i}") for i in range(12)], F.lit("en"))
    errors = gr.grounding_errors(F.col("answer"), F.col("cited"), allowed, True, F.col("operational"))
    return a.select("doc_id", F.array_join("cited", ",").alias("cited"), F.array_join(errors, ",").alias("errors"), gr.critical(errors).alias("critical"))


def claims(spark, sf_dir):
    """Claims stand-ins: two probabilities a line item, by hash of its keys."""
    l = t(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(F.col("l_orderkey").alias("answer_id"), gr.claim_status(F.col("l_quantity") / 50, F.col("l_discount") * 10).alias("status"))


def claim_counts(spark, sf_dir):
    return claims(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


def answer_statuses(spark, sf_dir):
    return gr.answer_status(claims(spark, sf_dir))


def _stream(spark, sf_dir, name):
    """The table as a stream of its one file (or folder of files)."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{path}*")


def _drained(spark, df, mode, name):
    return st.drain(df, mode, fresh_folder(spark, name))


def stream_windows(spark, sf_dir):
    return _drained(spark, st.windowed_counts(_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))), "complete", "stream_windows").withColumn("total", F.round("total", 4))


def stream_gaps(spark, sf_dir):
    log = _stream(spark, sf_dir, "events").select(F.concat_ws(" ", "event_type", (F.col("user_id") % 20).cast("string")).alias("query"), F.col("value").alias("similarity"), "ts")
    return _drained(spark, st.gap_rollup(log), "complete", "stream_gaps")


def stream_cooldown(spark, sf_dir):
    out = _drained(spark, st.cooldown(_stream(spark, sf_dir, "events").select("user_id", "event_id", "ts"), 86_400.0), "append", "stream_cooldown")
    return out.select("user_id", "event_id", "admitted")


def session_counts(spark, sf_dir):
    return st.sessions(t(spark, sf_dir, "events"), "12 hours").select("user_id", "start", "n")


QUERIES = {
    "url_functions": url_functions, "url_list": url_list, "text_functions": text_functions, "folded_text": folded, "normalize_text": normalized, "normalize_embedding": embedding_checks, "safe_numeric": safe_numbers, "classify_intent": intents, "answer_mode": answer_modes, "semantic_context": semantic_contexts,
    "query_abbreviations": abbreviations, "markdown_sections": markdown_sections, "markdown_level_jumps": markdown_jumps, "chunk_text": text_chunks, "html_to_text": html_texts, "structure_counts": structure, "analytical_entities": entities, "cited_sources": citations, "claim_status": claim_counts, "answer_status": answer_statuses,
    "stream_windowed_counts": stream_windows, "stream_gap_rollup": stream_gaps, "stream_cooldown": stream_cooldown, "session_windows": session_counts,
}

_FOLD = "trim(regexp_replace(translate(lower({0}), 'áàâãäåçéèêëíìîïñóòôõöúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', ' ', 'g'))"
_FOLD_DOC = "d AS (SELECT *, " + _FOLD.format("text") + " AS f FROM documents)"
_MODE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(f, '{x}')" for x in terms) + f" THEN '{mode}'" for mode, terms in ANSWER_MODE_TERMS) + " ELSE 'general' END"
_SLUG = "coalesce(nullif(regexp_replace(regexp_replace({0}, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), '{1}')"
_CLAIMS = """c AS (SELECT l_orderkey AS answer_id, l_quantity / 50 AS s, l_discount * 10 AS k FROM lineitem), cs AS (SELECT answer_id, CASE WHEN s >= 0.65 AND k >= 0.65 THEN 'conflicting' WHEN s >= 0.65 AND k <= 0.35 THEN 'supported' WHEN k >= 0.65 AND s <= 0.35 THEN 'contradicted' WHEN s <= 0.35 AND k <= 0.35 THEN 'unsupported' ELSE 'inconclusive' END AS status FROM c)"""

_EXPANDED = "text || chr(9) || 'NF e  rca (Pdv) xNF nfe-NF'"
for _short, _long in QUERY_ABBREVIATIONS.items():
    _EXPANDED = f"regexp_replace({_EXPANDED}, '\\b({_short})\\b', '\\1 {_long}', 'gi')"

ORACLES = {
    "url_functions": f"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path FROM pages), q AS (SELECT *, regexp_extract(path, '([^/]+)$', 1) AS last FROM p)
SELECT page_id, regexp_matches(url, '^https?://') AS is_url, host, host = 'example.com' OR ends_with(host, '.example.net') AS allowed,
CASE WHEN trim(regexp_replace(last, '[-_]+', ' ', 'g')) <> '' THEN trim(regexp_replace(last, '[-_]+', ' ', 'g')) ELSE host END AS title, 'url__' || {_SLUG.format('host', 'source')} || '__' || {_SLUG.format('last', 'index')} || '__' || left(sha1(url), 10) AS filename FROM q""",
    "url_list": "WITH u AS (SELECT unnest(regexp_extract_all(url, 'https?://[^\\s/?#]+')) AS url, page_id FROM pages) SELECT url, min(page_id) AS first_page FROM u GROUP BY url",
    "text_functions": f"""SELECT doc_id, sha256(regexp_replace(text, '\\r\\n?', chr(10), 'g')) AS content_hash, len(regexp_extract_all(text, '[^\\s]+'))::INTEGER AS words, ceil(strlen(text) / 2.0)::BIGINT AS tokens, {_SLUG.format('text', 'source')} AS slug,
'candidate-' || left(sha256(doc_id || chr(31) || source), 24) AS candidate, 'source-' || left(sha256(source), 24) AS opaque FROM documents""",
    "folded_text": "SELECT doc_id, sha256(" + _FOLD.format("text") + ") AS folded FROM documents",
    "normalize_embedding": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x, i: CASE WHEN i = 4 AND vec_id % 5 = 0 THEN 0 ELSE x::DOUBLE * x::DOUBLE END))), 6) AS norm FROM embeddings",
    "safe_numeric": "SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 5 = 0 THEN 0.0 ELSE event_id::DOUBLE END AS x FROM events",
    "classify_intent": f"""WITH {_FOLD_DOC}, k(label, keyword, ord) AS (VALUES {', '.join(f"('{a}', '{b}', {['sql_lookup', 'troubleshooting', 'integration', 'configuration', 'process'].index(a)})" for a, b in KEYWORDS)}),
h AS (SELECT doc_id, label, ord, count(*) AS n FROM d JOIN k ON contains(' ' || f || ' ', ' ' || keyword || ' ') GROUP BY ALL), b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, ord) = 1)
SELECT d.doc_id AS query_id, coalesce(b.label, 'general') AS intent FROM d LEFT JOIN b USING (doc_id)""",
    "answer_mode": f"WITH {_FOLD_DOC} SELECT doc_id, {_MODE} AS mode FROM d",
    "semantic_context": f"WITH {_FOLD_DOC} SELECT doc_id, 'Documento: ' || source || ' | Secao: ' || lang || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ' | Modulo: m' END || CASE WHEN {_MODE} = 'general' THEN '' ELSE ' | Modo de resposta: ' || {_MODE} END AS context FROM d",
    "query_abbreviations": "SELECT conv_id, turn, sha256(trim(regexp_replace(" + _EXPANDED + ", '\\s+', ' ', 'g'))) AS q FROM conversations",
    "structure_counts": """WITH l AS (SELECT doc_id, string_split_regex(text, '\\r\\n|\\r|\\n') AS x FROM documents) SELECT doc_id, len(x)::INTEGER AS lines, len(list_filter(x, lambda s: regexp_matches(s, '^\\s*([-*+]|\\d+[.)])\\s+(.*\\S)\\s*$')))::INTEGER AS items,
len(list_filter(x, lambda s: starts_with(trim(s), '|') AND ends_with(trim(s), '|') AND length(trim(s)) > 1))::INTEGER AS table_rows, len(list_filter(x, lambda s: contains(s, ' | ')))::INTEGER AS barred FROM l""",
    "claim_status": f"WITH {_CLAIMS} SELECT status, count(*) AS n FROM cs GROUP BY status",
    "answer_status": f"WITH {_CLAIMS} SELECT answer_id, CASE WHEN bool_or(status IN ('contradicted', 'unsupported', 'conflicting')) THEN 'rejected' WHEN bool_and(status = 'supported') THEN 'supported' ELSE 'inconclusive' END AS status FROM cs GROUP BY answer_id",
    "stream_windowed_counts": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_gap_rollup": "SELECT event_type || ' ' || (user_id % 20) AS query, count(*) AS occurrences, max(value) AS max_similarity, max(ts) AS last_seen FROM events GROUP BY 1",
    "stream_cooldown": """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT user_id, event_id, i, TRUE AS admitted, ts AS last FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, e.i, e.ts - w.last >= INTERVAL 1 DAY, CASE WHEN e.ts - w.last >= INTERVAL 1 DAY THEN e.ts ELSE w.last END FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT user_id, event_id, admitted FROM w""",
    "session_windows": """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s)
SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k""",
}
