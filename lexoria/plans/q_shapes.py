"""Classification, successors and records of several shapes, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexoria.operators import routing, shapes, taxonomy
from lexoria.operators.successors import resolve_successors
from lexoria.sources import corpus

HEADINGS = ["", "Consulta SQL de pedidos", "Parâmetros da conta corrente", "Permissão de usuário", "Pagamento com erro", "Fluxo de pedidos", "Rotas e visitas", "Tabela de vendas", "Banco de dados", "Passo a passo: boleto", "Falha: não sincroniza", "Vendedores"]
LEGACY = ["sql_integracao", "parametros_configuracao", "geral", "suporte_processos", "pedidos_vendas", None]
MODES = ["process", "general", "integration", None, "sql_lookup"]
TABLE = "the|die|que"


def _pick(values: list, by: str, n: int | None = None):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.expr(by) % (n or len(values)) + 1).cast("int"))


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.table(spark, sf_dir, "documents")
    return d.select("doc_id", _pick(HEADINGS, "doc_id").alias("title"), F.col("text").alias("content"), _pick(LEGACY, "doc_id div 5").alias("legacy_module"), _pick(MODES, "doc_id div 7").alias("legacy_mode"))


def section_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = taxonomy.heuristic(_sections(spark, sf_dir), TABLE)
    return out.select("doc_id", "primary_module", F.array_join("secondary_modules", ",").alias("secondary"), "answer_mode", F.array_join("signals", ",").alias("signals"), "legacy_module_out", "legacy_mode_out")


def taxonomy_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules would change, by source."""
    rows = taxonomy.heuristic(_sections(spark, sf_dir), TABLE).join(corpus.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    key = [F.col("source").alias("document_id"), F.col("doc_id").alias("section_index")]
    return routing.section_changes(rows.select(*key, F.coalesce("legacy_module", F.lit("geral")).alias("module"), F.coalesce("legacy_mode", F.lit("general")).alias("answer_mode")), rows.select(*key, F.col("legacy_module_out").alias("module"), F.col("legacy_mode_out").alias("answer_mode")))


def editorial_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.table(spark, sf_dir, "documents")
    names = lambda c: F.when(c.isNotNull(), F.array(c))
    given = F.struct(F.when(F.col("doc_id") % 41 == 0, "taxonomy_v0").otherwise(taxonomy.VERSION).alias("taxonomy_version"), _pick(taxonomy.MODULES, "doc_id").alias("primary_module"), F.array(F.lit("financeiro")).alias("secondary_modules"), _pick(taxonomy.ANSWER_MODES, "doc_id div 3").alias("answer_mode"), F.array("lang").alias("products"))
    own = F.struct(_pick([None, "logistica", "outro"], "doc_id", 3).alias("primary_module"), names(_pick([None, None, None, "configuracao", "x"], "doc_id", 5)).alias("secondary_modules"), _pick([None, None, "reference", "unknown", "other", None, None], "doc_id", 7).alias("answer_mode"), names(_pick([None] * 9 + ["zz", "en"], "doc_id", 11)).alias("products"))
    out = taxonomy.editorial(d.select("doc_id", given.alias("taxonomy"), F.when(F.col("doc_id") % 2 == 0, own).alias("override")), ["en", "de", "fr", "es"])
    return out.select("doc_id", "primary_module", F.array_join("secondary_modules", ",").alias("secondary"), "answer_mode", F.array_join("products", ",").alias("products"), F.array_join("signals", ",").alias("signals"), "reason", "problem")


def successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains within each twenty documents, with forks, jumps into the next twenty, ways to nothing,
    and loops."""
    d = corpus.table(spark, sf_dir, "documents").select("doc_id")
    place, block = F.col("doc_id") % 20, F.expr("doc_id div 20")
    links = F.array_compact(F.array(
        F.when((place < 15) & ~((block % 5 == 3) & (place == 14)), F.col("doc_id") + 1), F.when(place % 6 == 4, F.col("doc_id") + 2), F.when((place == 17) & (block % 3 == 0), F.col("doc_id") + 20),
        F.when((place == 16) & (block % 4 == 1), F.lit(-1) - F.col("doc_id")), F.when((place == 14) & (block % 5 == 3), F.col("doc_id") - 9), F.when((place == 18) & (block % 7 == 2), F.col("doc_id")),
    ))
    edges = d.select(F.col("doc_id").alias("id"), F.explode(links).alias("successor"))
    return resolve_successors(edges, d.select(F.col("doc_id").alias("id"), F.expr("doc_id div 20").alias("batch_id")))


_EVIDENCE = [
    "'[\"' || source || '\", \" \", 7]'", "'[{\"source\": \"' || source || '\", \"contains\": \"' || lang || '\"}]'", "'[{\"contains\": [\"' || lang || '\", \" \", 5, null, \" x \"], \"source\": \" s \"}]'",
    "'[{\"canonical_id\": \"d1\", \"document_revision\": ' || n_chars || '}]'", "'[{\"canonical_id\": \"d1\", \"revision\": 0}, \"t\"]'", "'[{\"section_key\": \"s\", \"source\": \"x\"}]'",
    "'[{\"canonical_id\": \"d\", \"locator\": {\"line\":' || n_chars || '}}, 7, \"t\"]'", "'[{\"canonical_id\": \"d\", \"locator\": \"x\"}]'", "'{\"source\": \"x\"}'", "'not json ['", "'[{\"contains\": false, \"source\": 0}, {\"source\": 12}]'", "NULL",
    "'[{\"canonical_id\": \"d\", \"document_revision\": 1.5, \"source_id\": \"q\"}, {\"document_revision\": 2}]'",
]
_REPLIES = [
    "'[\"a ' || lang || '\", \" \", null, \"c\"]'", "'[{\"id\": 2, \"context\": \"x\"}, {\"chunk_id\": \"1\", \"text\": \" y \"}, {\"texto\": \"z\"}]'", "'{\"contexts\": [\"p\", \"q\"]}'", "'{\"0\": \"m\", \"7\": \"far\", \"x\": \"no\", \"1\": {\"summary\": \"s\"}}'",
    "'```json' || chr(10) || 'Here: [\"' || source || '\"]' || chr(10) || '```'", "'none'", "'[{\"context\":\"\",\"id\":0}, \"plain\", 5]'", "NULL", "'[{\"id\": 0, \"value\": \"first\"}, {\"id\": 0, \"value\": \"last\"}, {\"id\": -1, \"value\": \"out\"}, {\"id\": \"w\", \"value\": \"place\"}]'",
]


def _made(parts: list[str], spark_side: bool = True) -> str:
    cases = " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(parts))
    return f"CASE doc_id % {len(parts)} {cases} END"


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.expr(_made(_EVIDENCE)).alias("reference_evidence"))
    return shapes.evidence_specs(d).withColumn("contains", F.array_join("contains", "|"))


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.table(spark, sf_dir, "documents").select("doc_id", F.expr(_made(_REPLIES)).alias("reply"), (F.col("doc_id") % 4 + 1).alias("expected"))
    return shapes.contextual_payload(d)


QUERIES = {
    "section_taxonomy": section_taxonomy, "taxonomy_dry_run": taxonomy_dry_run, "editorial_taxonomy": editorial_taxonomy, "resolve_successors": successors, "evidence_specs": evidence, "contextual_payload": contexts,
}


def _list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def _map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"


_RULES = f"""s AS (SELECT doc_id, source, {_list(HEADINGS)}[doc_id % {len(HEADINGS)} + 1] AS title, coalesce(text, '') AS content, {_list(LEGACY)}[(doc_id // 5) % {len(LEGACY)} + 1] AS om, {_list(MODES)}[(doc_id // 7) % {len(MODES)} + 1] AS oa FROM documents),
fold AS (SELECT *, trim(regexp_replace(strip_accents(lower(title)), '[^a-z0-9]+', ' ', 'g')) AS h, length(content) <= 500 AND regexp_matches(trim(regexp_replace(strip_accents(lower(content)), '[^a-z0-9]+', ' ', 'g')), '\\b({TABLE})\\b') AS card,
  coalesce({_map(taxonomy.MODULE_OF)}[om], 'unknown') AS known, coalesce({_map(taxonomy.MODE_OF)}[oa], 'unknown') AS oldmode FROM s),
sig AS (SELECT *, CASE WHEN coalesce(om = 'sql_integracao', FALSE) AND regexp_matches(h, '\\b(sql|select)\\b') THEN 'sql_heading' WHEN regexp_matches(h, '\\b(parametr[oa]s?|configurac(ao|oes))\\b') OR card THEN 'parameter_configuration'
  WHEN regexp_matches(h, '\\b(permissao|usuario|perfil de acesso)\\b') THEN 'user_permission' WHEN regexp_matches(h, '\\b(conta corrente|pagamento|financeiro|boleto)\\b') THEN 'finance'
  WHEN known = 'unknown' AND regexp_matches(h, '\\b(pedidos?|vendas?|orcamentos?|campanhas?|descontos?)\\b') THEN 'order_heading' WHEN known = 'unknown' AND regexp_matches(h, '\\b(rotas?|visitas?|logistica|entregas?)\\b') THEN 'logistics_heading'
  WHEN known = 'unknown' AND regexp_matches(h, '\\b(sql|select|tabela|banco de dados)\\b') THEN 'sql_heading' ELSE 'legacy_module' END AS signal FROM fold),
md AS (SELECT *, CASE signal WHEN 'sql_heading' THEN 'sql_integracao' WHEN 'parameter_configuration' THEN 'configuracao' WHEN 'user_permission' THEN 'configuracao' WHEN 'finance' THEN 'financeiro' WHEN 'order_heading' THEN 'pedidos_vendas' WHEN 'logistics_heading' THEN 'logistica' ELSE known END AS m FROM sig),
am AS (SELECT *, CASE WHEN regexp_matches(h, '\\b(erro|falha|problema|nao sincroniza|nao aparece)\\b') THEN 'troubleshooting' WHEN m = 'sql_integracao' AND regexp_matches(h, '\\b(sql|select)\\b') THEN 'sql_lookup'
  WHEN m = 'configuracao' AND (regexp_matches(h, '\\b(parametr[oa]s?|configurac(ao|oes))\\b') OR card OR signal = 'user_permission') THEN 'configuration' WHEN regexp_matches(h, '\\b(fluxo|passo a passo|procedimento)\\b') THEN 'procedure' END AS a FROM md),
tx AS (SELECT doc_id, source, om, oa, m AS primary_module, CASE WHEN m = 'configuracao' AND regexp_matches(h, '\\b(conta corrente|pagamento|financeiro|boleto)\\b') THEN 'financeiro' ELSE '' END AS secondary, coalesce(a, oldmode) AS answer_mode, signal || coalesce(',' || a, '') AS signals,
  CASE WHEN signal = 'legacy_module' AND om IS NOT NULL THEN om ELSE {_map(taxonomy.LEGACY_MODULE)}[m] END AS legacy_module_out, CASE WHEN coalesce(a, oldmode) = oldmode AND oa IS NOT NULL THEN oa ELSE {_map(taxonomy.LEGACY_MODE)}[coalesce(a, oldmode)] END AS legacy_mode_out FROM am)"""

_TEXT = "coalesce(trim(CASE json_type({0}) WHEN 'VARCHAR' THEN {0} ->> '$' WHEN 'NULL' THEN NULL ELSE {0}::VARCHAR END), '')"


def _present(name: str) -> str:
    x = f"(i -> '$.{name}')"
    return f"CASE WHEN {x}::VARCHAR IN ('false', '0', '0.0', '[]', '{{}}') THEN '' ELSE {_TEXT.format(x)} END"


_INT = "(i -> '$.document_revision')"
ORACLES = {
    "section_taxonomy": f"WITH {_RULES} SELECT doc_id, primary_module, secondary, answer_mode, signals, legacy_module_out, legacy_mode_out FROM tx",
    "taxonomy_dry_run": f"WITH {_RULES} SELECT source AS document_id, count(*) AS sections, count_if(coalesce(om, 'geral') <> legacy_module_out)::BIGINT AS changed_modules, count_if(coalesce(oa, 'general') <> legacy_mode_out)::BIGINT AS changed_modes FROM tx GROUP BY source",
    "editorial_taxonomy": f"""WITH d AS (SELECT doc_id, lang, doc_id % 41 = 0 AS old, {_list(taxonomy.MODULES)}[doc_id % 6 + 1] AS m, {_list(taxonomy.ANSWER_MODES)}[(doc_id // 3) % 6 + 1] AS a, doc_id % 2 = 0 AS has,
  [NULL, 'logistica', 'outro'][doc_id % 3 + 1] AS om, [NULL, NULL, NULL, 'configuracao', 'x'][doc_id % 5 + 1] AS os, [NULL, NULL, 'reference', 'unknown', 'other', NULL, NULL][doc_id % 7 + 1] AS oa, (CASE doc_id % 11 WHEN 9 THEN 'zz' WHEN 10 THEN 'en' END) AS op FROM documents),
e AS (SELECT doc_id, old, CASE WHEN has THEN coalesce(om, m) ELSE m END AS primary_module, CASE WHEN has THEN coalesce(os, 'financeiro') ELSE 'financeiro' END AS secondary, CASE WHEN has THEN coalesce(oa, a) ELSE a END AS answer_mode, CASE WHEN has THEN coalesce(op, lang) ELSE lang END AS products,
  array_to_string(list_filter([CASE WHEN has AND op IS NOT NULL THEN 'products' END, CASE WHEN has AND om IS NOT NULL THEN 'primary_module' END, CASE WHEN has AND os IS NOT NULL THEN 'secondary_modules' END, CASE WHEN has AND oa IS NOT NULL THEN 'answer_mode' END], lambda x: x IS NOT NULL), ',') AS signals FROM d)
SELECT doc_id, primary_module, secondary, answer_mode, products, signals, CASE WHEN signals = '' THEN 'editorial_inheritance' ELSE 'editorial_override' END AS reason,
CASE WHEN old THEN 'version' WHEN primary_module NOT IN {tuple(taxonomy.MODULES)} OR secondary NOT IN {tuple(taxonomy.MODULES)} THEN 'module' WHEN answer_mode NOT IN {tuple(taxonomy.ANSWER_MODES)} THEN 'answer_mode' WHEN products NOT IN ('en', 'de', 'fr', 'es') THEN 'product' END AS problem FROM e""",
    "resolve_successors": """WITH RECURSIVE d AS (SELECT doc_id AS id, doc_id % 20 AS p, doc_id // 20 AS b FROM documents),
l AS (SELECT id, b, id + 1 AS nx FROM d WHERE p < 15 AND NOT (b % 5 = 3 AND p = 14) UNION SELECT id, b, id + 2 FROM d WHERE p % 6 = 4 UNION SELECT id, b, id + 20 FROM d WHERE p = 17 AND b % 3 = 0
  UNION SELECT id, b, -1 - id FROM d WHERE p = 16 AND b % 4 = 1 UNION SELECT id, b, id - 9 FROM d WHERE p = 14 AND b % 5 = 3 UNION SELECT id, b, id FROM d WHERE p = 18 AND b % 7 = 2),
k AS (SELECT l.id, l.nx, t.id IS NULL AS miss, coalesce(t.b <> l.b, FALSE) AS crossed FROM l LEFT JOIN d t ON t.id = l.nx),
r(id, cur, miss, crossed) AS (SELECT id, nx, miss, crossed FROM k UNION SELECT r.id, k.nx, r.miss OR k.miss, r.crossed OR k.crossed FROM r JOIN k ON k.id = r.cur),
e AS (SELECT id, cur AS final, bool_or(miss) AS miss, bool_or(crossed) AS crossed FROM r WHERE cur NOT IN (SELECT id FROM k) GROUP BY id, cur), loop AS (SELECT DISTINCT id FROM r WHERE cur = id)
SELECT id, final, CASE WHEN miss THEN 'dangling' WHEN crossed THEN 'cross_batch' ELSE 'resolved' END AS status FROM e UNION ALL SELECT DISTINCT id, NULL, 'cycle' FROM (SELECT id FROM r WHERE cur IN (SELECT id FROM loop) UNION SELECT id FROM loop)""",
    "evidence_specs": f"""WITH e AS (SELECT doc_id AS case_id, {_made(_EVIDENCE)} AS t FROM documents), j AS (SELECT case_id, t::JSON AS v FROM e WHERE json_valid(t) AND json_type(CASE WHEN json_valid(t) THEN t ELSE 'null' END) = 'ARRAY'),
x AS (SELECT case_id, position, json_extract(v, '$[' || position || ']') AS i FROM (SELECT case_id, v, unnest(range(json_array_length(v)::BIGINT))::INTEGER AS position FROM j)),
y AS (SELECT case_id, position, i, json_type(i) = 'OBJECT' AS o, coalesce(CASE WHEN json_type(i, '$.document_revision') IS NOT NULL THEN {_INT} END, i -> '$.revision') AS rev, i -> '$.locator' AS loc, i -> '$.contains' AS con FROM x WHERE json_type(i) IN ('OBJECT', 'VARCHAR')),
z AS (SELECT case_id, position, CASE WHEN o THEN {_present('source')} ELSE {_TEXT.format('i')} END AS source,
  CASE WHEN NOT o OR con IS NULL THEN []::VARCHAR[] WHEN json_type(con) = 'VARCHAR' THEN list_filter([trim(con ->> '$')], lambda s: s <> '') WHEN json_type(con) = 'ARRAY' THEN list_filter(list_transform(con::JSON[], lambda s: coalesce(trim(CASE WHEN json_type(s) = 'NULL' THEN NULL ELSE s ->> '$' END), '')), lambda s: s <> '') ELSE []::VARCHAR[] END AS contains,
  CASE WHEN o THEN {_present('canonical_id')} ELSE '' END AS canonical_id, CASE WHEN o THEN {_present('section_key')} ELSE '' END AS section_key, CASE WHEN o THEN {_present('source_id')} ELSE '' END AS source_id,
  o AND rev IS NOT NULL AS given, o AND rev IS NOT NULL AND NOT coalesce(json_type(rev) = 'UBIGINT' AND (rev ->> '$')::DOUBLE >= 1, FALSE) AS bad, rev, o AND loc IS NOT NULL AS placed, o AND loc IS NOT NULL AND json_type(loc) <> 'OBJECT' AS lost, loc FROM y),
p AS (SELECT *, CASE WHEN bad THEN 'document_revision' WHEN lost THEN 'locator' WHEN (given OR section_key <> '' OR source_id <> '' OR placed) AND canonical_id = '' THEN 'canonical_id' END AS problem FROM z)
SELECT case_id, position, source, array_to_string(contains, '|') AS contains, canonical_id, CASE WHEN given AND NOT bad THEN (rev ->> '$')::BIGINT END AS document_revision, section_key, source_id, CASE WHEN placed AND NOT lost THEN loc::VARCHAR END AS locator, problem
FROM p WHERE problem IS NOT NULL OR source <> '' OR len(contains) > 0 OR canonical_id <> ''""",
    "contextual_payload": f"""WITH r AS (SELECT doc_id AS id, doc_id % 4 + 1 AS expected, regexp_replace(regexp_replace(trim({_made(_REPLIES)}), '^```(json)?\\s*', ''), '\\s*```$', '') AS t FROM documents),
f AS (SELECT id, expected, coalesce(nullif(regexp_extract(t, '(?s)\\[.*\\]'), ''), nullif(regexp_extract(t, '(?s)\\{{.*\\}}'), ''), t) AS t FROM r), j AS (SELECT id, expected, t::JSON AS v FROM f WHERE json_valid(t)),
a AS (SELECT id, expected, p AS place, json_extract(v, '$[' || p || ']') AS i FROM (SELECT id, expected, v, unnest(range(json_array_length(v)::BIGINT)) AS p FROM j WHERE json_type(v) = 'ARRAY')),
o AS (SELECT id, expected, p AS place, k, json_extract(v, '$."' || k || '"') AS i FROM (SELECT id, expected, v, unnest(json_keys(v)) AS k, unnest(range(len(json_keys(v)))) AS p FROM j WHERE json_type(v) = 'OBJECT')),
u AS (SELECT id, expected, place, coalesce(CASE WHEN json_type(i) = 'OBJECT' THEN try_cast(coalesce(i ->> '$.id', i ->> '$.chunk_id') AS BIGINT) END, place) AS idx, i FROM a UNION ALL SELECT id, expected, place, try_cast(k AS BIGINT), i FROM o),
c AS (SELECT *, CASE WHEN json_type(i) = 'OBJECT' THEN coalesce(nullif(trim(i ->> '$.context'), ''), nullif(trim(i ->> '$.text'), ''), nullif(trim(i ->> '$.texto'), ''), nullif(trim(i ->> '$.summary'), ''), nullif(trim(i ->> '$.value'), ''), i::VARCHAR) ELSE {_TEXT.format('i')} END AS context FROM u)
SELECT id, idx, arg_max(context, place) AS context FROM c WHERE context <> '' AND idx >= 0 AND idx < expected GROUP BY id, idx""",
}
