"""DuckDB SQL for the queries of this subpackage that SQL can express.

op4, op5 and op13 (learned or approximate) and op3 (sequential merges) have none; they are tested
against brute force, held-out labels or an exact round trip.
"""

from __future__ import annotations

# Pages of the driver's tables hold no canonical link or refresh, so that urls without a rule are
# allowed; tests/llm check the propagation over such edges against brute force.
OP1 = r"""
WITH rules(verdict, host, path) AS (VALUES ('block','com','/en/'), ('allow','example.com','/en/7'), ('allow','net','/de/'), ('block','example.net','/de/8'), ('block','org','/es/')),
p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT p.page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict, CASE WHEN m.rule IS NULL THEN 'default' ELSE 'rule' END AS decided_by
FROM p LEFT JOIN m USING (page_id)
"""

OP2 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS w, unnest([NULL]::VARCHAR[] || ws[1:len(ws)-1]) AS v FROM d WHERE len(ws) > 0),
c1 AS (SELECT w, count(*) AS c FROM t GROUP BY w), n AS (SELECT count(*)::DOUBLE AS n FROM t),
c2 AS (SELECT v, w, count(*) AS c FROM t WHERE v IS NOT NULL GROUP BY v, w),
s AS (SELECT t.doc_id, CASE WHEN t.v IS NULL THEN ln(a.c / n.n) WHEN c2.c >= 2 THEN ln(c2.c / b.c::DOUBLE) ELSE ln(0.4 * a.c / n.n) END AS x
  FROM t JOIN c1 a ON a.w = t.w CROSS JOIN n LEFT JOIN c2 ON c2.v = t.v AND c2.w = t.w LEFT JOIN c1 b ON b.w = t.v),
g AS (SELECT doc_id, sum(x) AS x FROM s GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, round(coalesce(x, 0), 4) AS log_score, CASE WHEN len(ws) > 0 THEN round(x / len(ws), 6) END AS mean_log_score FROM d LEFT JOIN g USING (doc_id)
"""

OP6 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS sh FROM w),
classes AS (SELECT min(doc_id) AS c, list_sort(sh) AS sh, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY list_sort(sh), len(sh)),
e AS (SELECT c, n, unnest(sh) AS t FROM classes),
pairs AS (SELECT a.c AS a, b.c AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i FROM e a JOIN e b ON a.t = b.t AND a.c <> b.c GROUP BY a.c, b.c),
links AS (SELECT a, b FROM pairs WHERE 100 * i >= 75 * (na + nb - i)),
reach(c, r) AS (SELECT c, c FROM classes UNION SELECT reach.c, links.b FROM reach JOIN links ON reach.r = links.a),
comp AS (SELECT c, min(r) AS component_id FROM reach GROUP BY c),
deg AS (SELECT a AS c, count(*) AS k FROM links GROUP BY a)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(comp.component_id, s.doc_id) AS component_id, coalesce(deg.k, 0)::BIGINT AS n_links
FROM s LEFT JOIN classes ON classes.n = len(s.sh) AND classes.sh = list_sort(s.sh) LEFT JOIN comp ON comp.c = classes.c LEFT JOIN deg ON deg.c = classes.c
"""

OP7 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  CASE WHEN length(text) > 0 THEN greatest(0.1, 2.0 * length(translate(text, '#$%&*|<>{}[]\^~', '')) / length(text) - 1.0) ELSE 0.1 END AS quality,
  (('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
k AS (SELECT *, -ln(u) / quality AS key FROM d),
t AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM k GROUP BY source),
w AS (SELECT source, source_size, [5.0, 2.0, 1.0][((i - 1) % 3 + 1)::INTEGER]::DOUBLE AS weight, 2.0 * source_size AS cap FROM t),
r AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS water FROM w
  WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(water, cap / weight) AS level FROM r WHERE cap / weight >= water * (1 - 1e-12)),
g AS (SELECT source, source_size, CASE WHEN (SELECT level FROM l) IS NULL THEN cap ELSE least(cap, (SELECT level FROM l) * weight) END::DOUBLE AS target FROM w),
o AS (SELECT k.doc_id, k.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size)::BIGINT ELSE 0 END AS epochs,
  sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) AS up_to FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, round(target - epochs * source_size)::BIGINT - (up_to - size))))::BIGINT AS taken FROM o
"""

OP8 = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP9 = r"""
WITH RECURSIVE rules(kind, ord, pat, grp, least_len) AS (VALUES
  ('assign', 0, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
  ('access', 1, 'AKIA[A-Z0-9]+', 0, 20), ('hex', 2, '[0-9a-f]{24,}', 0, 24), ('pem', 3, '-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----', 0, 1),
  ('github', 4, 'gh[pousr]_[A-Za-z0-9]{36,}', 0, 1), ('jwt', 5, 'eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}', 0, 1)),
texts AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents),
m AS (SELECT text, kind, ord, least_len, unnest(x) AS match, unnest(y) AS val, unnest(range(1, len(x) + 1)) AS i FROM (
  SELECT text, kind, ord, least_len, CASE kind WHEN 'assign' THEN regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)')
    WHEN 'access' THEN regexp_extract_all(text, 'AKIA[A-Z0-9]+') WHEN 'hex' THEN regexp_extract_all(text, '[0-9a-f]{24,}') WHEN 'pem' THEN regexp_extract_all(text, '-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----')
    WHEN 'github' THEN regexp_extract_all(text, 'gh[pousr]_[A-Za-z0-9]{36,}') ELSE regexp_extract_all(text, 'eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}') END AS x,
    CASE kind WHEN 'assign' THEN regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2)
    WHEN 'access' THEN regexp_extract_all(text, 'AKIA[A-Z0-9]+') WHEN 'hex' THEN regexp_extract_all(text, '[0-9a-f]{24,}') WHEN 'pem' THEN regexp_extract_all(text, '-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----')
    WHEN 'github' THEN regexp_extract_all(text, 'gh[pousr]_[A-Za-z0-9]{36,}') ELSE regexp_extract_all(text, 'eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}') END AS y
  FROM texts, rules)),
walk(text, kind, ord, i, val_len, least_len, a, b) AS (
  SELECT text, kind, ord, 0::BIGINT, 0::BIGINT, 0, 0::BIGINT, 0::BIGINT FROM (SELECT DISTINCT text, kind, ord FROM m)
  UNION ALL
  SELECT m.text, m.kind, m.ord, m.i, length(m.val), m.least_len, w.b + instr(substr(m.text, w.b + 1), m.match) - 1, w.b + instr(substr(m.text, w.b + 1), m.match) - 1 + length(m.match)
  FROM walk w JOIN m ON m.text = w.text AND m.kind = w.kind AND m.i = w.i + 1),
f AS (SELECT text, kind, ord, a, b FROM walk WHERE i > 0 AND val_len >= least_len),
g AS (SELECT text, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, ord) FILTER (ord < 3), '') AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, ord) AS spans FROM f GROUP BY text)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN g ON g.text = coalesce(d.text, '')
"""

OP10 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""


def _op11(rounds: int = 6) -> str:
    """Lloyd's rounds one after another over single components, each a pair of common tables."""
    nearest = """a{r} AS MATERIALIZED (SELECT vec_id, p, arg_min(e, d * 16 + e) AS e, min(d) AS d FROM
  (SELECT x.vec_id, x.p, b.e, sum((x.x - b.x) * (x.x - b.x)) AS d FROM x JOIN b{r} b USING (p, j) GROUP BY x.vec_id, x.p, b.e) GROUP BY vec_id, p)"""
    moved = """b{n} AS MATERIALIZED (SELECT b.p, b.j, b.e, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN
  (SELECT a.p, x.j, a.e, (sum(x.x) - ((sum(x.x) % count(*)) + count(*)) % count(*))::BIGINT // count(*) AS x FROM a{r} a JOIN x USING (vec_id, p) GROUP BY a.p, x.j, a.e) m USING (p, j, e))"""
    steps = [nearest.format(r=r) + (",\n" + moved.format(r=r, n=r + 1) if r < rounds else "") for r in range(rounds + 1)]
    return f"""
WITH k AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS MATERIALIZED (SELECT vec_id, (i - 1) // (n // 8) AS p, (i - 1) % (n // 8) AS j, floor(4096 * c)::BIGINT AS x FROM (SELECT vec_id, len(v) AS n, unnest(v) AS c, unnest(range(1, len(v) + 1)) AS i FROM k)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k QUALIFY e < 16),
b0 AS MATERIALIZED (SELECT p, j, e, x FROM x JOIN first USING (vec_id)),
{(","+chr(10)).join(steps)},
c AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, j)) AS s FROM b{rounds})
SELECT c.vec_id, c.code, c.error, sum(c.error) OVER (PARTITION BY k.label)::BIGINT AS label_error, h.s AS codebooks_sha256 FROM c JOIN k USING (vec_id) CROSS JOIN h
"""


OP11 = _op11()

OP12 = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
m AS (SELECT doc_id, part, (len(ws) < 200)::INTEGER + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INTEGER
  + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text))::INTEGER
  + 8 * regexp_matches(text, '[#$%&*|]')::INTEGER + 16 * coalesce(doc_id > first, false)::INTEGER AS mask FROM w),
l AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
c AS MATERIALIZED (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f(x, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before FROM o, range(1, 6) r(step)),
g AS (SELECT c.part, s.filter_order, s.step, s.bit, sum(CASE WHEN c.mask & (s.before | s.bit) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN c.mask & s.bit > 0 AND c.mask & s.before = 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN c.mask & s.bit > 0 AND c.mask & s.before > 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN c.mask = s.bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN c.mask & s.bit > 0 AND c.mask & s.before = 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN c.mask & s.bit > 0 AND c.mask & s.before = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM c CROSS JOIN s GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM g
"""

ORACLES = {
    "op1_url_filters": OP1,
    "op2_lm_scoring": OP2,
    "op6_ngram_jaccard_join": OP6,
    "op7_source_mixing": OP7,
    "op8_exact_top_k": OP8,
    "op9_secret_scans": OP9,
    "op10_warc": OP10,
    "op11_vector_codes": OP11,
    "op12_filter_audit": OP12,
}

ORACLES["secret_scans_incremental"] = ORACLES["op9_secret_scans"]
