"""Which of the pages' urls may be fetched, and the SQL."""

from __future__ import annotations

import ipaddress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexoria.functions.addresses import CLOSED, OPEN
from lexoria.operators import web_policy
from lexoria.sources import corpus

#: Beginnings of the addresses that the query makes from digests of urls and hosts.
_NETS = ["8.", "10.", "127.", "192.168.", "100.64.", "100.128.", "172.15.", "172.16.", "192.0.0.", "192.0.1.", "224.", "198.18."]
_SIX = ["2a00", "2001", "fe80", "fd00", "2606", "3fff", "64", "2002"]


def _octets(digest, count):
    return [F.conv(F.substr(digest, F.lit(9 + 2 * i), F.lit(2)), 16, 10) for i in range(count)]


def _address(digest):
    """A dotted address from a digest: one of the beginnings, filled up with its digits."""
    out = F.lit(None).cast("string")
    for i, net in enumerate(_NETS):
        made = F.concat(F.lit(net), F.concat_ws(".", *_octets(digest, 4 - net.count("."))))
        out = F.when(F.conv(F.left(digest, F.lit(4)), 16, 10).cast("long") % len(_NETS) == i, made).otherwise(out)
    return out


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's url, seven of eight with another host: dotted, decimal, hexadecimal, IPv6, an IPv4
    inside IPv6, with a user, of another scheme."""
    pages = corpus.table(spark, sf_dir, "pages").select("page_id", "url", F.sha2("url", 256).alias("d"))
    number = F.conv(F.left("d", F.lit(8)), 16, 10)
    six = F.concat(F.element_at(F.array(*[F.lit(x) for x in _SIX]), (F.col("page_id") % 64 / 8).cast("int") + 1), F.lit(":"), F.substr("d", F.lit(5), F.lit(4)), F.lit("::"), F.substr("d", F.lit(9), F.lit(3)))
    forms = [F.col("url"), F.concat(F.lit("http://"), _address(F.col("d")), F.lit("/x")), F.concat(F.lit("https://"), number, F.lit("/")), F.concat(F.lit("http://0x"), F.left("d", F.lit(8)), F.lit(":8080/")),
             F.concat(F.lit("https://["), six, F.lit("]/")), F.concat(F.lit("http://me@"), F.substr("url", F.lit(9))), F.concat(F.lit("http://[::FFFF:"), _address(F.col("d")), F.lit("]:81")), F.concat(F.lit("ftp://"), F.substr("url", F.lit(9)))]
    url = forms[0]
    for i, form in enumerate(forms):
        url = F.when(F.col("page_id") % len(forms) == i, form).otherwise(url)
    return pages.select("page_id", url.alias("url"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One or two addresses for most hosts of the pages, by the host's digest."""
    hosts = corpus.table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1).alias("host")).filter("host <> ''").distinct().withColumn("d", F.sha2("host", 256))
    kind = F.conv(F.left("d", F.lit(2)), 16, 10).cast("int") % 8
    second = F.when(kind == 1, "10.0.0.7").when(kind == 2, "2606:4700::1").when(kind == 3, "no address")
    return hosts.filter(kind != 0).select("host", F.explode(F.array_compact(F.array(_address(F.col("d")), second))).alias("address"))


def url_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web_policy.check_destinations(_written(spark, sf_dir), _answers(spark, sf_dir), ["*.com", "*.org", "*.net", "8.*"])


def url_policy_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web_policy.check_destinations(_written(spark, sf_dir), _answers(spark, sf_dir))


def _sql() -> str:
    nets = []
    for names, closed in ((CLOSED, "TRUE"), (OPEN, "FALSE")):
        for n in map(ipaddress.ip_network, names):
            kind = (lambda x: f"{int(x):032x}") if n.version == 6 else (lambda x: f"{int(x):08x}")
            nets.append(f"({n.version}, '{kind(n.network_address)}', '{kind(n.broadcast_address)}', {n.prefixlen}, {closed})")
    address = "(" + "CASE ('0x' || d[1:4])::BIGINT % 12 " + " ".join(f"WHEN {i} THEN '{net}' || array_to_string([{', '.join(f'''(('0x' || d[{9 + 2 * j}:{10 + 2 * j}])::BIGINT)::VARCHAR''' for j in range(4 - net.count('.')))}], '.')" for i, net in enumerate(_NETS)) + " END)"
    return f"""WITH net(version, a, b, bits, closed) AS (VALUES {', '.join(nets)}),
p AS (SELECT page_id, url, sha256(url) AS d FROM pages),
w AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN 'http://' || {address} || '/x' WHEN 2 THEN 'https://' || ('0x' || d[1:8])::BIGINT || '/' WHEN 3 THEN 'http://0x' || d[1:8] || ':8080/'
  WHEN 4 THEN 'https://[' || {_SIX}[((page_id % 64) // 8 + 1)::INTEGER] || ':' || d[5:8] || '::' || d[9:11] || ']/' WHEN 5 THEN 'http://me@' || url[9:] WHEN 6 THEN 'http://[::FFFF:' || {address} || ']:81' ELSE 'ftp://' || url[9:] END AS url FROM p),
h AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS auth FROM w),
q AS (SELECT page_id, scheme, contains(auth, '@') AS user, CASE WHEN starts_with(auth, '[') THEN regexp_extract(auth, '^\\[(.*)\\]', 1) ELSE regexp_extract(auth, '^([^:]*)', 1) END AS host, nullif(regexp_extract(auth, ':(\\d+)$', 1), '') AS port, starts_with(auth, '[') AS six FROM h),
u AS (SELECT page_id, scheme, user, lower(host) AS host, coalesce(CASE WHEN NOT six OR regexp_matches(host, ']') OR port IS NOT NULL THEN port END::INTEGER, CASE scheme WHEN 'https' THEN 443 ELSE 80 END) AS port, six FROM (SELECT * REPLACE (CASE WHEN six AND NOT EXISTS (SELECT 1 FROM h WHERE h.page_id = q.page_id AND regexp_matches(h.auth, '\\]:\\d+$')) THEN NULL ELSE port END AS port) FROM q)),
k AS (SELECT host, sha256(host) AS d, ('0x' || left(sha256(host), 2))::BIGINT % 8 AS kind FROM (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages) WHERE host <> ''),
ans AS (SELECT host, {address} AS address FROM k WHERE kind <> 0 UNION ALL SELECT host, CASE kind WHEN 1 THEN '10.0.0.7' WHEN 2 THEN '2606:4700::1' ELSE 'no address' END FROM k WHERE kind IN (1, 2, 3)),
txt AS (SELECT DISTINCT host AS t FROM u UNION SELECT address FROM ans),
num AS (SELECT t, CASE WHEN regexp_matches(t, '^(\\d{{1,3}}\\.){{3}}\\d{{1,3}}$') THEN array_to_string(list_transform(string_split(t, '.'), lambda x: printf('%02x', x::INTEGER)), '')
  WHEN starts_with(t, '::ffff:') THEN array_to_string(list_transform(string_split(t[8:], '.'), lambda x: printf('%02x', x::INTEGER)), '') WHEN regexp_matches(t, '^0x[0-9a-f]{{8}}$') THEN t[3:] WHEN regexp_matches(t, '^\\d+$') THEN printf('%08x', t::BIGINT)
  WHEN contains(t, '::') THEN (SELECT lpad(s[1], 4, '0') || lpad(s[2], 4, '0') || repeat('0', 20) || lpad(s[4], 4, '0') FROM (SELECT string_split(t, ':') AS s)) END AS x FROM txt),
shut AS (SELECT t, x IS NULL AS bad, coalesce(arg_max(closed, bits), FALSE) AS closed FROM num LEFT JOIN net ON length(net.a) = length(x) AND x BETWEEN net.a AND net.b GROUP BY t, x),
dns AS (SELECT host, bool_or(bad) AS bad, bool_or(closed) AS closed FROM ans JOIN shut ON t = address GROUP BY host)
SELECT page_id, CASE WHEN v NOT IN ('invalid_url', 'credentials') THEN host END AS host, CASE WHEN v NOT IN ('invalid_url', 'credentials') THEN port END AS port, v AS verdict FROM (SELECT page_id, u.host, port,
  CASE WHEN scheme NOT IN ('http', 'https') THEN 'invalid_url' WHEN user THEN 'credentials' %s WHEN NOT s.bad THEN CASE WHEN s.closed THEN 'blocked' ELSE 'ok' END
  WHEN dns.bad IS NULL THEN 'unresolved' WHEN dns.bad THEN 'invalid_address' WHEN dns.closed THEN 'blocked' ELSE 'ok' END AS v FROM u LEFT JOIN shut s ON s.t = u.host LEFT JOIN dns ON dns.host = u.host)"""


_ALLOWED = "WHEN NOT (ends_with(u.host, '.com') OR ends_with(u.host, '.org') OR ends_with(u.host, '.net') OR u.host = '8.*') THEN 'not_allowed'"
QUERIES = {"url_policy": url_policy, "url_policy_open": url_policy_open}
ORACLES = {"url_policy": _sql().replace("%s", _ALLOWED), "url_policy_open": _sql().replace("%s", "")}
