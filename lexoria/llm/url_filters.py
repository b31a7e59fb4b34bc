"""URL filters with redirect equivalence (DataFrame operations only).

A url is judged by the longest rule that fits. Urls joined by redirects or canonical links form
classes (distributed connected components): a block rule that fits any member blocks the members
without a rule of their own, unless an allow rule fits a member, which then allows them.

Links are resolved against the page's url as browsers do. Urls are the same member if they are
equal after A-Z in scheme and host are lower-cased, dot segments and the fragment are removed and
an empty path becomes ``/``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import cut

#: Up to this many rules are looked up inside each row, one by one; more are joined on the host.
INLINE_RULES = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SCHEME = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*):"
_DOTS = r"(?s)(^|/)\.\.?(/|$)"
#: Tags, and what marks those that count: rel with the word canonical, http-equiv refresh.
_LINK, _META = r"(?is)<link\b[^>]*>", r"(?is)<meta\b[^>]*>"
_CANONICAL = r"(?is)\brel\s*=\s*(\"[^\"]*\bcanonical\b[^\"]*\"|'[^']*\bcanonical\b[^']*'|canonical\b)"
_REFRESH = r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b"
_TO = r"(?is)\burl\s*=\s*[\"']?\s*([^\s\"'>;]+)"


@dataclass(frozen=True)
class UrlRule:
    verdict: str  # allow or block
    host: str
    path: str

    @staticmethod
    def parse(verdict: str, rule: str) -> UrlRule:
        host, slash, path = rule.partition("/")
        return UrlRule(verdict, host, slash + path)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _lower(x: Column) -> Column:
    return F.translate(x, _UPPER, _LOWER)


def _without_dots(path: Column) -> Column:
    """A path that begins with a slash, without its segments ``.`` and ``..``."""
    parts = F.split(F.substring(path, 2, 2**31 - 1), "/", -1)
    step = lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    last = F.element_at(parts, -1)
    kept = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.rlike(_DOTS), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def url_node(url: Column) -> Column:
    """The url as a member of a class; null without a scheme, ``://`` and a host."""
    origin = F.regexp_extract(url, r"(?s)^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    path = F.regexp_extract(url, r"(?s)^[^:]*://[^/?#]+([^?#]*)", 1)
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.when(origin != "", F.concat(_lower(origin), _without_dots(F.when(path == "", "/").otherwise(path)), query))


def resolve_link(base: Column, link: Column) -> Column:
    """The absolute url of a link on a page; null for links that lead nowhere else (fragments,
    ``mailto:`` and the like)."""
    scheme = F.regexp_extract(base, _SCHEME, 1)
    origin = F.regexp_extract(base, r"(?s)^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"(?s)^[^:]*://[^/?#]*([^?#]*)", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, r"(?s)[^/]*$", ""))
    here = (
        F.when(link.rlike(r"(?s)^\s*(#|$)"), None).when(link.rlike(_SCHEME), F.when(link.contains("://"), link))
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link)).when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(origin, F.when(path == "", "/").otherwise(path), link)).otherwise(F.concat(origin, folder, link))
    )
    return F.when(origin != "", url_node(here))


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value, quoted or not; empty without."""
    quoted = rf"(?is)\b{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.trim(F.concat(*[F.regexp_extract(tag, quoted, i) for i in (1, 2, 3)]))


def _suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def apply_rules(urls: DataFrame, rules: list[UrlRule] | DataFrame, url_col: str = "url") -> DataFrame:
    """``urls`` with host, path, rule and rule_verdict (null where none fits; the longest wins,
    then the one with the longer host, then allow). Rules without a host or with another verdict
    than allow or block are left out; a rule without a path fits every path."""
    out = urls.withColumn("host", url_host(F.col(url_col))).withColumn("path", url_path(F.col(url_col)))
    if isinstance(rules, DataFrame):
        rules = rules.filter(F.col("host").isNotNull() & F.col("verdict").isin("allow", "block")).select("verdict", "host", F.coalesce("path", F.lit("")).alias("path"))
        listed = rules.limit(INLINE_RULES + 1).collect()
        rules = rules if len(listed) > INLINE_RULES else [UrlRule(*r) for r in listed]
    elif len(rules) > INLINE_RULES:
        named = [(r.verdict, r.host, r.path or "") for r in rules if r.host is not None and r.verdict in ("allow", "block")]
        rules = out.sparkSession.createDataFrame(named, "verdict string, host string, path string")
    rank = "struct<len:int,hosts:int,verdict:int,rule:string>"
    if not isinstance(rules, DataFrame):
        by_host: dict[str, list[dict]] = {}
        for r in (UrlRule(r.verdict, r.host, r.path or "") for r in rules if r.host is not None and r.verdict in ("allow", "block")):
            by_host.setdefault(r.host, []).append({"path": r.path, "rank": {"len": len(r.host + r.path), "hosts": len(r.host), "verdict": int(r.verdict == "allow"), "rule": r.host + r.path}})
        table = F.from_json(F.lit(json.dumps(by_host)), f"map<string,array<struct<path:string,rank:{rank}>>>")
        found = F.flatten(F.transform(F.filter(_suffixes(F.col("host")), lambda s: F.map_contains_key(table, s)), lambda s: F.element_at(table, s)))
        best = F.array_max(F.transform(F.filter(found, lambda x: F.col("path").startswith(x["path"])), lambda x: x["rank"]))
        out = out.withColumn("_best", best)
    else:
        listed = rules.select(F.col("host").alias("_on"), F.col("path").alias("_prefix"), F.struct((F.length("host") + F.length("path")).alias("len"), F.length("host").alias("hosts"), (F.col("verdict") == "allow").cast("int").alias("verdict"), F.concat("host", "path").alias("rule")).alias("_rank"))
        seen = out.select("host", "path").distinct()
        fits = seen.withColumn("_on", F.explode(_suffixes(F.col("host")))).join(listed, "_on").filter(F.col("path").startswith(F.col("_prefix")))
        out = out.join(fits.groupBy("host", "path").agg(F.max("_rank").alias("_best")), ["host", "path"], "left")
    verdict = F.when(F.col("_best.verdict") == 1, "allow").when(F.col("_best.verdict") == 0, "block")
    return out.withColumn("rule", F.col("_best.rule")).withColumn("rule_verdict", verdict).drop("_best")


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): each page's url and the targets of all its canonical links and meta refreshes, as
    members of classes."""
    html, url = F.coalesce(F.col(html_col), F.lit("")), F.col(url_col)
    low = F.lower(html)
    tags = lambda mark, tag, wanted: F.when(low.contains(mark), F.filter(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda t: t.rlike(wanted)))
    href = F.transform(tags("canonical", _LINK, _CANONICAL), lambda t: _attribute(t, "href"))
    to = F.transform(tags("refresh", _META, _REFRESH), lambda t: F.regexp_extract(t, _TO, 1))
    none = F.array().cast("array<string>")
    links = pages.filter(url.isNotNull()).select(url.alias("base"), F.explode(F.concat(F.coalesce(href, none), F.coalesce(to, none))).alias("link"))
    plain = F.replace(F.col("link"), F.lit("&amp;"), F.lit("&"))
    edges = links.select(url_node(F.col("base")).alias("a"), resolve_link(F.col("base"), plain).alias("b"))
    return edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()


def judge_urls(pages: DataFrame, rules: list[UrlRule] | DataFrame, redirects: DataFrame | None = None, html_col: str | None = "html") -> DataFrame:
    """(page_id, url, host, path, rule, verdict, decided_by) of every row of ``pages``.

    redirects: more edges (a, b) between absolute urls, such as HTTP redirects from a crawl log.
    decided_by: rule, alias (an equivalent url's rule) or default (allow).
    Nulls: a null url has an empty host and path and is allowed; a null html has no links; rows
    with a null page_id are judged too. Repeated rows are each returned. Other columns are ignored.
    """
    cols = [F.col("page_id"), F.col("url").cast("string").alias("url")]
    judged = apply_rules(pages.select(*cols), rules)
    edges = alias_edges(pages, "url", html_col) if html_col else None
    if redirects is not None:
        more = redirects.select(url_node(F.col("a")).alias("a"), url_node(F.col("b")).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        edges = more if edges is None else edges.unionByName(more)
    default = F.lit("allow")
    unknown = F.lit(None).cast("string")
    if edges is not None and not (edges := cut(edges)).isEmpty():
        classes = cut(components(edges))
        marked = apply_rules(classes, rules, "node").filter("rule_verdict IS NOT NULL")
        decided = marked.groupBy("component").agg(F.max("rule_verdict").alias("high"), F.min("rule_verdict").alias("low"))
        decided = decided.select("component", F.when(F.col("low") == "allow", "allow").otherwise("block").alias("alias_verdict"))
        alias = classes.join(decided, "component").select("node", "alias_verdict")
        judged = judged.withColumn("node", url_node(F.col("url")))
        # Rows that are no member stay out of the join: their nulls would meet in one task.
        members = judged.filter("node IS NOT NULL").join(alias, "node", "left").drop("node")
        judged = members.unionByName(judged.filter("node IS NULL").drop("node").withColumn("alias_verdict", unknown))
    else:
        judged = judged.withColumn("alias_verdict", unknown)
    by = F.when(F.col("rule_verdict").isNotNull(), "rule").when(F.col("alias_verdict").isNotNull(), "alias").otherwise("default")
    return judged.select("page_id", "url", "host", "path", "rule", F.coalesce("rule_verdict", "alias_verdict", default).alias("verdict"), by.alias("decided_by"))
