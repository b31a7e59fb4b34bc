"""Secret scans over an incremental blob ledger (DataFrame operations only).

Every version of every document is addressed by the SHA-256 of its text. Only pairs of a blob and
a rule version that the ledger does not hold are scanned; findings are kept per blob and joined
back to every path that has the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut


@dataclass(frozen=True)
class SecretRule:
    """kind; pattern (matches are leftmost and do not overlap); the group whose length must reach
    ``least``; a version, to be raised with every change of the pattern; base: whether the rule is
    one of the fixed ones."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1
    base: bool = True

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


RULES = (
    SecretRule("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 20),
    SecretRule("hex", r"[0-9a-f]+", 0, 24),
    SecretRule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1, base=False),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, base=False),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, base=False),
)


def _scan(rule: SecretRule) -> Column:
    """(gap before, match length, value length) of every match, in order; gaps locate the matches."""
    # A run of hex digits shorter than the least length fails anyway, so only long runs are met.
    pattern = rule.pattern if rule.kind != "hex" else rf"[0-9a-f]{{{rule.least},}}"
    matches = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all("text", F.lit(pattern), F.lit(rule.group)) if rule.group else matches
    gaps = F.split("text", pattern, -1)
    zipped = F.arrays_zip(F.slice(F.transform(gaps, F.length), 1, F.size(matches)).alias("gap"), F.transform(matches, F.length).alias("len"), F.transform(values, F.length).alias("val"))
    named = F.transform(zipped, lambda z: F.struct(F.lit(rule.kind).alias("kind"), z["gap"].alias("gap"), z["len"].alias("len"), z["val"].alias("val")))
    empty = F.array().cast("array<struct<kind:string,gap:int,len:int,val:int>>")
    return F.when(F.array_contains("pending", rule.key) & F.col("text").rlike(pattern), named).otherwise(empty)


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan(docs: DataFrame, ledger: DataFrame | None = None, findings: DataFrame | None = None, rules: tuple[SecretRule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(ledger, findings) after the texts of ``docs``, given those before.

    ledger: (blob, rule) pairs scanned so far. findings: (blob, rule, kind, start, end) in code
    points, end exclusive. A text that many rows hold is scanned once. A null text is empty.
    """
    blobs = docs.select(blob_id(F.col("text")).alias("blob"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    every = F.array(*[F.lit(r.key) for r in rules])
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("pending", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))))
        blobs = blobs.filter(F.size("pending") > 0).groupBy("blob").agg(F.first("text").alias("text"), F.first("pending").alias("pending"))
    else:
        blobs = blobs.groupBy("blob").agg(F.first("text").alias("text")).withColumn("pending", every)
    scanned = blobs.withColumn("found", F.concat(*[_scan(r) for r in rules])).select("blob", "pending", "found")
    scanned = cut(scanned)
    rows = scanned.filter(F.size("found") > 0).select("blob", F.posexplode("found").alias("i", "m")).select("blob", "i", "m.*")
    run = Window.partitionBy("blob", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(run)).withColumn("start", F.col("end") - F.col("len"))
    least = F.element_at(F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.least)]), F.col("kind"))
    key = F.element_at(F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.key)]), F.col("kind"))
    fresh = rows.filter(F.col("val") >= least).select("blob", key.alias("rule"), "kind", "start", "end")
    pairs = scanned.select("blob", F.explode("pending").alias("rule"))
    if ledger is not None:
        pairs = ledger.select("blob", "rule").unionByName(pairs)
    if findings is not None:
        fresh = findings.select("blob", "rule", "kind", "start", "end").unionByName(fresh)
    return pairs, cut(fresh)


def findings_by_path(docs: DataFrame, findings: DataFrame, rules: tuple[SecretRule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` with its spans: array of (start, order, end,
    kind) by start, then kind in the order of the rules; empty without findings. Only findings
    of the given rule versions count."""
    order = F.element_at(F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)]), F.col("kind"))
    spans = findings.filter(F.col("rule").isin([r.key for r in rules])).groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", order.alias("order"), "end", "kind"))).alias("spans"))
    paths = docs.withColumn("_blob", blob_id(F.col("text"))).select(*keep, "_blob")
    none = F.array().cast("array<struct<start:bigint,order:int,end:bigint,kind:string>>")
    return paths.join(spans, F.col("_blob") == F.col("blob"), "left").select(*keep, F.coalesce("spans", none).alias("spans"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Spans from which a text is cut into characters once, instead of being walked for every span.
MANY_SPANS = 16


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span (sorted by start; they may overlap) replaced by a mark."""

    def done(part, rest) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<string>").alias("out"))
        before = lambda a, s: F.array(part(a["pos"], s["start"] - a["pos"]), F.lit(mark))
        step = lambda a, s: F.when(s["end"] > a["pos"], F.struct(s["end"].alias("pos"), F.when(s["start"] >= a["pos"], F.concat(a["out"], before(a, s))).otherwise(a["out"]).alias("out"))).otherwise(a)
        return F.aggregate(spans, zero, step, lambda a: F.concat(F.array_join(a["out"], ""), rest(a["pos"])))

    chars = F.split(text, "")
    few = done(lambda at, n: F.substr(text, (at + 1).cast("int"), n.cast("int")), lambda at: F.substr(text, (at + 1).cast("int"), F.length(text)))
    many = done(lambda at, n: F.array_join(F.slice(chars, (at + 1).cast("int"), n.cast("int")), ""), lambda at: F.array_join(F.slice(chars, (at + 1).cast("int"), F.length(text)), ""))
    return F.when(F.size(spans) >= MANY_SPANS, many).when(F.size(spans) > 0, few).otherwise(text)
