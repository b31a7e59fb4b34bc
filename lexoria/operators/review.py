"""Review of answers: clauses and tokens with their places, uncovered tokens, policies, decisions.

Places are code points from 0, ends exclusive. Texts here are answers, which are short: the places
of one text are folded up inside its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What ends a clause, what a token is, and what makes a clause technical.
CLAUSE_END = r"(?iU)[.!?;\n]|\s+\b(?:e|mas|por[eé]m)\b\s+"
TOKEN = r"(?U)\w+(?:[./_-]\w+)*"
TECHNICAL = (
    r"(?iU)\d|[`=<>]|\b(?:n[aã]o|nunca|somente|apenas|se|quando|deve|precisa|par[aâ]metr\w*|campo\w*|tabela\w*|rotina\w*|op[cç][aã]o|"
    r"configura[cç][aã]o|sql|select|update|insert|delete|api|endpoint|erro\w*|c[oó]digo\w*|valor\w*|usu[aá]rio\w*|senha\w*|habilitad\w*|desabilitad\w*)\b"
)
CITATION = r"(?iU)\[fonte:\s*[^\]]+\]"
_SOURCES = r"(?imU)^\s*Fontes:\s*$"
_SPANS = "array<struct<start:int,end:int>>"


def spans(text: Column, pattern: str) -> Column:
    """The places of a pattern's matches, leftmost and not overlapping."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x))
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("n"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + x["gap"]
        return F.struct((begin + x["n"]).alias("at"), F.concat(a["out"], F.array(F.struct(begin.alias("start"), (begin + x["n"]).alias("end")))).alias("out"))

    return F.aggregate(pairs, start, step, lambda a: a["out"])


def answer_body(answer: Column) -> Column:
    """The answer up to its section of sources."""
    return F.element_at(F.split(F.coalesce(answer, F.lit("")), _SOURCES, 2), 1)


def clause_ranges(body: Column) -> Column:
    """The places of what lies between the ends of clauses, empty ones included."""
    ends = spans(body, CLAUSE_END)
    starts = F.concat(F.array(F.lit(0)), F.transform(ends, lambda x: x["end"]))
    stops = F.concat(F.transform(ends, lambda x: x["start"]), F.array(F.length(body)))
    return F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), b.alias("end")))


def review_tokens(rows: DataFrame, answer: str, name: str = "tokens") -> DataFrame:
    """``rows`` with (start, end, technical) of every token of the answer's body outside inline
    citations; technical if its clause names a condition, a negation, a number or a technical term.
    Each step is made once a row: what a generator yields is not computed again where it is used."""
    once = lambda df, column, value: df.withColumn(column, F.explode(F.array(value)))
    out = once(rows, "_body", answer_body(F.col(answer)))
    out = once(out, "_cited", spans(F.col("_body"), CITATION))
    out = once(out, "_clauses", clause_ranges(F.col("_body")))
    text = lambda c: F.substr(F.col("_body"), c["start"] + 1, c["end"] - c["start"])
    out = once(out, "_texts", F.transform("_clauses", text))
    mark = lambda c, t: F.struct(c["start"].alias("base"), t.rlike(TECHNICAL).alias("technical"), spans(t, TOKEN).alias("found"))
    out = once(out, "_marked", F.zip_with("_clauses", "_texts", mark))
    moved = lambda m: F.transform(m["found"], lambda x: F.struct((x["start"] + m["base"]).alias("start"), (x["end"] + m["base"]).alias("end"), m["technical"].alias("technical")))
    free = lambda x: ~F.exists("_cited", lambda c: (c["start"] <= x["start"]) & (x["start"] < c["end"]))
    return once(out, name, F.filter(F.flatten(F.transform("_marked", moved)), free)).drop("_body", "_cited", "_clauses", "_texts", "_marked")


def uncovered(tokens: Column, claims: Column) -> Column:
    """The technical tokens that lie in no claim. claims: array of (start, end)."""
    return F.filter(tokens, lambda t: t["technical"] & ~F.exists(claims, lambda c: (c["start"] <= t["start"]) & (t["end"] <= c["end"])))


def threshold_problem(low: Column, high: Column) -> Column:
    """Null for 0 <= low < high <= 1; else what is wrong."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x)
    return F.when(~(finite(low) & finite(high)), "missing").when((low < 0) | (high > 1), "out_of_range").when(low >= high, "not_rising")


def grounding_decision(status: Column, attempts_left: Column, revised_status: Column) -> Column:
    """(action, reason) after at most one rewriting: a supported answer stays; only a rejected one is
    rewritten, and its rewriting stays if it is supported; whatever else abstains, also where a
    status is missing."""
    first = F.coalesce(status, F.lit("inconclusive"))
    second = F.coalesce(revised_status, F.lit("inconclusive"))
    rewritten = (first == "rejected") & (attempts_left > 0)
    action = F.when(first == "supported", "keep").when(rewritten & (second == "supported"), "keep_revised").otherwise("abstain")
    last = F.when(rewritten, second).otherwise(first)
    return F.struct(action.alias("action"), F.when(action == "abstain", F.concat(F.lit("semantic_grounding_"), last)).alias("reason"))


def retry_decision(critical: Column, attempts: Column, most: int = 1) -> Column:
    """What follows a check of citations: accept, retry while attempts are left, else abstain."""
    return F.when(~F.coalesce(critical, F.lit(True)), "accept").when(attempts < most, "retry").otherwise("abstain")
