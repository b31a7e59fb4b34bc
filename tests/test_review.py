from __future__ import annotations

import re

from pyspark.sql import functions as F

from lexoria.operators import review


def plain_tokens(answer):
    end = re.search(r"(?im)^\s*Fontes:\s*$", answer)
    body = answer[: end.start()] if end else answer
    cited = [m.span() for m in re.finditer(r"(?i)\[fonte:\s*[^\]]+\]", body)]
    out, start = [], 0
    marks = [m.span() for m in re.finditer(r"(?i)[.!?;\n]|\s+\b(?:e|mas|por[eé]m)\b\s+", body)] + [(len(body), len(body))]
    for a, b in marks:
        clause = body[start:a]
        technical = bool(re.search(review.TECHNICAL.replace("(?iU)", "(?i)"), clause))
        out += [(start + m.start(), start + m.end(), technical) for m in re.finditer(r"\w+(?:[./_-]\w+)*", clause) if not any(x <= start + m.start() < y for x, y in cited)]
        start = b
    return out


ANSWERS = [
    "O parâmetro X-1 deve ser 5; mas não use a tabela. Configuração é simples [fonte: a.md; b] e pronto!\nFontes:\n- a.md",
    "Texto livre porém curto\n\nsegunda linha, com itens/v1.2 e outro", "", "Fontes:\nx", "olá", "a e b mas c porém d", "usuário_1 ÇÃO [Fonte: x] [fonte:",
]


def test_tokens_and_clauses_match_plain_python(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect() if r.text]
    answers = ANSWERS + [t[:1500] for t in docs]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(answers)], "i int, t string")
    got = {r.i: [tuple(x) for x in r.x] for r in review.review_tokens(frame, "t", "x").collect()}
    for i, t in enumerate(answers):
        assert got[i] == plain_tokens(t), t
    assert review.review_tokens(frame.limit(1).select(F.lit(None).cast("string").alias("t")), "t").first().tokens == []


def test_uncovered_tokens_policies_and_decisions(spark):
    row = spark.createDataFrame([(ANSWERS[0],)], "t string")
    claims = F.array(F.struct(F.lit(0).alias("start"), F.lit(29).alias("end")))
    left = review.review_tokens(row, "t").select(review.uncovered(F.col("tokens"), claims).alias("x")).first().x
    assert left and all(x.technical and x.start >= 28 for x in left)
    p = spark.createDataFrame([(0.2, 0.8), (0.8, 0.2), (-0.1, 0.5), (None, 0.5), (0.5, float("nan"))], "a double, b double")
    assert [r[0] for r in p.select(review.threshold_problem(F.col("a"), F.col("b"))).collect()] == [None, "not_rising", "out_of_range", "missing", "missing"]
    d = spark.createDataFrame([("supported", 1, None), ("rejected", 1, "supported"), ("rejected", 1, "inconclusive"), ("rejected", 0, "supported"), ("inconclusive", 1, "supported"), (None, 1, None)], "s string, n int, r string")
    assert [tuple(r[0]) for r in d.select(review.grounding_decision(F.col("s"), F.col("n"), F.col("r"))).collect()] == [
        ("keep", None), ("keep_revised", None), ("abstain", "semantic_grounding_inconclusive"), ("abstain", "semantic_grounding_rejected"), ("abstain", "semantic_grounding_inconclusive"), ("abstain", "semantic_grounding_inconclusive"),
    ]
    c = spark.createDataFrame([(False, 0), (True, 0), (True, 1), (None, 1)], "c boolean, n int")
    assert [r[0] for r in c.select(review.retry_decision(F.col("c"), F.col("n"))).collect()] == ["accept", "retry", "abstain", "abstain"]
