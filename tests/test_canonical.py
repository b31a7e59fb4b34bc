from __future__ import annotations

from pyspark.sql import functions as F

from lexoria.operators import canonical, claims, markdown


def test_legacy_diagnostics(spark):
    assert markdown.fence_left_open("```\na\n```\nb") is None and markdown.fence_left_open("a\n~~~\n```") == 2
    texts = [
        ("kb/a.md", "# T\nok ![i](pic.png)"), ("kb/b.md", "## A\n#### B\n![x](../pic.png) ![y](https://h/p.png)\n```\nopen"), ("kb/c.md", "# A\n# B\n# C\n# D"),
        ("kb/d.md", None), ("kb/e.md", "# T\n" + "line\n" * 2_000), ("kb/f.md", "# T\n" + "ã" * 60_000),
    ]
    docs = spark.createDataFrame(texts, "path string, text string")
    files = spark.createDataFrame([("kb/pic.png",), ("kb/pic.png",)], "path string")
    got = {(r.path[3:4], r.code, r.line, r.detail) for r in canonical.legacy_diagnostics(docs, files).collect()}
    assert got == {
        ("b", "title-missing", None, "0"), ("b", "heading-level-jump", 2, "2>4"), ("b", "fence-unclosed", 4, ""), ("b", "visual-source-missing", None, "../pic.png"),
        ("c", "multiple-h1", None, "4"), ("c", "document-heterogeneous", None, "4"), ("d", "title-missing", None, "0"), ("e", "document-heterogeneous", None, "2002"), ("f", "document-heterogeneous", None, "2"),
    }
    assert canonical.legacy_diagnostics(docs.limit(0), files).count() == 0


def test_images_and_totals(spark):
    show = lambda text, path: spark.range(1).select(canonical.local_images(F.lit(text), F.lit(path)).alias("x")).first().x
    assert show("![a](x.png) ![b](<a/../y.png>) ![c](//h/z.png) ![d](/abs.png)", "p.md") == ["x.png", "y.png", None]
    assert show("![a](..%2Fx+1.png)", "k/p.md") == ["x+1.png"] and show(None, "p.md") == [] and show("![a](../../x)", "k/p.md") == [None]
    runs = spark.createDataFrame([(None, None, False, 3, 0), ("", None, None, 2, None)], "error string, error_type string, skipped boolean, chunks int, failed_chunks int")
    row = canonical.run_totals(runs, 2).first()
    assert row.complete and row.chunks == 5 and row.error_types == {} and not canonical.run_totals(runs.limit(0), 1).first().complete


def test_rounds_close_at_the_first_failure(spark):
    asked = spark.createDataFrame([(1, "a", 1, "supported"), (1, "b", 2, "unsupported"), (2, "a", 1, "supported"), (3, "a", None, "supported"), (4, "a", 1, "conflicting")], "answer_id int, claim_id string, batch int, status string")
    decided = spark.createDataFrame([(1, 1, "ok", True), (1, 2, "timeout", True), (2, 1, "ok", True), (4, 1, "ok", True)], "answer_id int, batch int, outcome string, model_matches boolean")
    got = {r.answer_id: (r.status, r.reason, r.judged) for r in claims.claim_round(asked, decided).collect()}
    assert got == {1: ("inconclusive", "timeout", 1), 2: ("supported", None, 1), 3: ("inconclusive", "state_limit", 0), 4: ("rejected", None, 1)}
