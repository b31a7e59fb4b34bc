"""Parsers, table access, packing, evaluation, lifecycle, grounding and streams."""

from __future__ import annotations

import hashlib
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexoria.functions import text as tx
from lexoria.functions import vectors as vx
from lexoria.operators import context, evaluation, grounding, lifecycle, markdown, routing
from lexoria.sources import files, tables
from lexoria.streaming import extensions as st


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_markdown_sections_respect_fences_and_keys():
    text = "intro\n# A {#top}\nbody\n```\n# not a heading\n```\n### C ##\nx\n## B\n\n~~~\n# open"
    got = [(s.level, s.title, s.key, s.path) for s in markdown.split_sections(text)]
    assert got == [(0, "", None, ""), (1, "A", "top", "A"), (3, "C", None, "A > C"), (2, "B", None, "A > B")]
    assert markdown.split_sections("  \n") == [] and markdown.code_blocks("```\na\n```\n~~~\nb") == ["a", "b"]


def test_chunks_cover_the_text_with_overlap():
    text = " ".join(f"w{i}" for i in range(2000))
    parts = markdown.split_text(text, 500, 100)
    assert all(len(p) <= 500 for p in parts) and {w for p in parts for w in p.split()} == set(text.split())
    assert all(context.overlap(a, b, 300, 1) > 0 for a, b in zip(parts, parts[1:]))
    assert markdown.split_text("x" * 1300, 500, 0) == ["x" * 500, "x" * 500, "x" * 300] and markdown.split_text("") == []


def test_html_titles_and_lines():
    title, text = markdown.html_text("<html><head><title>T</title><script>x()</script></head><body><h1>H  1</h1><p>a &amp;\n b</p><p></p></body>")
    assert title == "H 1" and text == "H 1\na & b"
    assert markdown.html_text('<meta property="og:title" content="OG"><h1>H</h1>')[0] == "OG"


def test_text_functions(spark):
    assert one(spark, tx.clean_page_title(F.lit("Long title - Site"))) == "Long title" and one(spark, tx.clean_page_title(F.lit("ab - Site"))) == "ab - Site"
    assert one(spark, tx.normalize_text(F.lit("Ação  ﬁm½ X!"))) == "acao fim1 2 x"
    rng = random.Random(1)
    odd = ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x300, 0x370), rng.randrange(0x900, 0x1100), rng.randrange(32, 127)])) for _ in range(12)) for _ in range(2000)] + [None, ""]
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()
    rows = spark.createDataFrame([(t,) for t in odd], "t string").select("t", tx.normalize_text(F.col("t")).alias("n")).collect()
    assert all(r.n == (None if r.t is None else " ".join(re.sub("[^a-z0-9]+", " ", plain(r.t)).split())) for r in rows)
    assert one(spark, tx.content_hash(F.lit("a\r\nb\rc"))) == one(spark, tx.content_hash(F.lit("a\nb\nc")))
    assert tx.split_message("aaa bbb\nccc ddd", 8) == ["aaa bbb", "ccc ddd"] and tx.split_message("x" * 5, 2) == ["xx", "xx", "x"]
    assert one(spark, tx.is_url(F.lit("ftp://x/y"))) is False and one(spark, tx.is_url(F.lit("https://x/y"))) is True
    assert one(spark, routing.expand_abbreviations(F.lit("ver nf  RCA, xnf nfe"))) == "ver nf nota fiscal RCA representante comercial autonomo, xnf nfe nota fiscal eletronica"
    assert one(spark, routing.expand_abbreviations(F.lit("  "))) == "  "
    assert one(spark, vx.safe_number(F.lit("nan"))) == 0.0 and one(spark, vx.safe_number(F.lit("2.5"))) == 2.5
    with pytest.raises(Exception, match="dimension"):
        one(spark, vx.clean_vector(F.array(F.lit(1.0)), 2))


def test_words_slugs_and_hashes_of_odd_texts(spark):
    texts = ["", " ", "\t\n", "\n a  b\t", "a", "__a b__", "\u00e9\u00e9", "_", "a\r\nb\rc\n", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    x = F.col("x")
    got = {r.i: r for r in frame.select("i", tx.word_count(x).alias("n"), tx.slug(x).alias("slug"), tx.content_hash(x).alias("h")).collect()}
    for i, text in enumerate(texts):
        if text is None:
            assert got[i][1:] == (None, "source", None)
            continue
        assert got[i].n == len(text.split())
        assert got[i].slug == (re.sub("[^A-Za-z0-9._-]+", "_", text).strip("_") or "source")
        assert got[i].h == hashlib.sha256(re.sub("\r\n?", "\n", text).encode()).hexdigest()


def test_filter_language(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", True), (None, "A", False)], "n int, s string, b boolean")
    got = lambda **f: [r.s for r in tables.select(df, "s", f).collect()]
    assert got(n="gte.2") == ["b"] and got(s="ilike.a%") == ["a", "A"] and got(b="is.null") == ["a"] and got(n="in.(1,2)") == ["a", "b"]
    assert got(s="b") == ["b"] and got(b="is.true") == ["b"] and got(n="neq.1") == ["b"] and got(s="x.y") == []
    assert [r.s for r in tables.select(df, "*", {"order": "n.desc,s", "limit": 2}).collect()] == ["A", "b"]
    assert [r.s for r in tables.select(df, "*", order="n").collect()] == ["a", "b", "A"]
    for bad in (lambda: tables.delete(df, {}), lambda: tables.update(df, {"s": "z"}, {}), lambda: tables.columns("a;b"), lambda: tables.insert(df, [{"n": 1}, {"s": "x"}])):
        with pytest.raises(ValueError):
            bad()
    assert tables.delete(df, {"n": "eq.1"}).count() == 2 and tables.insert(df, [{"n": 5}]).count() == 4
    assert tables.update(df, {"s": "z"}, {"n": "lt.3"}).filter("s = 'z'").count() == 2


def test_packing_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate([5, 9, 3, 4, 1])], "g int, i int, c int")
    assert [r.i for r in context.greedy_fit(df, "g", [F.col("i")], "c", 10).orderBy("i").collect()] == [0, 2, 4]
    rows = spark.createDataFrame([(1, i, "p" * 50 + f"{i}" * 60) for i in range(2)], "document_id long, chunk_index int, content string")
    merged = context.merge_chunks(rows.withColumn("content", F.when(F.col("chunk_index") == 0, F.lit("start " + "q" * 45)).otherwise(F.lit("q" * 45 + " end")))).first().content
    assert merged == "start " + "q" * 45 + "\n\nend"


def test_ndcg_and_coverage(spark):
    q = spark.createDataFrame([(1, "a", 3), (1, "b", 0), (1, "c", 2)], "case_id int, candidate_id string, relevance int")
    r = spark.createDataFrame([(1, "c", 1), (1, "b", 2), (1, "a", 3)], "case_id int, candidate_id string, rank int")
    import math

    ideal = 7 + 3 / math.log2(3)
    assert evaluation.ndcg(r, q).first().ndcg == round((3 + 7 / 2) / ideal, 4)
    assert evaluation.ndcg(r.union(spark.createDataFrame([(1, "x", 40)])), q).first().ndcg is None
    w = one(spark, evaluation.wilson(F.lit(8), F.lit(10)))
    assert (w.low, w.high) == (0.4902, 0.9433) and one(spark, evaluation.wilson(F.lit(0), F.lit(0))) is None


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.createDataFrame([(i, None if i % 3 else "x") for i in range(50)], "a int, b string")
    f = lambda d: lifecycle.fingerprint(d, ["a", "b"]).first()
    assert f(df) == f(df.repartition(5)) and f(df) != f(df.filter("a <> 7")) and f(df.limit(0)).rows == 0


def test_losses_are_multiset_differences_in_one_shuffle(spark):
    source = [(1, "table", "a"), (1, "table", "a"), (1, "table", None), (1, "code", "a"), (2, "table", None), (None, "code", "b"), (3, "text", "a")]
    target = [(1, "table", "a"), (1, "table", None), (1, "code", "b"), (None, "code", "b"), (4, "table", "a")]
    kind = "unit_id long, category string, item string"
    got = lifecycle.losses(spark.createDataFrame(source, kind), spark.createDataFrame(target, kind), ["table", "code"])
    assert sorted(map(tuple, got.collect())) == [(1, "code", 1), (1, "table", 1), (2, "table", 1)]
    assert got._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_review_steps_that_are_not_allowed(spark):
    e = [(1, 1, 1, "APPROVE"), (1, 2, 2, "PUBLISH"), (1, 3, 3, "PUBLISH"), (1, 4, 4, "REJECT"), (2, 1, 1, "PUBLISH"), (2, 2, 2, "REJECT"), (2, 3, 3, "APPROVE")]
    got = {r.item_id: tuple(r)[1:] for r in lifecycle.fold_reviews(spark.createDataFrame(e, "item_id int, at int, seq int, action string")).collect()}
    assert got == {1: ("PUBLISHED", 2, 1), 2: ("APPROVED", 0, 1)}


def test_citations(spark):
    answer = F.lit("Text [fonte: A.md; `b.md`]\n\nFontes:\n- **C.md** (p. 2)\n1. a.md\nOther part:\n- no.md")
    assert one(spark, grounding.cited_sources(answer)) == ["a.md", "b.md", "c.md"]
    only = one(spark, grounding.sources_only(F.lit("Text [fonte: A.md; z.md] more"), F.array(F.lit("a.md"))))
    assert only == "Text more\n\nFontes:\n- a.md"
    assert one(spark, grounding.claim_status(F.lit(0.9), F.lit(0.1))) == "supported" and one(spark, grounding.claim_status(F.lit(0.5), F.lit(0.1))) == "inconclusive"


def test_file_sources(spark, tmp_path):
    import zipfile

    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_bytes(b"---\nid: 1\n---\n# T\n")
    (tmp_path / "bad.txt").write_bytes(b"ok \xff\xfe end")
    (tmp_path / "skip.bin").write_bytes(b"x")
    (tmp_path / "urls.txt").write_text("# no\nhttp://a/1 http://b/2\n\nhttp://a/1\n")
    with zipfile.ZipFile(tmp_path / "sub" / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>t</w:t><w:t>wo</w:t></w:r></w:p></w:body></w:document>')
    with zipfile.ZipFile(tmp_path / "sub" / "t.xlsx", "w") as z:
        m = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{m}"><si><t>Code</t></si><si><t>Name</t></si><si><t>first</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{m}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>7</v></c><c r="C2" t="s"><v>2</v></c></row><row r="3"/></sheetData></worksheet>')
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_documents(spark, str(tmp_path), recursive=True).collect()}
    assert got["d.docx"].text == "one\n\ntwo" and got["a.md"].text.startswith("---") and got["bad.txt"].text == "ok  end" and "skip.bin" not in got
    assert "d.docx" not in {r.path.rsplit("/", 1)[1] for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert [r.url for r in files.url_list(spark, str(tmp_path / "urls.txt")).orderBy("url").collect()] == ["http://a/1", "http://b/2"]
    assert [(r.row, dict(r.cells)) for r in files.xlsx_rows(spark, str(tmp_path / "sub" / "t.xlsx")).orderBy("row").collect()] == [(2, {"Code": "7", "Name": "first"})]
    assert files.front_matter("---\na: 1\n---\nbody") == ("a: 1", "body", 4) and files.front_matter("x") == (None, "x", 1)


def test_streams(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.checkpointLocation", str(tmp_path / "c"))
    spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "x")], "conv_id long, turn long, text string").write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema("conv_id long, turn long, text string").parquet(str(tmp_path / "t"))
    got = {r.conv_id: r.turns for r in st.drain(st.last_turns(stream, 2), "update", str(tmp_path / "turns_test")).collect()}
    assert got == {1: "1,2", 2: "0"}
