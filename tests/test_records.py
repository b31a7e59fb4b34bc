from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lexoria.functions import text as tx
from lexoria.functions import vectors as vx
from lexoria.operators import dataset, ingest, lifecycle, preservation
from lexoria.sources import records


def test_cases_are_read_normalised_and_distinct(spark, tmp_path):
    rows = [{"question": " How? ", "expected_behavior": "CLARIFY"}, {"id": "b", "question": "how"}, {"question": "  "}, {"question": "Other", "split": "holdout", "tags": ["x"]}]
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps(r) for r in rows) + "\n\n")
    (tmp_path / "c.json").write_text(json.dumps(rows))
    for path, lines in (("c.jsonl", True), ("c.json", False)):
        read = records.read_cases(spark, str(tmp_path / path), lines)
        got = dataset.distinct_cases(read).orderBy("position").collect()
        assert [(r.question, r.expected_behavior, r.split, r.answerability) for r in got] == [("How?", "clarify", "development", "ambiguous"), ("Other", "exact_answer", "holdout", "answerable")]
    (tmp_path / "bad.jsonl").write_text("[1, 2]\n")
    with pytest.raises(Exception, match="not a JSON object"):
        records.read_cases(spark, str(tmp_path / "bad.jsonl")).collect()


def test_logs_append_and_replace_runs(spark, tmp_path):
    path = str(tmp_path / "log")
    assert not records.table_exists(spark, path)
    row = lambda *r: spark.createDataFrame(list(r), "filename string, failed_chunks int")
    records.append(row(("a", 2), ("b", 1)), path, "r1", "2024-01-01 00:00:00")
    records.append(row(("a", 0)), path, "r2", "2024-01-02 00:00:00")
    records.append(row(("a", 0)), path, "r2", "2024-01-02 00:00:00")
    assert records.table_exists(spark, path) and records.read_log(spark, path).count() == 3 and records.read_log(spark, path, "r2").count() == 1
    assert [tuple(r) for r in records.open_failures(spark, path).collect()] == [("b", 1)]


def test_ordered_difference_stops_at_the_first_miss(spark):
    frame = spark.createDataFrame([(["a", "b", "c"], ["a", "c"]), (["a", "c"], ["a", "b", "c"]), ([], ["a"]), (["a", "a"], ["a"])], "s array<string>, t array<string>")
    assert [r[0] for r in frame.select(preservation.missing_in_order(F.col("s"), F.col("t"))).collect()] == [["b", "c"], [], [], ["a"]]


def test_an_ingest_run_skips_reuses_and_embeds(spark):
    incoming = spark.createDataFrame([(1, "same.md", "T", "md", "old text"), (2, "copy.md", "T", "md", "old text"), (3, "new.md", "T", "md", "fresh words " * 50), (4, "empty.md", None, "md", None)], "doc_id long, filename string, title string, doc_type string, text string")
    made = ingest.processing_hash(content=tx.content_hash(F.col("text")), title=F.col("title"), doc_type=F.col("doc_type"))
    existing = incoming.filter("doc_id = 1").select("filename", made.alias("processing_hash"), F.lit(1).alias("created_at"))
    chunks = spark.createDataFrame([("same.md", 0, "old text", [1.0, 2.0])], "filename string, chunk_index int, content string, embedding array<double>")
    documents, rows = ingest.ingest_documents(incoming, existing, chunks)
    assert {r.filename: (r.action, r.reuse_from) for r in documents.collect()} == {"same.md": ("skip", None), "copy.md": ("reuse", "same.md"), "new.md": ("embed", None), "empty.md": ("embed", None)}
    got = {r.filename: r.embedding for r in rows.collect()}
    assert got["copy.md"] == [1.0, 2.0] and got["new.md"] is None and "same.md" not in got


def test_fingerprints_are_one_for_any_size_and_order(spark):
    frame = spark.range(5000).withColumn("x", F.col("id") * 3)
    deep = lifecycle.fingerprint(frame, ["id", "x"]).first()
    assert deep.rows == 5000 and deep == lifecycle.fingerprint(frame.orderBy(F.desc("id")).unionByName(frame.limit(0)), ["id", "x"]).first()
    twice = frame.unionByName(frame.filter("id = 7"))
    assert lifecycle.fingerprint(twice, ["id", "x"]).first().fingerprint != deep.fingerprint
    assert deep == lifecycle.fingerprint(frame.repartition(7), ["x", "id"][::-1]).first()
    assert deep.fingerprint != lifecycle.fingerprint(frame.filter("id <> 9"), ["id", "x"]).first().fingerprint


def test_fingerprints_are_hashes_of_ordered_lists(spark):
    """What sums would take for the same is told apart, for all rows and for groups of them."""
    frame = spark.range(600).selectExpr("id", "id % 2 AS g")
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()

    def expected(ids):
        hashes, parts = sorted(sha(f"{i}") for i in ids), {}
        for h in hashes:
            parts.setdefault(h[:2], []).append(h)
        return sha("\n".join(sha("\n".join(parts[p])) for p in sorted(parts)))

    assert lifecycle.fingerprint(frame, ["id"]).first().fingerprint == expected(range(600))
    got = {r.g: (r.rows, r.fingerprint) for r in lifecycle.grouped_fingerprint(frame, "g", ["id"]).collect()}
    assert got == {g: (300, expected(range(g, 600, 2))) for g in (0, 1)}
    assert lifecycle.fingerprint(frame.limit(0), ["id"]).first().rows == 0


def test_hosts_vectors_and_scopes(spark):
    host = spark.createDataFrame([("a.com",), ("x.a.com",), ("b.org",), ("y.b.org",), (None,)], "h string")
    assert [r[0] for r in host.select(tx.host_allowed(F.col("h"), ["a.com", "*.B.org"])).collect()] == [True, False, False, True, False]
    one = spark.range(1)
    assert one.select(vx.vector_literal(F.array(F.lit(1.5), F.lit(-2.0)))).first()[0] == "[1.5,-2.0]"
    assert one.select(tx.normal_scope(F.lit(None).cast("map<string,string>"), ["level"])).first()[0] == {}
    assert one.select(ingest.excerpt(F.lit("a bb  ccc dddd"), 8)).first()[0] == "a bb..."
