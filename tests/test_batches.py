from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from lexoria.functions import batches
from lexoria.operators import ingest, markdown
from lexoria.sources import files, segments


def test_parts_hold_few_bytes_and_every_row():
    texts = ["a" * 10, None, "b" * 25, "", "c" * 3, "d" * 9]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["doc_id", "text"])
    cut = list(batches.parts(batch, "text", 12))
    assert [len(p) for p in cut] == [2, 1, 3] and [t for p in cut for t in p.column("text").to_pylist()] == texts
    assert list(batches.parts(batch.slice(0, 0), "text", 12)) == []


def test_texts_are_parsed_a_part_at_a_time(spark):
    """A worker that holds a whole Arrow batch as objects would see all texts in one call."""
    seen = []

    @batches.by_parts("text")
    def run(part):
        seen.append(len(part))
        yield part

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["x" * batches.PART_BYTES] * 3)], names=["doc_id", "text"])
    assert sum(len(b) for b in run(iter([batch]))) == 3 and seen == [1, 1, 1]


def test_sections_and_chunks_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, "# A\nx\n## B {#b}\ny"), (2, None), (3, ""), (4, "w " * 1000)], "doc_id int, text string")
    got = [tuple(r) for r in markdown.sections(docs).filter("doc_id < 4").orderBy("section_index").collect()]
    assert got == [(1, 0, 1, "A", None, "A", 1, "# A\nx"), (1, 1, 2, "B", "b", "A > B", 3, "## B {#b}\ny")]
    rows = ingest.chunk_rows(docs).orderBy("doc_id", "chunk_index").collect()
    assert {r.doc_id: r.n_chunks for r in rows} == {1: 1, 4: 2} and len(rows) == 3 and rows[0].retrieval_text == rows[0].content
    named = ingest.chunk_rows(docs, F.concat(F.lit("doc "), F.col("doc_id"))).filter("doc_id = 1").first()
    assert named.retrieval_text == "doc 1\n\n" + named.content


def test_index_rows_are_made_once(spark, tmp_path):
    """Ranges of the sort columns are sampled, which made every row twice."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    rows = spark.range(500).selectExpr("id", "id % 3 AS bucket", "cast(id % 7 AS string) AS lexeme").mapInArrow(run, "id long, bucket long, lexeme string")
    index = segments.Segments(spark, str(tmp_path / "index"))
    index.begin({}, rows, "bucket", ["lexeme", "id"])
    assert made.value == 500 and index.live(index.state()[1]).distinct().count() == 500


def test_text_files_need_no_python_worker_for_their_bytes(spark, tmp_path):
    """Valid text is decoded in the JVM, the rest by the readers as before."""
    contents = {"a.txt": "é\x00 b\n".encode(), "b.md": b"bad \xff byte", "c.md": b"---\nx: \xff", "d.docx": b"no zip", "e.bin": b"x", "f.txt": b"\xef\xbb\xbfx"}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    read = files.read_documents(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: (r.text, (r.error or "").split(":")[0]) for r in read.collect()}
    assert got == {"a.txt": ("é\x00 b\n", ""), "b.md": ("bad  byte", ""), "c.md": (None, "UnicodeDecodeError"), "d.docx": (None, "BadZipFile"), "f.txt": ("﻿x", "")}
    assert "MapInPandas" not in read._jdf.queryExecution().executedPlan().toString()
