"""Directory ingestion, evaluation runs and the cache: what a stop, a retry and a full cache leave."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexoria.operators import runner
from lexoria.operators.publishing import Publication
from lexoria.sources.shared import Taken
from lexoria.streaming import directory
from lexoria.streaming.directory import DirectoryIngest, ingest_directory


def test_each_file_is_read_once_and_failures_are_retried_alone(spark, tmp_path, monkeypatch):
    folder, state = tmp_path / "in", str(tmp_path / "state")
    (folder / "sub").mkdir(parents=True)
    for name, data in {"a.txt": b"one", "sub/b.md": b"---\xff", "c.docx": b"no zip", "d.bin": b"skipped", "e.txt": b""}.items():
        (folder / name).write_bytes(data)
    make = lambda: DirectoryIngest(spark, str(folder), state)
    assert make().failures().count() == 0 and make().documents().count() == 0
    make().run(files_per_batch=2)
    make().run()  # nothing new
    names = lambda df: {r.path.split("/in/")[1] for r in df.collect()}
    assert names(make().documents()) == {"a.txt"} and names(make().failures()) == {"sub/b.md", "c.docx"} and make().attempts().count() == 3
    (folder / "sub/b.md").write_bytes(b"--- now fine")
    (folder / "c.docx").unlink()
    (folder / "f.txt").write_bytes(b"late")
    monkeypatch.setattr(directory, "RETRY_FILES", 1)
    publication = Publication(spark, str(tmp_path / "published"))
    first = ingest_directory(make(), publication, "p1")
    assert names(publication.read()) == {"a.txt", "sub/b.md", "f.txt"} and names(make().failures()) == {"c.docx"}
    assert make().attempts().filter("attempt = 1").count() == 1 and make().attempts().filter("path LIKE '%a.txt'").count() == 1
    assert ingest_directory(make(), publication, "p1") == first


def test_a_batch_that_runs_twice_has_no_doubles(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(6):
        (folder / f"{i}.txt").write_text(f"text {i}")
    ingest, parse, calls = DirectoryIngest(spark, str(folder), str(tmp_path / "state")), directory.parse_files, []

    def stops(batch):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("the driver is gone")
        return parse(batch)

    monkeypatch.setattr(directory, "parse_files", stops)
    with pytest.raises(Exception, match="the driver is gone"):
        ingest.run(files_per_batch=2)
    assert ingest.documents().count() == 2
    ingest.run(files_per_batch=2)
    assert sorted(r.text for r in ingest.documents().collect()) == [f"text {i}" for i in range(6)] and ingest.attempts().count() == 6


def test_a_stopped_run_resumes_to_the_same_results(spark, tmp_path):
    cases = spark.range(200).withColumnRenamed("id", "case_id")
    step = lambda c: c.withColumn("score", F.col("case_id") * 2)
    run = runner.EvaluationRun(cases, str(tmp_path / "run"), rounds=5)
    assert run.results() is None and run.pending().count() == 200
    some = run.advance(step, 2)
    n = some.count()
    assert 0 < n < 200 and run.pending().count() == 200 - n

    def breaks(c):
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        run.advance(breaks)
    asked = []
    again = runner.EvaluationRun(cases, str(tmp_path / "run"), rounds=5)
    done = again.advance(lambda c: (asked.append(c.count()), step(c))[1])
    assert sum(asked) == 200 - n and sorted(map(tuple, done.collect())) == [(i, 2 * i) for i in range(200)]
    assert again.advance(breaks).count() == 200  # nothing is left to do
    with pytest.raises(Taken):
        again.log.commit(0, {"round": 0, "rows": "x"})


def test_the_cache_forgets_by_age_and_by_last_use(spark):
    rng, start, ttl, capacity = random.Random(3), datetime(2026, 1, 1), 300.0, 5
    held = spark.createDataFrame([], "key long, embedding array<double>, created_at timestamp, used_at timestamp").cache()
    plain: dict = {}
    for i in range(6):
        now = start + timedelta(seconds=100 * i)
        keys = [rng.randrange(9) for _ in range(4)] + [None]
        asked = spark.createDataFrame([(k,) for k in keys], "key long")
        plain = {k: v for k, v in plain.items() if (now - v[1]).total_seconds() < ttl}
        found = {r.key: r.embedding for r in runner.cached(held, asked, F.lit(now), ttl).collect()}
        assert found == {k: plain[k][0] if k in plain else None for k in set(keys) - {None}}
        new = [(k, [float(k), float(i)]) for k, v in found.items() if v is None]
        plain = {k: (v[0], v[1], now if k in keys else v[2]) for k, v in plain.items()} | {k: (v, now, now) for k, v in new}
        plain = dict(sorted(plain.items(), key=lambda e: (-e[1][2].timestamp(), e[0]))[:capacity])
        made = spark.createDataFrame(new, "key long, embedding array<double>")
        rows = runner.cache_after(held, asked, made, F.lit(now), ttl, capacity).collect()
        held = spark.createDataFrame(rows, held.schema)
        assert len(rows) <= capacity and {r.key: (r.embedding, r.created_at, r.used_at) for r in rows} == plain
    assert runner.cache_after(held, held, held.limit(0), F.lit(start), ttl, 0).count() == 0
