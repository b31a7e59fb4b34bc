from __future__ import annotations

from pyspark.sql import functions as F

from lexoria.operators import retrieval
from lexoria.plans import registry
from lexoria.sources import corpus

from .conftest import DATA


def test_vector_literals_round_in_the_vectors_own_precision(spark, tmp_path):
    # 0.105 as a float times 100 is 10.5 in single precision and 10.4999... in double precision.
    rows = spark.createDataFrame([(1, [0.105, -0.105, 0.104, 0.0])], "vec_id long, embedding array<float>")
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    assert registry.QUERIES["vector_literal"](spark, str(tmp_path)).first().literal == "[11,-11,10,0]"


def test_scopes_of_sections_are_broadcast_and_stored_corpora_are_scanned(spark):
    """Without it every question's texts and vectors are shuffled to meet the scope, and the corpus is
    joined anew in each of the searches."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = corpus.stored(corpus.chunks(spark, DATA), "chunks")
        assert sorted(map(str, stored.collect())) == sorted(map(str, corpus.chunks(spark, DATA).collect()))
        asked = corpus.questions(spark, DATA).withColumn("section_ids", F.array(F.lit(0).cast("long")))
        asked = spark.createDataFrame(asked.collect(), asked.schema)
        scope = retrieval.scope_of_sections(corpus.sections(spark, DATA, stored), asked)
        rows = retrieval.base_rows(stored, asked, scope)
        assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString()
        assert {r.section_id for r in rows.select("section_id").distinct().collect()} <= {0, 1}
        found = registry.QUERIES["search_with_fallback"](spark, DATA)
        assert found.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
