"""What each retired document has become: chains and forks of successors followed to their ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexoria.sources.shared import checkpoints


def resolve_successors(links: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, final, status), one row for each end that a linked document leads to.

    links: (id, successor), any number for an id; documents: (id, batch_id). Ends are documents without
    successors. Status: ``resolved``; ``cross_batch``, where a link on the way leads into another batch;
    ``dangling``, where the end is no document, or a document on the way is none; ``cycle`` (final is
    null), where some way never ends. An id may have several rows. Links with nulls are ignored,
    repeated ones count once.

    Pointer jumping: each round doubles the length of all ways, so that a chain of a million links
    takes twenty joins. A way that has not ended when all without a cycle must have is in one. Pairs
    grow with forks: at most one for each id and each document that it leads to.
    """
    spark = links.sparkSession
    checkpoints(spark)
    batch = documents.filter("id IS NOT NULL").groupBy("id").agg(F.min("batch_id").alias("batch"))
    edges = links.filter("id IS NOT NULL AND successor IS NOT NULL").select("id", "successor").distinct()
    known = edges.join(batch, "id", "left").withColumnRenamed("batch", "here").join(batch.select(F.col("id").alias("successor"), F.col("batch").alias("there"), F.lit(True).alias("is_document")), "successor", "left")
    own = documents.select("id", F.lit(True).alias("id_is_document")).filter("id IS NOT NULL").distinct()
    known = known.join(own, "id", "left")
    missing = F.col("is_document").isNull() | F.col("id_is_document").isNull()
    steps = known.select("id", "successor", F.coalesce(~F.col("here").eqNullSafe(F.col("there")) & ~missing, F.lit(False)).alias("crossed"), missing.alias("missing"))
    sources = steps.select(F.col("id").alias("source")).distinct()
    ways = steps.join(sources, F.col("successor") == F.col("source"), "left").select("id", "successor", "crossed", "missing", F.col("source").isNull().alias("ended")).checkpoint()
    most, length = ways.select("id").distinct().count(), 1
    while length <= most and not ways.filter("NOT ended").isEmpty():
        going = ways.filter("NOT ended").select("id", F.col("successor").alias("at"), "crossed", "missing")
        ahead = ways.select(F.col("id").alias("at"), "successor", F.col("crossed").alias("c"), F.col("missing").alias("m"), "ended")
        longer = going.join(ahead, "at").select("id", "successor", (F.col("crossed") | F.col("c")).alias("crossed"), (F.col("missing") | F.col("m")).alias("missing"), "ended")
        ways = ways.filter("ended").unionByName(longer).groupBy("id", "successor", "ended").agg(F.bool_or("crossed").alias("crossed"), F.bool_or("missing").alias("missing")).checkpoint()
        length *= 2
    status = F.when(~F.col("ended"), "cycle").when(F.col("missing"), "dangling").when(F.col("crossed"), "cross_batch").otherwise("resolved")
    return ways.select("id", F.when(F.col("ended"), F.col("successor")).alias("final"), status.alias("status")).distinct()
