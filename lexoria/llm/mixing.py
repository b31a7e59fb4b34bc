"""Mixing sources to target weights by Efraimidis-Spirakis sampling (DataFrame operations only).

Each document gets the key -ln(u) / quality with a hashed u; by ascending key this is a weighted
random order without replacement. A source's target is met by complete epochs and then by the
documents of smallest key whose sizes, summed as a prefix, come nearest to the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Rows that one key range of a source holds, on average, when sizes are prefix-summed.
RANGE_ROWS = 4_096
#: Classes of quality in the estimate of how a source's keys are spread.
CLASSES = 16
_JUNK = "#$%&*|<>{}[]\\^~"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def text_quality(text: Column) -> Column:
    """1 for plain prose, less with the share of markup characters, 0.1 at least."""
    n = F.length(text)
    clean = F.length(F.translate(text, _JUNK, ""))
    return F.when(n > 0, F.greatest(F.lit(0.1), 2.0 * clean / n - 1.0)).otherwise(F.lit(0.1))


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size).

    Targets are in proportion to the weights and sum to ``share`` of all sizes, but stop at
    ``most`` times a source's size; what is cut off is dealt again by weight until no target is
    above. That is the water level L with target = least(most * size, L * weight), found in one
    pass over the sources in the order of most * size / weight. One row per source, and all of them
    in one task: ten million sources are some 0.5 GB there.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    ranked = ranked.withColumn("cap", most * F.col("source_size")).withColumn("level", F.col("cap") / F.col("weight"))
    up = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    capped = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    total = share * F.sum("source_size").over(everything)
    ranked = ranked.withColumn("water", (total - capped) / left).withColumn("first", F.col("level") >= F.col("water") * (1 - 1e-12))
    at = F.min(F.when(F.col("first"), F.struct("level", "source", "water"))).over(everything)
    ranked = ranked.withColumn("water", at["water"])
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("water") * F.col("weight")))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def _ranges(narrow: DataFrame) -> DataFrame:
    """``narrow`` with range: the place of the row's key among its source's, in steps of about
    RANGE_ROWS rows, rising with the key.

    A key of quality q lies below k with the chance 1 - exp(-q k). The mean of that over the
    source's rows, by classes of quality, is how many keys lie below k; so a source of any mixture
    of qualities is cut into even ranges.
    """
    kind = F.ceil(F.least(F.col("quality"), F.lit(1.0)) * CLASSES)
    classes = narrow.groupBy("source", kind.alias("kind")).agg(F.count("*").alias("n"), F.avg("quality").alias("q"))
    sources = classes.groupBy(F.col("source").alias("source_")).agg(F.sum("n").alias("rows"), F.collect_list(F.struct("n", "q")).alias("classes"))  # at most CLASSES + 1 each
    sources = cut(sources.withColumn("ranges", F.ceil(F.col("rows") / RANGE_ROWS)))  # sums are added in one order only
    below = F.aggregate("classes", F.lit(0.0), lambda a, c: a + c["n"] * (1 - F.exp(-c["q"] * F.col("key"))))
    place = F.least(F.col("ranges") - 1, F.floor(below / F.col("rows") * F.col("ranges"))).cast("int")
    joined = narrow.join(sources, F.col("source").eqNullSafe(F.col("source_")))
    return joined.withColumn("range", place).drop("source_", "rows", "classes", "ranges")


def mix_sources(docs: DataFrame, quality: Column | None = None, seed: int = 0, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, whole: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every document, and the columns
    ``carry`` of its row (of other names than these, size, quality, u, key and range).

    taken: the words that the mix takes of the document, repeats counted; copies: how often it
    takes the document, the last time maybe in part. The document at which a source's budget ends
    gives only the words still missing; with ``whole`` it is taken whole if that is nearer, else
    not. Reruns agree: the key depends on seed, doc_id and the text's quality only; ties go to the
    smaller doc_id, then the smaller size.
    Nulls: a null text has size 0; a null source is a source of its own, last in order; a row
    with a null id is ordered by its text. Repeated rows are each taken into account; rows equal in
    id (or, without one, in text) have one key and are summed in one task. Empty tables give empty
    results.
    """
    size = word_count(F.col("text"))
    q = F.coalesce(quality if quality is not None else text_quality(F.col("text")), F.lit(0.1))
    uniform = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.xxhash64("text")), F.lit("")))), 1, 13), 16, 10).cast("double") + 0.5) / float(16**13)
    narrow = docs.select("doc_id", "source", size.alias("size"), q.alias("quality"), uniform.alias("u"), *carry)
    narrow = cut(narrow.withColumn("key", -F.log("u") / F.col("quality")))
    totals = cut(source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")).select("source", "source_size"), share, most, weights))

    keyed = _ranges(narrow)
    part = keyed.groupBy("source", "range").agg(F.sum("size").alias("words"))
    over = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("before", F.coalesce(F.sum("words").over(over), F.lit(0))).withColumnRenamed("source", "source_")
    part = part.join(totals, F.col("source_").eqNullSafe(F.col("source"))).select("source_", F.col("range").alias("range_"), "before", "source_size", "target")
    joined = keyed.join(part, F.col("source").eqNullSafe(F.col("source_")) & (F.col("range") == F.col("range_")))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    up_to = F.col("before") + F.sum("size").over(inside)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    out = joined.withColumn("up_to", up_to).withColumn("epochs", epochs)
    if whole:
        extra = F.when((2 * F.col("up_to") - F.col("size") <= 2 * rest) & (rest > 0), F.col("size")).otherwise(F.lit(0))
    else:
        extra = F.greatest(F.lit(0), F.least(F.col("size"), F.round(rest).cast("long") - (F.col("up_to") - F.col("size"))))
    out = out.withColumn("extra", extra.cast("long"))
    copies = F.col("epochs") + (F.col("extra") > 0).cast("int")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("epochs") * F.col("size") + F.col("extra")).cast("long").alias("taken"), *carry)
