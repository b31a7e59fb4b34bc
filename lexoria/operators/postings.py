"""A stored positional index of texts, searched by a web-style query language and ranked by cover
density.

The index is a folder of segments. A segment holds one row for each lexeme and text, with the places
of the lexeme in it and the columns that searches filter by; rows lie in buckets of the lexeme's hash
(folders, so that a search reads only the buckets it asks for) and are sorted by lexeme within files
(so that row groups are skipped). A change of some texts adds a segment with their new rows and the
ids they replace; nothing else is rewritten until ``compact``. A commit log names the live segments.

A cover is a shortest stretch of a text that satisfies the query. Each counts 0.1 / (1 + other words
inside), and a text's rank is the sum over its covers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexoria.functions.batches import by_parts
from lexoria.functions.portuguese import lexeme, words
from lexoria.sources.segments import Segments, bucket

#: Weight of one cover of words without weights of their own.
COVER = 0.1
#: Lexemes in the questions of one batch at most; they are broadcast.
MOST_WORDS = 65_536


# --- lexemes of texts


def _lexemes(config: str, fields: list[str]):
    """Rows (*fields, content) as (*fields, lexeme, positions)."""

    @by_parts("content")
    def run(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        owner, names, places = [], [], []
        for i, text in enumerate(part.column("content").to_pylist()):
            at: dict[str, list[int]] = {}
            for p, word in enumerate(words(text), 1):
                name = lexeme(word, config)
                if name is not None:
                    at.setdefault(name, []).append(p)
            owner += [i] * len(at)
            names += at
            places += at.values()
            if len(owner) >= 50_000 or i + 1 == len(part):
                kept = [part.column(f).take(pa.array(owner, pa.int32())) for f in fields]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(places, pa.list_(pa.int32()))], names=[*fields, "lexeme", "positions"])
                owner, names, places = [], [], []

    return run


def postings(texts: DataFrame, config: str = "portuguese", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, *carry, lexeme, positions) of texts (id, content, *carry). Places count from 1 and stop
    words count too; a null or empty text has no rows."""
    fields = ["id", *carry]
    schema = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in fields)
    return texts.select(*fields, F.col("content").cast("string").alias("content")).mapInArrow(_lexemes(config, fields), f"{schema}, lexeme string, positions array<int>")


# --- queries


def parse(text: str | None, config: str = "portuguese") -> list[list[tuple[bool, tuple[tuple[int, str], ...]]]]:
    """Alternatives of terms (wanted, ((offset, lexeme), ...)): terms are joined by AND, ``or``
    separates alternatives, quotes ask for words in a row (a stop word leaves its gap), a leading
    minus excludes. Terms of stop words alone are left out, and so are alternatives that ask for
    nothing."""
    groups: list[list] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', text or ""):
        if not minus and not phrase and word.lower() == "or":
            groups.append([])
            continue
        named = [(j, lexeme(w, config)) for j, w in enumerate(words(phrase or word))]
        known = [(j, name) for j, name in named if name is not None]
        if known:
            groups[-1].append((not minus, tuple((j - known[0][0], name) for j, name in known)))
    return [g for g in groups if any(wanted for wanted, _ in g)]


def _asked(questions: DataFrame, config: str) -> list[tuple]:
    """(query_id, groups, most, term, offset, lexeme, wanted) for each word of each term. A group is
    (wanted terms, unwanted terms) by number."""
    rows = questions.select("query_id", "query_text").limit(MOST_WORDS + 1).collect()
    out = []
    for r in rows:
        terms: dict[tuple, int] = {}
        groups = []
        for group in parse(r.query_text, config):
            numbers = [(wanted, terms.setdefault(words_, len(terms))) for wanted, words_ in group]
            groups.append(([t for w, t in numbers if w], [t for w, t in numbers if not w]))
        positive = {t for wanted, _ in groups for t in wanted}
        for words_, t in terms.items():
            out += [(r.query_id, groups, len(terms), t, len(words_), j, name, t in positive) for j, name in words_]
    if len(rows) > MOST_WORDS or len(out) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words in a batch of questions")
    return out


_ASKED = "query_id int, groups array<struct<wanted:array<int>,unwanted:array<int>>>, n_terms int, term int, length int, offset int, lexeme string, positive boolean"


# --- matching and ranking, one row a question and text


def _starts(words_: Column) -> Column:
    """Where a term's words lie in a row: the places of each, shifted to the term's first word, met."""
    shifted = lambda w: F.transform(w["positions"], lambda p: p - w["offset"])
    rest = F.slice(words_, 2, F.greatest(F.size(words_) - 1, F.lit(0)))
    met = F.aggregate(rest, shifted(words_[0]), lambda a, w: F.array_intersect(a, shifted(w)))
    return F.when(F.size(words_) == words_[0]["length"], met).otherwise(F.array().cast("array<int>"))


def cover_density(groups: Column, events: Column, n_terms: Column) -> Column:
    """The sum over all covers. events: (place, term, start, gaps), ascending; the term is -1 where a word of
    the question lies at the place, else that a term of that start ends there. groups: arrays of terms,
    of which one has to be met as a whole.

    One walk keeps for each term where its last occurrence begins, and which of the question's words
    that is, counted along the text. Leaving a place, the latest beginning of a stretch that ends there
    is known; a later one than ever before is a new cover. ``gaps`` counts the places inside a term that
    none of its words takes (stop words)."""
    none = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("nth"))
    state = F.struct(F.lit(0).alias("place"), F.lit(0).alias("nth"), F.array_repeat(none, n_terms).alias("last"), F.lit(0).alias("begun"), F.lit(0.0).alias("total"))

    def closed(s: Column) -> tuple[Column, Column]:
        begin = F.array_max(F.transform(groups, lambda g: F.array_min(F.transform(g, lambda t: F.get(s["last"], t)))))
        new = F.coalesce((begin["start"] > s["begun"]) & (s["place"] > 0), F.lit(False))
        noise = (s["place"] - begin["start"]) - (s["nth"] - begin["nth"])
        return F.when(new, begin["start"]).otherwise(s["begun"]), F.when(new, s["total"] + F.lit(COVER) / (1 + noise)).otherwise(s["total"])

    def step(s: Column, e: Column) -> Column:
        moved = e["place"] > s["place"]
        begun, total = closed(s)
        nth = F.when(moved, s["nth"] + 1).otherwise(s["nth"])
        now = F.struct(e["start"].alias("start"), (nth - (e["place"] - e["start"]) + e["gaps"]).alias("nth"))
        last = F.when(e["term"] < 0, s["last"]).otherwise(F.transform(s["last"], lambda x, i: F.when(i == e["term"], now).otherwise(x)))
        return F.struct(e["place"].alias("place"), nth.alias("nth"), last.alias("last"), F.when(moved, begun).otherwise(s["begun"]).alias("begun"), F.when(moved, total).otherwise(s["total"]).alias("total"))

    return F.aggregate(events, state, step, lambda s: closed(s)[1])


def ranked(hits: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, id, *carry, rank) of the texts that satisfy their question. hits: one row for each
    text and word of a question that it holds."""
    word = F.struct("offset", "positions", "length")
    # One shuffle, by question and text: the second grouping finds its rows together.
    terms = hits.repartition("query_id", "id").groupBy("query_id", "id", "term").agg(F.sort_array(F.collect_list(word)).alias("words"), F.first("groups").alias("groups"), F.first("n_terms").alias("n_terms"), F.first("positive").alias("positive"), *[F.first(c).alias(c) for c in carry])
    met = terms.withColumn("starts", F.explode(F.array(_starts(F.col("words")))))
    # A term's own events; the words of wanted terms count as words of the question wherever they lie.
    length = F.element_at("words", -1)["offset"]
    ends = F.transform("starts", lambda s: F.struct((s + length).alias("place"), F.col("term").alias("term"), s.alias("start"), (length + 1 - F.size("words")).alias("gaps")))
    single = F.flatten(F.transform("words", lambda w: F.transform(w["positions"], lambda p: F.struct(p.alias("place"), F.lit(-1).alias("term"), p.alias("start"), F.lit(0).alias("gaps")))))
    found = met.select("query_id", "id", *carry, "term", "groups", "n_terms", (F.size("starts") > 0).alias("has"), F.when(F.col("positive"), F.concat(ends, single)).otherwise(F.slice(ends, 1, 0)).alias("events"))
    one = found.groupBy("query_id", "id").agg(F.first("groups").alias("groups"), F.first("n_terms").alias("n_terms"), F.collect_list(F.when(F.col("has"), F.col("term"))).alias("terms"), F.flatten(F.collect_list("events")).alias("events"), *[F.first(c).alias(c) for c in carry])
    holds = lambda t: F.array_contains("terms", t)
    met_groups = F.filter("groups", lambda g: F.forall(g["wanted"], holds) & ~F.exists(g["unwanted"], holds))
    matched = one.withColumn("_met", F.explode(F.array(F.transform(met_groups, lambda g: g["wanted"])))).filter(F.size("_met") > 0)
    rank = cover_density(F.col("_met"), F.array_distinct(F.sort_array("events")), F.col("n_terms"))
    return matched.select("query_id", "id", *carry, F.round(rank, 12).alias("rank"))  # covers add up in any order


# --- the stored index


class PostingsIndex:
    """A positional index in a folder that all executors share: ``build`` starts it,
    ``replace_documents`` changes some texts, ``search`` asks it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.segments = spark, Segments(spark, folder)

    def build(self, texts: DataFrame, config: str = "portuguese", carry: tuple[str, ...] = (), buckets: int = 64) -> None:
        """Index all of ``texts`` (id, content, *carry), in place of what the folder holds."""
        state = {"config": config, "carry": list(carry), "buckets": buckets}
        self.segments.begin(state, self._rows(texts, state), "bucket", ["lexeme", "id"])

    def replace_documents(self, texts: DataFrame | None, ids: DataFrame | None = None) -> None:
        """Index ``texts`` in place of what their ids had; ``ids`` (id) go without replacement. Only
        the rows of these are written."""
        _, state = self.segments.state()
        gone = [d.select("id") for d in (texts, ids) if d is not None]
        if gone:
            self.segments.change(None if texts is None else self._rows(texts, state), gone[0] if len(gone) == 1 else gone[0].unionByName(gone[1]))

    def compact(self) -> None:
        self.segments.compact()

    @staticmethod
    def _rows(texts: DataFrame, state: dict) -> DataFrame:
        return postings(texts, state["config"], tuple(state["carry"])).withColumn("bucket", bucket(F.col("lexeme"), state["buckets"]))

    def search(self, questions: DataFrame, where: Column | None = None, most: int | None = None) -> DataFrame:
        """(query_id, id, *carry, lexical_score) of the texts that satisfy each question (query_id,
        query_text), at most ``most`` each, best first. ``where`` is a condition on carried columns and
        columns of the questions."""
        _, state = self.segments.state()
        carry = tuple(state["carry"])
        asked = _asked(questions, state["config"])
        words_ = self.spark.createDataFrame(asked, _ASKED)
        names = sorted({a[6] for a in asked})
        buckets = [r[0] for r in self.spark.createDataFrame([(n,) for n in names], "lexeme string").select(bucket(F.col("lexeme"), state["buckets"])).distinct().collect()] if names else []
        rows = self.segments.live(state, F.col("bucket").isin(sorted(buckets)) & F.col("lexeme").isin(names))
        hits = rows.join(F.broadcast(words_), "lexeme")
        if where is not None:
            more = [c for c in questions.columns if c not in ("query_id", "query_text")]
            hits = hits.join(F.broadcast(questions.select("query_id", *more)), "query_id").filter(where).drop(*more)
        found = ranked(hits, carry).withColumnRenamed("rank", "lexical_score")
        return found if most is None else best(found, most)


def best(found: DataFrame, most: int) -> DataFrame:
    from .retrieval import top

    return top(found, "lexical_rank", [F.col("lexical_score").desc(), F.col("id")], most)


__all__ = ["PostingsIndex", "best", "cover_density", "parse", "postings", "ranked"]
