"""Searches through stored indexes, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexoria.operators import postings, retrieval
from lexoria.operators.postings import PostingsIndex
from lexoria.operators.vector_index import VectorIndex
from lexoria.sources import corpus
from lexoria.sources.shared import fresh_folder

from .q_retrieval import ORACLES as RETRIEVAL
from .q_retrieval import THRESHOLD, base_sql, corpus_sql, expand_sql, fused_sql, shown, vector_sql

CARRIED = ("document_id", "chunk_index", "doc_type", "module")


def vector_index(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> VectorIndex:
    """An index of the whole corpus (or of the chunks ``of``), a third of which is first indexed by other vectors."""
    rows = (corpus.chunks(spark, sf_dir) if of is None else of).drop("content", "filename")
    index = VectorIndex(spark, fresh_folder(spark, "vectors"))
    changed = F.col("id") % 3 == 0
    index.build(rows.withColumn("embedding", F.when(changed, F.reverse("embedding")).otherwise(F.col("embedding"))))
    index.replace(rows.filter(changed))
    return index


def text_index(spark: SparkSession, sf_dir: str, config: str = "simple", changes: bool = False, of: DataFrame | None = None) -> PostingsIndex:
    """An index of the whole corpus (or of the chunks ``of``); with ``changes`` a third of it is first indexed by other texts."""
    rows = (corpus.chunks(spark, sf_dir) if of is None else of).select("id", "content", *CARRIED)
    index = PostingsIndex(spark, fresh_folder(spark, "postings"))
    if not changes:
        index.build(rows, config, CARRIED)
        return index
    changed = F.col("id") % 3 == 0
    index.build(rows.withColumn("content", F.when(changed, F.reverse("content")).otherwise(F.col("content"))), config, CARRIED)
    index.replace_documents(rows.filter(changed))
    return index


def _nearest(spark: SparkSession, sf_dir: str, exact: bool) -> DataFrame:
    found = vector_index(spark, sf_dir).search(corpus.questions(spark, sf_dir), 10, exact=exact)
    return found.select("query_id", "rank", "id", F.round("similarity", 6).alias("similarity"))


def knn_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, True)


def knn_probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, False)


def _lexical(spark: SparkSession, sf_dir: str, index: PostingsIndex) -> DataFrame:
    found = index.search(corpus.questions(spark, sf_dir), retrieval._filters())
    return found.select("query_id", "id", F.round("lexical_score", 6).alias("lexical_score"))


def cover_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir, text_index(spark, sf_dir))


def changed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir, text_index(spark, sf_dir, changes=True))


def portuguese(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stemmed lexemes without stop words; questions of stop words alone find nothing."""
    return _lexical(spark, sf_dir, text_index(spark, sf_dir, "portuguese"))


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = corpus.stored(corpus.chunks(spark, sf_dir), "chunks")
    return shown(retrieval.hybrid_match_indexed(vector_index(spark, sf_dir, chunks), text_index(spark, sf_dir, of=chunks), chunks, corpus.questions(spark, sf_dir), 8, THRESHOLD))


def covers_sql(base: str = "base") -> str:
    """CTEs up to ``covered`` (query_id, id, lexical_score): for each place where a term ends, the
    latest beginnings of all terms up to it by running maxima; a later beginning than before is a cover."""
    values = []
    for q, _, text, _, _ in corpus.QUESTIONS:
        terms: dict[tuple, int] = {}
        for g, group in enumerate(postings.parse(text, "simple")):
            for wanted, words in group:
                t = terms.setdefault(words, len(terms))
                values += [f"({q}, {g}, {t}, {str(wanted).upper()}, {j}, '{name}', {len(words)})" for j, name in words]
    return f"""asked(query_id, grp, term, wanted, place, lexeme, n) AS (VALUES {', '.join(values)}),
positive AS (SELECT DISTINCT query_id, term FROM asked WHERE wanted),
tok AS (SELECT id, unnest(w) AS lexeme, unnest(range(1, len(w) + 1)) AS pos FROM (SELECT id, regexp_extract_all(lower(nfc_normalize(content)), '[\\p{{L}}\\p{{N}}]+') AS w FROM chunks)),
hit AS MATERIALIZED (SELECT DISTINCT a.query_id, t.id, a.term, a.place, a.n, t.pos FROM tok t JOIN asked a USING (lexeme) JOIN {base} b ON b.query_id = a.query_id AND b.id = t.id),
occ AS MATERIALIZED (SELECT query_id, id, term, pos - place AS s, max(pos) AS e FROM hit GROUP BY query_id, id, term, pos - place, n HAVING count(*) = n),
has AS (SELECT DISTINCT query_id, id, term FROM occ),
ok AS (SELECT p.query_id, p.id, a.grp FROM (SELECT DISTINCT query_id, id FROM occ) p JOIN (SELECT DISTINCT query_id, grp, term, wanted FROM asked) a USING (query_id) LEFT JOIN has h ON h.query_id = p.query_id AND h.id = p.id AND h.term = a.term
  GROUP BY p.query_id, p.id, a.grp HAVING bool_and(CASE WHEN a.wanted THEN h.term IS NOT NULL ELSE h.term IS NULL END)),
need AS (SELECT DISTINCT ok.query_id, ok.id, ok.grp, a.term FROM ok JOIN asked a ON a.query_id = ok.query_id AND a.grp = ok.grp AND a.wanted),
ent AS MATERIALIZED (SELECT query_id, id, pos, row_number() OVER (PARTITION BY query_id, id ORDER BY pos) AS nth FROM (SELECT DISTINCT query_id, id, pos FROM hit JOIN positive USING (query_id, term))),
ev AS (SELECT DISTINCT query_id, id, e FROM occ JOIN positive USING (query_id, term)),
lat AS (SELECT v.query_id, v.id, v.e, n.grp, n.term, max(o.s) OVER (PARTITION BY v.query_id, v.id, n.grp, n.term ORDER BY v.e) AS s FROM ev v JOIN need n ON n.query_id = v.query_id AND n.id = v.id
  LEFT JOIN occ o ON o.query_id = v.query_id AND o.id = v.id AND o.term = n.term AND o.e = v.e),
beg AS (SELECT query_id, id, e, max(b) AS b FROM (SELECT query_id, id, e, grp, CASE WHEN count(s) = count(*) THEN min(s) END AS b FROM lat GROUP BY query_id, id, e, grp) GROUP BY query_id, id, e),
cov AS (SELECT query_id, id, e, b FROM beg WHERE b IS NOT NULL QUALIFY b > coalesce(max(b) OVER (PARTITION BY query_id, id ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)),
covered AS (SELECT c.query_id, c.id, round(sum(0.1::DOUBLE / (1 + (c.e - c.b) - (y.nth - x.nth))), 12) AS lexical_score FROM cov c JOIN ent x ON x.query_id = c.query_id AND x.id = c.id AND x.pos = c.b JOIN ent y ON y.query_id = c.query_id AND y.id = c.id AND y.pos = c.e GROUP BY c.query_id, c.id)"""


QUERIES = {
    "knn_indexed": knn_indexed,
    "knn_probed": knn_probed,
    "lexical_cover_density": cover_density,
    "lexical_index_changes": changed_index,
    "lexical_portuguese": portuguese,
    "hybrid_match_chunks_indexed": hybrid,
}

_COVERED = f"WITH {corpus_sql()}, {base_sql()}, {covers_sql()} SELECT query_id, id, round(lexical_score, 6) AS lexical_score FROM covered"

ORACLES = {
    "knn_indexed": RETRIEVAL["knn_cosine"],
    "lexical_cover_density": _COVERED,
    "lexical_index_changes": _COVERED,
    "hybrid_match_chunks_indexed": f"""WITH {corpus_sql()}, {base_sql()}, {vector_sql(THRESHOLD * 0.7, 80)}, {covers_sql()},
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC, id) AS r FROM covered QUALIFY r <= 80), {fused_sql(0.6, 0.4)},
seeds AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, coalesce(vs, -1) DESC, id) AS retrieval_rank FROM fused QUALIFY retrieval_rank <= 8), {expand_sql(8)}""",
}
