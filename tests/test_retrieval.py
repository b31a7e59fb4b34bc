"""Hybrid retrieval on a small hand-made corpus of unit vectors."""

from __future__ import annotations

import pytest

from lexoria.operators import lexical, orchestration, postrank, retrieval

from .conftest import DATA

CHUNKS = "id long, document_id long, chunk_index int, content string, doc_type string, filename string, module string, section_id long, section_index int, embedding array<float>"


@pytest.fixture()
def corpus(spark):
    x, y = [1.0, 0.0], [0.0, 1.0]
    return spark.createDataFrame(
        [
            (1, 1, 0, "alpha text about nothing", "md", "a.md", "m1", 10, 0, x),
            (2, 1, 1, "more plain text", "md", "a.md", "m1", 10, 0, y),
            (3, 2, 0, "the rare word zebra stands here", "md", "b.md", "m1", 20, 0, y),
            (4, 2, 1, "its neighbour", "md", "b.md", "", 21, 1, y),
        ],
        CHUNKS,
    )


def ask(spark, text="zebra", modules=(), vector=(1.0, 0.0)):
    rows = [(1, text, [], list(modules), [], list(vector) if vector else None)]
    return spark.createDataFrame(rows, "query_id int, query_text string, doc_types array<string>, modules array<string>, section_ids array<bigint>, query_embedding array<float>")


def rows(df):
    return df.orderBy("position").collect()


def test_lexical_only_seed_can_rank_first(spark, corpus):
    got = rows(retrieval.hybrid_match_chunks(corpus, ask(spark), 2, 0.5, (0.1, 0.9)))
    assert [r.id for r in got] == [3, 4, 1, 2]
    first, near = got[0], got[1]
    assert first.origin == "lexical" and first.fusion_score is not None and first.lexical_score > 0
    assert near.origin == "neighbor" and near.fusion_score is None and near.similarity == 0.0 and near.seed_chunk_id == 3


def test_blank_query_is_vector_only(spark, corpus):
    got = rows(retrieval.hybrid_match_chunks(corpus, ask(spark, "  "), 2, 0.5))
    assert [(r.id, r.origin) for r in got] == [(1, "vector"), (2, "neighbor")]


def test_foreign_module_leaves_rows_without_module(spark, corpus):
    assert [r.id for r in rows(retrieval.match_chunks(corpus, ask(spark, modules=["other"]), 4, -1.0))] == [4]
    assert rows(retrieval.match_chunks(corpus.filter("module <> ''"), ask(spark, modules=["other"]), 4, -1.0)) == []


def test_vector_search_expands(spark, corpus):
    got = rows(retrieval.match_chunks(corpus, ask(spark), 1, 0.5))
    assert [(r.id, r.is_neighbor, r.similarity) for r in got] == [(1, False, 1.0), (2, True, 0.0)]


def test_section_scope_reaches_neighbours(spark, corpus):
    sections = corpus.selectExpr("section_id as id", "document_id", "section_index").distinct()
    q = ask(spark).selectExpr("query_id", "query_text", "doc_types", "modules", "array(20L) as section_ids", "query_embedding")
    scope = retrieval.scope_of_sections(sections, q)
    assert {r.section_id for r in scope.collect()} == {20, 21}
    assert {r.id for r in rows(retrieval.match_chunks(corpus, q, 4, -1.0, scope=scope))} == {3, 4}


def test_sections_without_query_vector(spark, corpus):
    s = corpus.drop("section_id")
    got = retrieval.hybrid_match_sections(s, ask(spark, vector=None), 5, 0.5).collect()
    assert [(r.id, r.similarity, r.origin) for r in got] == [(3, 0.0, "lexical")]


def test_feedback_scopes_do_not_leak(spark):
    v = [1.0, 0.0]
    fb = spark.createDataFrame([(1, 1, "PUBLISHED", True, {"level": "conversation", "channel": "a"}, v), (2, 2, "PUBLISHED", True, {"level": "conversation", "channel": "b"}, v), (3, 3, "PUBLISHED", True, {}, v), (4, 4, "PENDING", True, {}, v), (5, 5, "PUBLISHED", False, {}, v)], "id long, item_id long, status string, active boolean, scope map<string,string>, embedding array<float>")
    q = lambda scope: spark.createDataFrame([(1, v, scope)], "query_id int, query_embedding array<float>, scope map<string,string>")
    ids = lambda scope, exact=False: [r.id for r in rows(retrieval.search_feedback(fb, q(scope), 6, 0.5, exact))]
    assert ids({"level": "conversation", "channel": "a"}) == [1] and ids({"level": "global"}) == [3]
    assert ids({"channel": "b", "level": "conversation"}, True) == [2] and ids({}, True) == [3] and ids({}) == [1, 2, 3]


def test_query_language():
    assert lexical.parse_query("") == [] and lexical.parse_query("-only") == []
    assert lexical.parse_query('a "b c" or -d e') == [[(True, "a"), (True, "b c")], [(False, "d"), (True, "e")]]


def test_greedy_caps_equal_a_walk(spark):
    import random

    rng = random.Random(4)
    data = [(1, p, rng.choice([None, 1, 2, 3, 4, 5]), 0) for p in range(1, 80)]
    data = [(q, p, s, 0 if s is None else s // 2) for q, p, s, _ in data]
    got = [r.position for r in postrank.limit_diversity(spark.createDataFrame(data, "query_id int, position int, section_id int, document_id int"), per_section=3, per_document=5, limit=14).orderBy("position").collect()]
    sec, doc, want = {}, {}, []
    for _, p, s, d in data:
        if (s is not None and sec.get(s, 0) >= 3) or doc.get(d, 0) >= 5 or len(want) >= 14:
            continue
        want.append(p)
        doc[d] = doc.get(d, 0) + 1
        if s is not None:
            sec[s] = sec.get(s, 0) + 1
    assert got == want


def test_interleave_two_to_one(spark):
    side = lambda n, m: spark.createDataFrame([(1, i, m) for i in range(1, n + 1)], "query_id int, position int, side string")
    for n, m in ((5, 2), (2, 4), (0, 3), (4, 0), (1, 1)):
        got = [r.side for r in postrank.interleave(side(n, "p"), side(m, "c")).orderBy("slot").collect()]
        p, c, want = ["p"] * n, ["c"] * m, []
        while p or c:
            want += p[:2] + c[:1]
            p, c = p[2:], c[1:]
        assert got == want


MEMORY = "id long, item_id long, status string, active boolean, scope map<string,string>, embedding array<float>"


def test_feedback_of_the_own_scope_comes_before_global_feedback(spark):
    v = [1.0, 0.0]
    talk = {"level": "conversation", "guild_id": "g", "channel_id": "c"}
    scopes = [{}, {"level": "tenant", "tenant": "a"}, {"level": "tenant", "tenant": "b"}, talk, {"level": "conversation", "guild_id": "g"}, {"level": "global"}]
    memory = spark.createDataFrame([(i, 10 * i, "PUBLISHED", True, s, v) for i, s in enumerate(scopes, 1)] + [(9, 90, "PUBLISHED", True, {}, [0.0, 1.0])], MEMORY)
    asked = [None, {"tenant": "a "}, {**talk, "other": "x"}, {"level": "global"}, {"tenant": " "}, {"level": "tenant", "tenant": "b", "platform": "x"}]
    got = orchestration.search_memory(memory, spark.createDataFrame([(i, v, s) for i, s in enumerate(asked)], "query_id int, query_embedding array<float>, scope map<string,string>"), 4, 0.5)
    found = {q: [] for q in range(6)}
    for r in got.orderBy("query_id", "position").collect():
        found[r.query_id].append((r.id, r.origin.removeprefix("feedback_")))
    everywhere = [(1, "global"), (6, "global")]
    assert found == {0: everywhere, 1: [(2, "scoped"), *everywhere], 2: [(4, "scoped"), *everywhere], 3: everywhere * 2, 4: everywhere, 5: [(3, "scoped"), *everywhere]}


def test_challengers_are_told_apart_from_the_preferred_rows_by_content(spark):
    """A copy of a preferred chunk takes no challenger's place between the preferred ones."""
    near = lambda i: [1.0, i / 20]
    some = [(i, "m1", f"a{i}", near(i + 4)) for i in (1, 2, 3, 4)] + [(11, "m2", "a1", near(1)), (12, "m2", "b2", near(2)), (13, "m2", "b2", near(3)), (14, "m2", "b4", near(4))]
    chunks = spark.createDataFrame([(i, i, 0, text, "md", f"{i}.md", m, i, 0, v) for i, m, text, v in some], CHUNKS)
    sections = spark.createDataFrame([(1, 1, 0, "s", "md", "1.md", "m1", [0.0, 1.0])], "id long, document_id long, section_index int, content string, doc_type string, filename string, module string, embedding array<float>")
    questions = ask(spark, modules=[" M1", " "])
    memory = spark.createDataFrame([(1, 7, "PUBLISHED", True, {}, [1.0, 0.0])], MEMORY)
    hit = orchestration.search_memory(memory, questions.selectExpr("query_id", "query_embedding", "cast(null as map<string,string>) AS scope")).selectExpr("*", "'a1' AS content")
    got = orchestration.retrieve(chunks, sections, questions, hit, 0.5).orderBy("slot").collect()
    assert [(r.id, r.routing_scope) for r in got] == [(1, None), (1, "filtered"), (2, "filtered"), (12, "global_challenger"), (3, "filtered"), (4, "filtered"), (14, "global_challenger")]
    assert (got[0].origin, got[0].filename, got[0].chunk_index) == ("feedback_global", "feedback_7.md", 0)


def test_every_question_gets_its_feedback_with_or_without_a_text(spark):
    from lexoria.plans import q_more, q_retrieval
    from lexoria.sources import corpus

    got = [r for r in q_more.full_retrieval(spark, DATA).orderBy("query_id", "slot").collect() if r.origin.startswith("feedback")]
    asked = corpus.questions(spark, DATA).selectExpr("query_id", "query_embedding", "map('level', 'global') AS scope")
    search = lambda q: {(r.query_id, r.id) for r in retrieval.search_feedback(q_retrieval._feedback(spark, DATA), q, 6, -1.0).collect()}
    want = search(asked)
    assert len(want) == 36 and {(r.query_id, r.id) for r in got if r.origin == "feedback_global"} == want
    scoped = {(r.query_id, r.id) for r in got if r.origin == "feedback_scoped"}
    assert {q for q, _ in scoped} == {1, 3} and {x for x in scoped if x[0] == 1} == {x for x in search(q_retrieval._scopes(spark, DATA)) if x[0] == 1}
    documents = {r.doc_id for r in corpus.table(spark, DATA, "documents").select("doc_id").collect()}
    assert any(r.id not in documents for r in got)
