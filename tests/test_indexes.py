"""The stored indexes: lexemes against a fixed table, covers against plain search, recall, the parts of
an index that a search reads, changes, and writers that meet."""

from __future__ import annotations

import itertools
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexoria.functions.portuguese import STOP_WORDS, lexeme, stem, words
from lexoria.operators import publishing
from lexoria.operators.postings import PostingsIndex, parse
from lexoria.operators.vector_index import VectorIndex
from lexoria.sources.shared import CommitLog, Taken, create_once

# Pairs of word and stem of the published vocabulary.
STEMS = """boa boa boainain boainain boas boas boataria boat boate boat boates boat boatos boat bob bob boba bob bobagem bobag
bobagens bobagens bobalhões bobalhõ bobear bob bobeira bobeir bobinho bobinh bobinhos bobinh bobo bob bobs bobs boca boc bocadas
boc bocadinho bocadinh bocado boc boçal boçal bocarra bocarr bocas boc bode bod bodoque bodoqu body body boeing boeing boem boem
boemia boem boêmio boêmi bogotá bogot boi boi bóia bói boiando boi quiabo quiab quicaram quic quickly quickly quieto quiet
quietos quiet quilate quilat quilates quilat quilinhos quilinh quilo quil quilombo quilomb quilométricas quilométr quilométricos
quilométr quilômetro quilômetr quilômetros quilômetr quilos quil química químic químicas químic químico químic quimioterapia
quimioterap quimioterápicos quimioteráp quimono quimon quincas quinc quinhão quinhã"""


def test_stems_words_and_stop_words():
    pairs = STEMS.split()
    assert [stem(w) for w in pairs[::2]] == pairs[1::2]
    assert words("Ação, AÇÃO água x_y 2,5 Ω") == ["ação", "ação", "água", "x", "y", "2", "5", "ω"] and words(None) == []
    assert {"de", "não", "estivéssemos", "houverão", "tivermos", "seríamos"} <= STOP_WORDS
    assert lexeme("de", "portuguese") is None and lexeme("de", "simple") == "de" and lexeme("pedidos", "portuguese") == lexeme("pedido", "portuguese") != "pedidos"


def test_questions_are_parsed():
    assert parse('a "b c" -d or e', "simple") == [[(True, ((0, "a"),)), (True, ((0, "b"), (1, "c"))), (False, ((0, "d"),))], [(True, ((0, "e"),))]]
    assert parse('"pedido de venda" de', "portuguese") == [[(True, ((0, "ped"), (2, "vend")))]]
    assert parse(None) == parse("-a") == parse("de or o") == []


def covers(tokens: list[str], groups) -> float | None:
    """All stretches tried, shortest first from each beginning; those that hold another are no covers."""
    at = lambda term: [i for i in range(len(tokens)) if all(i + j < len(tokens) and tokens[i + j] == w for j, w in term)]
    ok = [[t for wanted, t in g if wanted] for g in groups if all(bool(at(t)) == wanted for wanted, t in g)]
    if not ok:
        return None
    inside = lambda a, b: any(all(any(a <= i and i + t[-1][0] <= b for i in at(t)) for t in g) for g in ok)
    found = [(a, b) for a in range(len(tokens)) for b in range(a, len(tokens)) if inside(a, b)]
    shortest = [(a, b) for a, b in found if not any((c, d) != (a, b) and a <= c and d <= b for c, d in found)]
    asked = {w for g in groups for wanted, t in g if wanted for _, w in t}
    return sum(0.1 / (1 + (b - a) - (sum(tokens[i] in asked for i in range(a, b + 1)) - 1)) for a, b in shortest)


def asked(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query_text string")


QUESTIONS = ["a", "a b", '"a b"', '"a b" c', "a or b c", "a -d", '"a a"', 'a "b a" or d', "-a", "", 'c "a b c" a', "e or f", '"a b" or "b a"', "a or -b c"]


def test_ranks_equal_trying_all_stretches(spark, tmp_path):
    rng = random.Random(4)
    texts = [" ".join(rng.choices("abcdxyz", k=rng.randint(0, 14))) for _ in range(60)] + [None, "", "A b, C", "a", "a a a"]
    index = PostingsIndex(spark, str(tmp_path / "p"))
    index.build(spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)], "id long, content string, odd int"), "simple", ("odd",), 8)
    want = {}
    for q, question in enumerate(QUESTIONS):
        groups = parse(question, "simple")
        for i, t in enumerate(texts):
            value = covers(words(t), groups) if groups else None
            if value is not None:
                want[q, i] = value
    got = {(r.query_id, r.id): r.lexical_score for r in index.search(asked(spark, QUESTIONS)).collect()}
    assert got == pytest.approx(want) and len(want) > 100
    odd = index.search(asked(spark, QUESTIONS), F.col("odd") == 1, most=2).collect()
    assert {r.id % 2 for r in odd} == {1} and max(r.lexical_rank for r in odd) == 2


def test_stemmed_search_and_gaps_of_stop_words(spark, tmp_path):
    index = PostingsIndex(spark, str(tmp_path / "p"))
    index.build(spark.createDataFrame([(1, "Relatórios das vendas"), (2, "relatório venda"), (3, "vendas com relatório de venda")], "id long, content string"))
    got = {(r.query_id, r.id): r.lexical_score for r in index.search(asked(spark, ["venda relatório", '"relatório de vendas"', "de"])).collect()}
    assert got == pytest.approx({(0, 1): 0.05, (0, 2): 0.1, (0, 3): 0.1, (1, 1): 0.05, (1, 3): 0.05})


def scanned(df) -> dict[str, int]:
    """Folders and files that the scan of ``rows`` has read."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    out = {"numPartitions": 0, "numFiles": 0}
    for i in range(leaves.size()):
        metrics = leaves.apply(i).metrics()
        if metrics.contains("numPartitions"):
            for name in out:
                out[name] += metrics.apply(name).value()
    return out


@pytest.fixture
def plain_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_changes_are_segments_and_searches_read_asked_buckets_only(spark, tmp_path, plain_plans):
    index = PostingsIndex(spark, str(tmp_path / "p"))
    kind = "id long, content string"
    index.build(spark.createDataFrame([(i, f"common w{i}") for i in range(200)], kind), "simple", (), 32)
    read = scanned(index.search(asked(spark, ["w7"])))
    assert read["numPartitions"] == 1
    before = index.segments.paths(index.segments.state()[1])
    index.replace_documents(spark.createDataFrame([(7, "other text"), (900, "w7")], kind), spark.createDataFrame([(8,), (None,), (12345,)], "id long"))
    find = lambda q: sorted(r.id for r in index.search(asked(spark, [q])).collect())
    assert find("w7") == [900] and find("w8") == [] and find("text") == [7] and len(find("common")) == 198
    assert index.segments.paths(index.segments.state()[1])[:1] == before  # the old segment is not rewritten
    index.compact()
    assert find("w7") == [900] and len(find("common")) == 198 and len(index.segments.paths(index.segments.state()[1])) == 1


VECTORS = "id long, embedding array<float>, doc_type string, module string"


def vectors(n=4000, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(60, dim))
    x = (centres[rng.integers(0, 60, n)] + 0.35 * rng.normal(size=(n, dim))).astype(np.float32)
    return [(i, [float(c) for c in v], ["pdf", "md", None][i % 3], [None, "", "m1", "m2"][i % 4]) for i, v in enumerate(x)]


def test_nearest_vectors_exact_and_probed(spark, tmp_path, plain_plans):
    rows = vectors()
    rows += [(5000, rows[5][1], "md", "m1"), (5001, None, "md", ""), (5002, [], "md", ""), (5003, [0.0] * 16, "md", ""), (5004, [float("nan")] * 16, "md", "")]
    index = VectorIndex(spark, str(tmp_path / "v"))
    index.build(spark.createDataFrame(rows, VECTORS).repartition(3))
    ask = [(q, rows[q * 37][1], [["md"], []][q % 2], [[], ["m1"]][q % 3 == 0]) for q in range(12)]
    questions = spark.createDataFrame(ask, "query_id int, query_embedding array<float>, doc_types array<string>, modules array<string>")
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    want = {}
    for q, v, kinds, modules in ask:
        ok = [(i, unit(v) @ unit(x)) for i, x, d, m in rows[:4001] if (not kinds or d in kinds) and (not modules or (m or "") in [*modules, ""])]
        want[q] = [i for i, _ in sorted(ok, key=lambda p: (-round(p[1], 12), p[0]))[:10]]
    ids = lambda df: {q: [r.id for r in sorted(g, key=lambda r: r["rank"])] for q, g in itertools.groupby(sorted(df.collect(), key=lambda r: r.query_id), key=lambda r: r.query_id)}
    assert ids(index.search(questions, 10, exact=True)) == want
    probed = index.search(questions, 10, probes=4)
    got = ids(probed)
    assert np.mean([len({*got.get(q, [])} & {*want[q]}) / 10 for q in want]) >= 0.9
    one = index.search(questions.filter("query_id = 0"), 10, probes=4)
    assert scanned(one)["numPartitions"] <= 4 < round(len(rows) ** 0.5)
    assert scanned(index.search(questions.filter("query_id = 0"), 1, exact=True))["numPartitions"] < 60
    index.replace(spark.createDataFrame([(9000, rows[0][1], "md", ""), (37, rows[0][1], "md", "")], VECTORS), spark.createDataFrame([(0,)], "id long"))
    first = [r.id for r in index.search(questions.filter("query_id = 0"), 2, exact=True).orderBy("rank").collect()]
    assert first == [37, 9000]
    index.compact()
    assert [r.id for r in index.search(questions.filter("query_id = 0"), 2).orderBy("rank").collect()] == first
    assert index.search(questions.limit(0), 2, exact=True).count() == 0


def test_of_two_writers_one_wins(spark, tmp_path):
    path, won, lost = str(tmp_path / "log"), [], []
    log = CommitLog(spark, path)
    gate = threading.Barrier(4)

    def write(i):
        gate.wait()
        try:
            won.append(log.commit(0, {"writer": i}))
        except Taken:
            lost.append(i)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert won == [1] and len(lost) == 3 and log.newest()[1]["writer"] not in lost
    create_once(spark, f"{path}/000000002.json", '{"half')  # a writer that died
    assert log.newest() == (2, log.entries()[0][1]) and log.commit(2, {"writer": 9}) == 3
    p, q = (publishing.Publication(spark, str(tmp_path / "corpus")) for _ in range(2))
    rows = spark.createDataFrame([(1, "a")], "document_id long, text string")
    number, state = p._newest()
    q.apply(rows, "q")
    with pytest.raises(Taken):
        p.pointers.commit(number, state | {"version": "stale"})
    assert p.state()["history"][0]["plan"] == "q"
