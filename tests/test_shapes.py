"""Classification by rules and editors, successors against walking, JSON shapes against plain Python."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from lexoria.functions.text import json_fragment
from lexoria.operators import shapes, taxonomy
from lexoria.operators.successors import resolve_successors


def test_rules_have_a_stable_precedence(spark):
    cases = [
        ("Conta Corrente", "Tabela XPARAMETRO", "financeiro_pagamentos", "configuracao", "configuration"), ("Pedido com erro", "SELECT * FROM T", "sql_integracao", "sql_integracao", "troubleshooting"),
        ("Fluxo de integração", "Enviar dados", "sql_integracao", "sql_integracao", "procedure"), ("Permissão de usuário", "Habilitar acesso", "geral", "configuracao", "configuration"),
        ("Consulta SQL de parâmetros", "SELECT 1", "sql_integracao", "sql_integracao", "sql_lookup"), ("Parâmetros da integração", "Tabela X", "sql_integracao", "configuracao", "configuration"),
        ("05-PEDIDOS-E-VENDAS", "", "geral", "pedidos_vendas", "unknown"), ("06-CAMPANHAS-E-DESCONTOS", None, "geral", "pedidos_vendas", "unknown"), (None, None, None, "unknown", "unknown"),
        ("Conta Corrente", "x " * 300 + "XPARAMETRO", "geral", "financeiro", "unknown"),
    ]
    rows = spark.createDataFrame([(i, *c[:3], "general") for i, c in enumerate(cases)], "id int, title string, content string, legacy_module string, legacy_mode string")
    got = {r.id: r for r in taxonomy.heuristic(rows, "xparametro").collect()}
    assert [(got[i].primary_module, got[i].answer_mode) for i in range(len(cases))] == [c[3:] for c in cases]
    assert got[0].secondary_modules == ["financeiro"] and got[0].signals == ["parameter_configuration", "configuration"]
    assert (got[2].legacy_module_out, got[2].legacy_mode_out) == ("sql_integracao", "process") and got[8].legacy_module_out == "geral"


def test_sections_inherit_what_editors_say(spark):
    words = "struct<taxonomy_version:string,primary_module:string,secondary_modules:array<string>,answer_mode:string,products:array<string>>"
    own = "struct<primary_module:string,secondary_modules:array<string>,answer_mode:string,products:array<string>>"
    said = ("taxonomy_v1", "pedidos_vendas", [], "procedure", ["a"])
    rows = [
        (1, 0, "Pedido", "text", "geral", said, None), (1, 1, "Erro", "text", "geral", said, ("configuracao", ["financeiro"], "configuration", None)), (1, 2, "x", "t", "geral", said, (None, None, None, ["zz"])),
        (1, 3, "x", "t", "geral", said, ("outro", None, None, None)), (2, 0, "Rotas", "nada", "geral", None, None), (3, 0, "x", "t", "geral", ("taxonomy_v0", *said[1:]), None),
    ]
    df = spark.createDataFrame(rows, f"doc_id int, section_index int, heading_path string, content string, base_module string, taxonomy {words}, override {own}")
    got = {(r.doc_id, r.section_index): r for r in taxonomy.classify_sections(df, [], [("logistica", "rotas_visitas_consultas")], ["a"]).collect()}
    assert (got[1, 0].module, got[1, 0].mode, got[1, 0].reason) == ("pedidos_vendas", "process", "editorial_inheritance")
    assert (got[1, 1].module, got[1, 1].mode, got[1, 1].signals, got[1, 1].secondary_modules) == ("parametros_configuracao", "configuration", ["primary_module", "secondary_modules", "answer_mode"], ["financeiro"])
    assert [got[k].problem for k in ((1, 0), (1, 2), (1, 3), (2, 0), (3, 0))] == [None, "product", "module", None, "version"]
    assert got[2, 0].primary_module == "logistica" and got[2, 0].reason == "heuristic"


def walked(links, documents):
    """(id, final, status) by following every way."""
    after, batch = {}, {}
    for a, b in {(a, b) for a, b in links if a is not None and b is not None}:
        after.setdefault(a, []).append(b)
    for i, b in documents:
        batch.setdefault(i, []).append(b)
    batch = {i: min(b) for i, b in batch.items()}
    out = {}

    def go(start, at, crossed, missing, seen):
        for b in after[at]:
            gone = at not in batch or b not in batch
            c, m = crossed or (not gone and batch[at] != batch[b]), missing or gone
            if b not in after:
                key = out.setdefault((start, b), [False, False])
                key[0] |= c
                key[1] |= m
            elif b in seen:
                out[start, None] = None
            else:
                go(start, b, c, m, seen | {b})

    for a in after:
        go(a, a, False, False, {a})
    return sorted((a, -(10**9) if f is None else f, "cycle" if v is None else "dangling" if v[1] else "cross_batch" if v[0] else "resolved") for (a, f), v in out.items())


def test_successors_equal_walking(spark):
    rng = random.Random(5)
    for n, forks in ((40, 1), (14, 2)):
        documents = [(i, i // 10) for i in range(n)]
        links = [(i, rng.randrange(-2, n)) for i in range(n) for _ in range(forks) if rng.random() < 0.7] + [(None, 1), (1, None), (0, 0), (0, 0), (n + 5, 1)]
        got = resolve_successors(spark.createDataFrame(links, "id long, successor long"), spark.createDataFrame(documents, "id long, batch_id int")).collect()
        assert sorted((r.id, -(10**9) if r.final is None else r.final, r.status) for r in got) == walked(links, documents)
    chain = [(i, i + 1) for i in range(70)]
    got = resolve_successors(spark.createDataFrame(chain, "id long, successor long"), spark.createDataFrame([(i, 0) for i in range(71)], "id long, batch_id int")).collect()
    assert {(r.final, r.status) for r in got} == {(70, "resolved")} and len(got) == 70
    assert resolve_successors(spark.createDataFrame([], "id long, successor long"), spark.createDataFrame([], "id long, batch_id int")).count() == 0


EVIDENCE = [
    None, "", "x", "{}", '"s"', "[]", '["a", " ", " b ", 5, null, true, ["c"]]', '[{"source": "s", "contains": "t"}]', '[{"contains": ["t", null, "", 5, " u "]}]', '[{"contains": 7}]', '[{"source": 5}, {"source": null}]',
    '[{"canonical_id": "d", "document_revision": 3}]', '[{"canonical_id": "d", "revision": 2}]', '[{"canonical_id": "d", "document_revision": null, "revision": 2}]', '[{"canonical_id": "d", "revision": 0}]',
    '[{"canonical_id": "d", "revision": "3"}]', '[{"canonical_id": "d", "revision": true}]', '[{"canonical_id": "d", "revision": 2.0}]', '[{"revision": 2}]', '[{"section_key": "k", "source": "s"}]', '[{"source_id": "k"}]',
    '[{"canonical_id": "d", "locator": {"a":1}}]', '[{"canonical_id": "d", "locator": null}]', '[{"canonical_id": "d", "locator": []}]', '[{"locator": {"a":1}, "source": "s"}]', "[1, 2", '[{"canonical_id": "ok"}, {"revision": -1}, "z"]',
]


def specs(text):
    """Rows (position, source, contains, canonical_id, revision, section_key, source_id, locator, problem)."""
    try:
        items = json.loads(text or "")
    except ValueError:
        return []
    out = []
    for p, i in enumerate(items if isinstance(items, list) else []):
        if isinstance(i, str) and i.strip():
            out.append((p, i.strip(), [], "", None, "", "", None, None))
        if not isinstance(i, dict):
            continue
        text_of = lambda k: "" if not i.get(k) else (i[k].strip() if isinstance(i[k], str) else json.dumps(i[k]))  # noqa: B023, E731
        raw = i.get("contains")
        terms = [raw] if isinstance(raw, str) else raw if isinstance(raw, list) else []
        terms = [t for t in ((x.strip() if isinstance(x, str) else json.dumps(x)) for x in terms if x is not None) if t]
        source, cid, key, sid, loc = text_of("source"), text_of("canonical_id"), text_of("section_key"), text_of("source_id"), i.get("locator")
        rev = i.get("document_revision", i.get("revision"))
        rev = int(rev) if isinstance(rev, float) and rev.is_integer() else rev  # a variant does not tell 2.0 from 2
        bad = rev is not None and (type(rev) is not int or rev < 1)
        lost = loc is not None and not isinstance(loc, dict)
        problem = "document_revision" if bad else "locator" if lost else "canonical_id" if (rev is not None or key or sid or loc is not None) and not cid else None
        if problem or source or terms or cid:
            out.append((p, source, terms, cid, None if bad else rev, key, sid, json.dumps(loc, separators=(",", ":")) if isinstance(loc, dict) else None, problem))
    return out


def test_evidence_of_all_shapes(spark):
    df = spark.createDataFrame(list(enumerate(EVIDENCE)), "case_id int, reference_evidence string")
    got = {}
    for r in shapes.evidence_specs(df).orderBy("case_id", "position").collect():
        got.setdefault(r.case_id, []).append((r.position, r.source, r.contains, r.canonical_id, r.document_revision, r.section_key, r.source_id, r.locator, r.problem))
    want = {i: rows for i, t in enumerate(EVIDENCE) if (rows := specs(t))}
    assert got == want


def test_contexts_of_all_shapes_and_fragments(spark):
    replies = [
        ('["a", " ", null, "b"]', {0: "a", 3: "b"}), ('[{"id": 2, "context": " x "}, {"chunk_id": "1", "text": "y"}, {"texto": "z"}]', {2: "z", 1: "y"}), ('{"contexts": ["p", "q"]}', {0: "p", 1: "q"}),
        ('{"0": "m", "9": "far", "x": "no", " 1 ": {"summary": "s"}}', {0: "m", 1: "s"}), ('```json\nHere: ["k"]\n```', {0: "k"}), ("none", {}), (None, {}), ("", {}), ('[{"context":"","id":0}, "plain", 5]', {0: '{"context":"","id":0}', 1: "plain", 2: "5"}),
        ('[{"id": 0, "value": "first"}, {"id": 0, "value": "last"}, {"id": -1, "value": "out"}]', {0: "last"}), ("[]", {}), ("7", {}), ('{"a": [1]}', {0: "1"}),
    ]
    df = spark.createDataFrame([(i, r, 4) for i, (r, _) in enumerate(replies)], "doc_id int, reply string, expected int")
    got = {}
    for r in shapes.contextual_payload(df).collect():
        got.setdefault(r.id, {})[r.idx] = r.context
    assert got == {i: w for i, (_, w) in enumerate(replies) if w}
    texts = {' {"a": [1]} ': "[1]", "x {1} y": "{1}", "] [": "] [", "plain": "plain", "```JSON\n{}\n```": "{}", "": ""}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", json_fragment(F.col("t")).alias("f")).collect()
    assert {r.t: r.f for r in rows} == texts
