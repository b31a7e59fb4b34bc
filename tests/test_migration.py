"""Evidence of texts against plain Python, and reports of units that are sound, lost or tampered with."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from lexoria.functions import text as tx
from lexoria.operators import migration as mg

from .conftest import DATA

TEXTS = [
    "", "plain", "A\n```\nx\n```\nB", "```py\nopen", "~~~~\na\n~~~\nb\n~~~~ \nc", "```\n\n```\n```\ny\n\n```", "  - one\n* two\n+ three\n3) four\n   5. five\n    - no\n-no", "| a | b\\|c |\n|---|---|\n|x|\na|b\n", "[t](u) ![i](p q) [a](b)![c](d) https://x.y/z) !https://no a:https://q",
    "ABC AB A_1 ABCd ÉABC x--opt --opt-x `na.me` `A B` `ABC`", "Não se deve\nnever WHEN\nsemente\nexceto isso\n```não```\nif\n", "a\r\nb\r\n- c\r\n```\r\nd\r\n```", "  ", "# T {#k}\n\nx  ",
]


def plain(text):
    """(kind, item) of a text, line by line."""
    norm = lambda s: " ".join(s.lower().split())
    lines, out = text.splitlines(), []
    fence, body = None, []
    for line in text.replace("\r\n", "\n").split("\n"):
        if fence:
            if re.fullmatch(rf"[ \t]{{0,3}}{re.escape(fence[0])}{{{len(fence)},}}[ \t]*", line):
                out.append(("code", "\n".join(body)))
                fence, body = None, []
            else:
                body.append(line)
        elif m := re.match(r"^[ \t]{0,3}(`{3,}|~{3,})(.*)$", line):
            fence = m[1]
    if fence:
        out.append(("code", "\n".join(body)))
    out += [("identifier", m[1] or m[0]) for m in re.finditer(r"\b[A-Z][A-Z0-9_]{2,}\b|(?<!\w)--[a-z][a-z0-9-]*|`([A-Za-z_][A-Za-z0-9_.]*)`", text)]
    out += [("link", m[1] or m[0]) for m in re.finditer(r"(?<!!)\[[^]]+\]\(([^)]+)\)|(?<![!\w])https?://[^\s>)]+", text)]
    out += [("image", m) for m in re.findall(r"!\[[^]]*\]\(([^)]+)\)", text)]
    out += [("list", norm(m[1])) for x in lines if (m := re.match(r"^[ \t]{0,3}(?:[-+*]|\d+[.)])[ \t]+(.+)$", x))]
    for x in lines:
        if "|" in x and not re.fullmatch(r"\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*", x):
            cells = re.split(r"(?<!\\)\|", x.strip().strip("|"))
            if len(cells) > 1:
                out.append(("table_cell", " | ".join(norm(c.replace(r"\|", "|")) for c in cells)))
    for kind, ws in (("negation", "não|nunca|jamais|sem|proibido|proibida|not|never|without"), ("condition", "se|quando|caso|somente se|apenas se|if|when|unless"), ("exception", "exceto|exceção|salvo|ressalva|except|exception")):
        out += [(kind, norm(x)) for x in lines if re.search(rf"\b(?:{ws})\b", x, re.I) and not re.match(r"^[ \t]{0,3}(`{3,}|~{3,})", x)]
    return out


def test_evidence_equals_plain_python(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").select("i", *[v.alias(k) for k, v in mg.evidence(F.col("t")).items()]).collect()
    for r in rows:
        got = Counter((k, x) for k in r.asDict() if k != "i" for x in r[k])
        assert got == Counter(plain(TEXTS[r.i])), TEXTS[r.i]


def test_losses_are_multiset_differences(spark):
    pairs = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in TEXTS for b in TEXTS[::3])] + [(900, None, None), (901, "- a\n- a\n- b", "- b\n- a")]
    got = {}
    for r in mg.evidence_losses(spark.createDataFrame(pairs, "unit_id int, source string, target string")).filter("category <> 'text'").collect():
        got[r.unit_id, r.category, r.detail] = r.lost
    want = {(i, *k): n for i, a, b in pairs for k, n in (Counter(plain(a or "")) - Counter(plain(b or ""))).items()}
    assert got == want and got[901, "list", "a"] == 1


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_reports_tell_sound_lost_and_tampered_units(spark):
    text, less, day = "keep ABC\nline two\n", "keep abc\nline two\n", "2026-01-01T00:00:00+00:00"
    ok, to = ("s", sha(text), "legacy", None, 1, 2), lambda path, t: (path, sha(t), "c", 1, 2)
    good, no = ("reviewed", "me", day), None
    cases = {
        "sound": (ok, to("t", text), no, good), "lost": (ok, to("l", less), no, good), "open": (ok, to("t", text), no, ("open", "me", day)), "nowhere": (ok, no, no, good), "out": (ok, no, ("excluded", "old", "me", day), good),
        "why": (ok, no, ("excluded", " ", "me", day), good), "both": (ok, to("t", text), ("excluded", "old", "me", day), good), "merged": (ok, to("t", text), ("merged", "one", "me", day), good), "hash": (("s", "bad", "legacy", None, 1, 2), to("t", text), no, good),
        "range": (("s", sha(text), "legacy", None, 1, 3), to("t", text), no, good), "gone": (("none", sha(text), "legacy", None, 1, 2), to("t", text), no, good), "moved": (ok, to("none", text), no, good), "other": (ok, to("t", less), no, good), "rev": (("s", sha(text), "canonical", 2, 1, 2), to("t", text), no, good),
        "undated": (ok, to("t", text), no, ("reviewed", "me", "2026-01-01")),
    }
    source, dest = "struct<path:string,sha256:string,format:string,revision:int,start_line:int,end_line:int>", "struct<path:string,sha256:string,canonical_id:string,start_line:int,end_line:int>"
    units = spark.createDataFrame([("b", k, *v) for k, v in cases.items()], f"batch_id string, unit_id string, source {source}, destination {dest}, disposition struct<kind:string,reason:string,reviewer:string,reviewed_at:string>, review struct<status:string,reviewer:string,reviewed_at:string>")
    inventory = spark.createDataFrame([("b", k) for k in [*cases, "absent"]], "batch_id string, unit_id string")
    batches = spark.createDataFrame([("b", "c" * 40)], "batch_id string, commit string")
    originals = spark.createDataFrame([("s", text, 1)], "path string, text string, revision int")
    targets = spark.createDataFrame([("t", text, "c", True), ("l", less, "c", True)], "path string, text string, canonical_id string, reviewed boolean")
    stated = mg.snapshot_hash(batches, inventory, units).first().snapshot
    assert mg.snapshot_hash(batches, inventory, units.repartition(5)).first().snapshot == stated
    run = lambda u, h: mg.unit_results(batches.withColumn("snapshot", F.lit(h)), inventory, u, originals, targets)
    results, losses = run(units, stated)
    got = {r.unit_id: (r.status, r.detail) for r in results.collect()}
    assert got == {
        "sound": ("passed", None), "lost": ("failed", "losses"), "open": ("incomplete", "review"), "nowhere": ("incomplete", "no_destination"), "out": ("passed", None), "why": ("failed", "disposition_review"), "both": ("failed", "excluded_with_destination"), "merged": ("passed", None),
        "hash": ("failed", "source_hash"), "range": ("failed", "source_range"), "gone": ("incomplete", "source_missing"), "moved": ("failed", "target_missing"), "other": ("failed", "target_hash"), "rev": ("failed", "source_revision"), "absent": ("incomplete", "no_unit"), "undated": ("incomplete", "review"),
    }
    assert {(r.category, r.detail, r.lost) for r in losses.collect()} == {("identifier", "ABC", 1), ("text", "keep ABC", 1), ("text", "line two", 1)}
    assert mg.batch_report(results).first().status == "failed"
    changed = units.withColumn("source", F.when(F.col("unit_id") == "sound", F.col("source").withField("end_line", F.lit(1))).otherwise(F.col("source")))
    assert {r.detail for r in run(changed, stated)[0].collect()} == {"snapshot"}
    one = units.filter("unit_id = 'sound'")
    alone = inventory.filter("unit_id = 'sound'")
    whole = mg.unit_results(batches.withColumn("snapshot", F.lit(mg.snapshot_hash(batches, alone, one).first().snapshot)), alone, one, originals, targets)[0]
    assert mg.batch_report(whole).first().asDict() == {"batch_id": "b", "status": "passed", "total": 1, "mapped": 1, "failed": 0, "incomplete": 0, "lost": 0, "review_status": "reviewed"}


def test_shared_lines_make_no_evidence(spark):
    """Losses of an edit amid shared lines equal those of all evidence of both sides."""
    head = "\n".join(f"- item {i} ABC_{i}\nif a{i} | b\n[x\ny](u/{i})" for i in range(3))
    pairs = [(1, f"{head}\nnot here\n{head}", f"{head}\n{head}"), (2, head, head), (3, f"{head}\n```\nA\n```\n{head}", f"{head}\n```\nB\n```\n{head[3:]}"), (4, "", head), (5, head, "")]
    units = spark.createDataFrame(pairs, "unit_id int, source string, target string")
    got = Counter({(r.unit_id, r.category, r.detail): r.lost for r in mg.evidence_losses(units).filter("category <> 'text'").collect()})
    kinds = lambda c: F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in mg.evidence(F.col(c)).items()])
    expected = Counter()
    for r in units.select("unit_id", kinds("source").alias("s"), kinds("target").alias("t")).collect():
        for a, b in zip(r.s, r.t, strict=True):
            expected.update({(r.unit_id, a.k, x): n for x, n in (Counter(a.v) - Counter(b.v)).items()})
    assert got == expected
    arrays = spark.createDataFrame([(["a", "b"], ["a", "c", "b"]), (["a"], ["a"]), ([], ["a"]), (["a"], ["a", "b"])], "a array<string>, b array<string>")
    assert [r[0] for r in arrays.select(mg._shared(F.col("a"), F.col("b"))).collect()] == [1, 1, 0, 1]


def test_moved_and_repeated_lines_are_netted(spark):
    """Lines that both sides have as often, wherever they stand, make no evidence; the others make all of it."""
    pairs = [
        (1, "- a\nnot b\n- a\nABC if c", "ABC if c\n- a\nnot b"), (2, "x | Y\nx | y\n`n.m`", "`n.m` x\nx | y"), (3, "# A\r\n- b\r\r\n- c\n", "- c\r- b\n# A"), (4, "never DEF", "DEF\nnever"), (5, "not a\u0085not b", "not b\u0085not a"),
        (6, "plain\n[a\nb](u)\n!\n[c](d)", "plain\n[a\nb](v)\n!\n[c](d)"), (7, "plain\n~~~\nx\ny\n~~~\n[k](l)", "plain\n~~~\nx\nz\n~~~\n[k](m)"), (8, "plain!\n[a](b)\nhttp://q", "plain!\n![a](b)\nxhttp://q"), (9, "p\n```\na\rb\n```", "p\n```\na\nb\n```"), (10, "p\nhttps://a", "p\nhttps://a\nb"),
    ]
    got = Counter({(r.unit_id, r.category, r.detail): r.lost for r in mg.evidence_losses(spark.createDataFrame(pairs, "unit_id int, source string, target string")).filter("category <> 'text'").collect()})
    kinds = lambda text: Counter((k, x) for k, items in spark.createDataFrame([(text,)], "t string").select(*[v.alias(k) for k, v in mg.evidence(F.col("t")).items()]).first().asDict().items() for x in items)
    assert got == Counter({(i, *k): n for i, a, b in pairs for k, n in (kinds(a) - kinds(b)).items()})
    assert got[1, "list", "a"] == 1 and (1, "negation", "not b") not in got and got[4, "negation", "never def"] == 1


def test_line_ends_are_those_of_the_pattern(spark):
    texts = ["", "a", "\n", "a\r", "a\r\r\nb\n\r\n", "\r\n\r", "\u0085x y\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.lines(F.col("t")).alias("a"), F.split("t", r"\r\n|\r|\n").alias("b")).collect()
    assert all(r.a == r.b for r in rows)


def test_a_report_takes_the_texts_once(spark):
    """The units' results come from one pass over both texts: neither is joined a second time for the losses."""
    source, dest = "struct<path:string,sha256:string,format:string,revision:int,start_line:int,end_line:int>", "struct<path:string,sha256:string,canonical_id:string,start_line:int,end_line:int>"
    text = "keep ABC\n"
    units = spark.createDataFrame([("b", "u", ("s", sha(text), "legacy", None, 1, 1), ("t", sha(text), "c", 1, 1), None, ("open", "me", "x"))], f"batch_id string, unit_id string, source {source}, destination {dest}, disposition struct<kind:string,reason:string,reviewer:string,reviewed_at:string>, review struct<status:string,reviewer:string,reviewed_at:string>")
    batches = spark.createDataFrame([("b", "c" * 40, "h")], "batch_id string, commit string, snapshot string")
    results, _ = mg.unit_results(batches, units.select("batch_id", "unit_id"), units, spark.createDataFrame([("s", text, 1)], "path string, text string, revision int"), spark.createDataFrame([("t", text, "c", True)], "path string, text string, canonical_id string, reviewed boolean"))
    plan = results._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join LeftOuter" in x and "path" in x]
    assert len(joins) == 2, plan


def test_a_batch_report_takes_the_texts_once(spark):
    """The batches' query has the plan of the units' report below it: both texts joined once."""
    from lexoria.plans import q_migration

    plan = q_migration.batches(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert len([x for x in plan.splitlines() if "Join LeftOuter" in x and "path" in x]) == 2, plan
