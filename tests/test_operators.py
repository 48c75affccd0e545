"""Maps, recounts, calls, corrections, copies and audits on small tables, and an extraction from end to end."""

import json
import re

from pyspark.sql import functions as F

from siltstone import extraction
from siltstone.functions.json_values import canonical
from siltstone.operators import budgets, copies, corrections, evals, execution, hints, intervals, recounts, route_map, routing, verdicts
from siltstone.plans.units import decompose, units_table
from siltstone.sources.runner import ScriptedRunner, judged

SCHEMA = {
    "type": "object",
    "properties": {
        "basic": {"type": "object", "properties": {"name": {"type": "string"}}},
        "jobs": {"type": "array", "items": {"type": "object", "properties": {"company": {"type": "string"}, "roles": {"type": "array", "items": {"type": "object", "properties": {"title": {"type": "string"}}}}}}},
        "notes": {"type": "array", "items": {"type": "object", "properties": {"company": {"type": "string"}}}},
        "created": {"type": "string"},
    },
}
# Codes: a basic, b jobs, c jobs.roles, d notes, e $misc.


def lines_of(spark, texts):
    return route_map.lines_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def rules(spark, text, size):
    units = units_table(spark, decompose(SCHEMA))
    found = route_map.errors(lines_of(spark, [text]), units, spark.createDataFrame([(0, size)], "doc_id long, size long"))
    return {r.rule for r in found.collect()}


def test_spellings_of_destinations(spark):
    units = units_table(spark, decompose(SCHEMA))
    text = "0-1 a\n2 b.0,d.0\n3-5 b.1-b.2\n6 b.0.c.0-c.1\n7 b.1.roles.0\n8 b.2.0\n9 d\n10 -\n11 b.1,-\n12 q.1\n13 a.0\n14 b.0.x.1\n2 d.1"
    rows = route_map.destinations(lines_of(spark, [text]), units).collect()
    good = {(r.start, r.end, r.code, r.item_lo, r.item_hi, r.parent_code, r.parent, r.ranged) for r in rows if r.error is None}
    assert good >= {(0, 1, "a", None, None, None, None, False), (2, 2, "b", 0, 0, None, None, False), (2, 2, "d", 0, 0, None, None, False), (2, 2, "d", 1, 1, None, None, False), (3, 5, "b", 1, 2, None, None, True), (6, 6, "c", 0, 1, "b", 0, False), (7, 7, "c", 0, 0, "b", 1, False), (8, 8, "c", 0, 0, "b", 2, False), (9, 9, "d", 0, 0, None, None, False), (10, 10, "-", None, None, None, None, False)}
    assert {r.start for r in rows if r.error} == {11, 12, 13, 14}


def test_declarations(spark):
    units = units_table(spark, decompose(SCHEMA))
    text = "0 a\nb: 2 @50%,300\nb.0.c: 3\nb.1.roles.4: 1\nb.1.c.2: 1\nd = b\na: 1\nb: 5"
    got = {(r.code, r.parent, r.n, r.source, (r.budget or "").strip()) for r in route_map.declarations(lines_of(spark, [text]), units).collect()}
    assert got == {("b", None, 5, None, ""), ("c", 0, 3, None, ""), ("c", 1, 5, None, ""), ("d", None, None, "b", ""), ("a", None, 1, None, "")}


def test_rules_of_maps(spark):
    assert rules(spark, "0 a\n1-3 b.0\n2 b.0.c.0\n4 b.1,d.0\n5 e\nb: 2\nb.0.c: 1\nd: 1", 6) == set()
    assert rules(spark, "0 a\n0-1 b.0\nb: 1", 2) == {"overlap"}
    assert rules(spark, "0 a\n2 b.0\nb: 1", 4) == {"not covered"}
    assert rules(spark, "0 b.0\n1 b.2\nb: 2", 2) == {"items differ from the count"}
    assert rules(spark, "0 b.0\n1 -", 2) == {"not declared"}
    assert rules(spark, "b: 1\n0 b.0", 1) == {"declared before the map"}
    assert rules(spark, "0 b.0.c.0\nb.0.c: 1", 1) == {"parent without a line"}
    assert rules(spark, "0 b.0\n1 d.0\nb: 1\nd = b", 2) == {"mirrors and is mapped"}
    assert rules(spark, "0 -\nd = b", 1) == {"source is not mapped"}
    assert rules(spark, "0 -\na: 1", 1) == {"declared and not mapped"}
    assert rules(spark, "0 b.0-2\n1 b.2-3\nb: 4", 2) == {"in two ranges"}
    assert rules(spark, "0-5 a\nhello there", 2) == {"beyond the text", "unread"}


def test_rendering_round_trip(spark):
    units = units_table(spark, decompose(SCHEMA))
    text = "0 a\n1-3 b.0\n2 b.0.c.0\n4 b.1,d.0\n5-6 -\nb: 2 @50%\nb.0.c: 1\nd: 1"
    found = lines_of(spark, [text])
    shown = route_map.rendered(route_map.destinations(found, units), route_map.declarations(found, units)).first().text
    assert shown == "0 a\n1-3 b.0\n2 b.0.c.0\n4 b.1,d.0\n5-6 -\nb: 2 @50%\nb.0.c: 1\nd: 1"


def test_diffs(spark):
    base = lines_of(spark, ["0 a\n1 b.0\nb: 1", "0 a"])
    replies = spark.createDataFrame([(0, "- 1 b.0\n+ 1 b.0,d.0\n+ d: 1\n- 9 x\n+ 9 x\n2 -"), (1, "0 -")], "doc_id long, text string")
    changes = route_map.edits(replies)
    assert {r.doc_id for r in changes.collect()} == {0}
    net = route_map.net_edits(changes)
    got = [r.line for r in route_map.applied(base.where("doc_id = 0"), net).orderBy("line_no").collect()]
    assert got == ["0 a", "1 b.0,d.0", "2 -", "b: 1", "d: 1"]


def test_quotes_and_anchors(spark):
    quotes = spark.createDataFrame([(0, 0, '1. "Alpha   beta"'), (0, 1, "alpha"), (0, 2, "Alpha beta"), (1, 0, "none")], "doc_id long, quote_no int, quote string")
    chunks = spark.createDataFrame([(0, 0, "x Alpha\nbeta y"), (0, 1, "an alpha"), (0, 2, "Alpha beta again"), (1, 0, "text")], "doc_id long, chunk_id int, text string")
    assert [(r.quote_no, r.chunk_id) for r in recounts.anchors(quotes, chunks).orderBy("quote_no").collect()] == [(0, 0), (1, 1), (2, 2)]
    form = spark.range(1).select(recounts.beginnings(F.lit("one two three four")).alias("b"), recounts.beginnings(F.lit("甲 乙丙")).alias("c")).first()
    assert form.b == ["one two three four", "one two three"] and form.c == ["甲 乙丙"]


def test_verdicts(spark):
    docs = spark.createDataFrame([(n, "Alpha  beta\ngamma delta") for n in range(6)], "doc_id long, text string")
    listed = docs.select("doc_id", F.array(F.lit("zeta eta"), F.lit("gamma delta")).alias("openings"))
    texts = ["missing:\n- Alpha beta\n- Alpha beta\nextra:\nzeta", "missing:\nAlpha", "missing:\nnothing like it\nextra:", "missing:\nextra:\n1. gamma", "Missing:\nExtra:", "missing:\nextra:\nunknown"]
    found = verdicts.verdicts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), docs, listed)
    assert {r.doc_id: (r.missing, r.extra) for r in found.collect()} == {0: (["Alpha beta"], ["zeta"]), 4: ([], [])}
    actual = docs.select("doc_id", F.when(F.col("doc_id") == 4, 0).otherwise(3).alias("actual"))
    assert {r.doc_id: r.revised for r in verdicts.revised(actual, found).collect()} == {0: 3, 1: None, 2: None, 3: None, 4: None, 5: None}


def groups(spark, rows):
    return spark.createDataFrame([(0, n, *r) for n, r in enumerate(rows)], "doc_id long, seq int, unit string, parent long, item long, item_lo long, item_hi long, chunk_ids array<long>, text string")


def test_calls(spark):
    rows = groups(
        spark,
        [
            ("basic", None, None, None, None, [0], "t0"),
            ("jobs", None, 1, None, None, [2], "t2"),
            ("jobs", None, 0, None, None, [1], "t1"),
            ("jobs", None, 2, None, None, [3], "t3"),
            ("jobs", None, 0, None, None, [4], "t4"),
            ("notes", None, 0, None, None, [5], "t5"),
            ("notes", None, 1, None, None, [5], "t5"),
            ("jobs.roles", 0, 0, None, None, [1], "t1"),
            ("jobs.roles", 1, 0, None, None, [2], "t2"),
            ("skills", None, None, 0, 3, [6, 7], "t6"),
        ],
    )
    told = spark.createDataFrame([(0, "jobs", [100, 150, 200]), (0, "skills", [10])], "doc_id long, unit string, budgets array<long>")
    calls = [(r.unit, r.parent, r.strategy, r.item, r.batch, list(r.chunk_ids), r.scope, r.budget) for r in execution.plan_calls(rows, told).orderBy("call_seq").collect()]
    assert calls == [
        ("basic", None, "whole", None, None, [0], "t0", None),
        ("jobs", None, "per-item", None, [0, 1], [1, 4, 2], "t1\n\nt4\n\nt2", [100, 150]),
        ("jobs", None, "per-item", 2, None, [3], "t3", [200]),
        ("notes", None, "whole", None, None, [5], "t5", None),
        ("jobs.roles", 0, "whole", None, None, [1], "t1", None),
        ("jobs.roles", 1, "whole", None, None, [2], "t2", None),
        ("skills", None, "ranged", None, [0, 1, 2, 3], [6, 7], "t6", [10, 10, 10, 10]),
    ]


def test_values(spark):
    kinds = "doc_id long, call_seq long, unit string, parent long, strategy string, item long, batch array<long>"
    calls = spark.createDataFrame([(0, 0, "jobs", None, "per-item", None, [0, 1]), (0, 1, "jobs", None, "per-item", 2, None), (0, 2, "jobs.roles", 1, "whole", None, None), (0, 3, "s", None, "ranged", None, [0, 1]), (0, 4, "n", None, "whole", None, None)], kinds)
    replies = spark.createDataFrame([(0, 0, '[{"a":1},{"a":2}]'), (0, 1, '{"a":3}'), (0, 2, '[{"t":1}]'), (0, 3, "[1,2,1]"), (0, 4, "null")], "doc_id long, call_seq long, data string")
    got = {r.path: json.loads(r.value) for r in execution.values(calls, replies).collect()}
    assert got == {"jobs": [{"a": 1}, {"a": 2}, {"a": 3}], "jobs[1].roles": [{"t": 1}], "s": [1, 2]}
    data = json.loads(execution.documents_of(execution.values(calls, replies)).first().data)
    assert data["jobs"][1] == {"a": 2, "roles": [{"t": 1}]}


def test_owners_and_remedies(spark):
    kinds = "doc_id long, call_seq long, unit string, parent long, strategy string, item long, batch array<long>"
    calls = spark.createDataFrame([(0, 0, "jobs", None, "per-item", None, [0, 1]), (0, 1, "jobs", None, "per-item", 2, None), (0, 2, "jobs.roles", 1, "whole", None, None), (0, 3, "$misc", None, "whole", None, None), (0, 4, "basic", None, "whole", None, None)], kinds)
    paths = {"jobs[1].company": 0, "jobs[2].company": 1, "jobs[1].roles[0].title": 2, "basic.name": 4, "created": 3, "jobs[7].x": 3, "basics": 3}
    issues = spark.createDataFrame([(0, p) for p in paths], "doc_id long, path string")
    assert {r.path: r.call_seq for r in corrections.owners(issues, calls).collect()} == paths
    produced = spark.createDataFrame([(0, 0, 1), (0, 1, 1)], "doc_id long, call_seq long, got long")
    short = spark.createDataFrame([(0, "jobs", "jobs[2]", 3, 2, False)], "doc_id long, key string, path string, expected long, got long, report_only boolean")
    assert [r.call_seq for r in corrections.count_owners(short, calls, produced).collect()] == [0]
    rows = spark.createDataFrame([("[1]", False, '[{"op":"add","path":"/-","value":2}]', "u"), ("[]", False, "[5]", "u"), (None, False, "7", "u"), ("[1]", False, "[]", "u"), ("[1]", False, '[{"op":"remove","path":"/9"}]', "u"), ("[1]", False, "[3]", "u")], "data string, broken boolean, reply string, unit string")
    got = corrections.replied(corrections.remedies(rows)).collect()
    assert [(r.remedy, r.data, r.broken, r.no_fix) for r in got] == [("patch", "[1,2]", False, False), ("fresh", "[5]", False, False), ("full", "7", False, False), ("patch", "[1]", False, True), ("patch", "[1]", True, False), ("patch", "[3]", False, False)]


def test_copies(spark):
    source = "Duties: he **managed** the\nplant and wrote many long reports about its daily output and costs"
    docs = spark.createDataFrame([(0, source)], "doc_id long, text string")
    values = [("a", "managed the plant"), ("b", "Duties: managed"), ("c", "invented completely different wording here"), ("d", "wrote many long reports about its daily outputs and costs"), ("e", " ")]
    rows = spark.createDataFrame([(0, p, v, ["Duties"], 0.9) for p, v in values], "doc_id long, path string, value string, labels array<string>, ratio double")
    assert {(r.path, r.code) for r in copies.breaches(rows, docs).collect()} == {("b", "heading"), ("c", "verbatim")}


def test_audits(spark):
    kinds = "doc_id long, unit string, call_seq long, strategy string, item long, batch array<long>, chunk_ids array<long>, budget array<long>"
    calls = spark.createDataFrame([(0, "j", 0, "per-item", None, [0, 1], [1, 2], [5, 6]), (0, "j", 1, "per-item", 2, None, [3], [7]), (0, "w", 2, "whole", None, None, [4], [8, 9]), (0, "n", 3, "whole", None, None, [4], None)], kinds)
    assert {r.unit: r.budgets for r in evals.per_item_budgets(calls).collect()} == {"j": [5, 6, 7], "w": [8, 9]}
    assert [r.unit for r in evals.whole_units(calls).collect()] == ["w"]
    assigned = spark.createDataFrame([(0, "j", 0, [1]), (0, "j", 3, [2, 3]), (0, "w", 5, [4]), (0, "n", None, [4])], "doc_id long, unit string, item long, chunks array<long>")
    assert tuple(evals.overlap(assigned, calls).first()) == (0, 0, 1, False)
    items = spark.createDataFrame([(0, "a", 0, 100, 30, "abs"), (0, "a", 1, 100, 90, "abs"), (0, "a", 2, 20, 44, "abs"), (0, "k", 0, 100, 500, "kw"), (0, "k", 1, 300, 0, "kw")], "doc_id long, unit string, item long, budget long, chars long, kind string")
    assert {r.unit: (r.low, r.high, r.wild) for r in evals.budget_fit(items).collect()} == {"a": (0.3, 2.2, 1), "k": (1.25, 1.25, 0)}


TEXT = "Ann Lee is the applicant\nAcme: engineer from 2001 until 2005\nBeta: manager\nCreated today, a longer closing line here"


def test_extraction(spark):
    documents = spark.createDataFrame([(1, TEXT), (2, ""), (3, "broken text that is here\nand another line of it, longer by far")], "doc_id long, text string")
    schema = {"type": "object", "properties": {k: SCHEMA["properties"][k] for k in ("basic", "created")} | {"jobs": {"type": "array", "items": {"type": "object", "properties": {"company": {"type": "string"}}}}}}
    schema["properties"] = {"basic": schema["properties"]["basic"], "jobs": schema["properties"]["jobs"], "created": schema["properties"]["created"]}

    class Runner:
        """Reads what it is asked: a map that lacks a line first, then a diff; one job too few, then a patch."""

        def run(self, *, instructions, contract, content, scope="", history=None, feedback=None):
            if content.startswith("broken"):
                raise RuntimeError("no answer")
            if contract == {"type": "string"}:
                return ("+ 3 c", history) if feedback else ("0 a\n1 b.0\n2 b.1\nb: 2", {"asked": 1})
            if feedback:
                return [{"op": "add", "path": "/jobs/-", "value": {"company": "Beta"}}], history
            if "[basic |" in instructions:
                return {"name": scope.split(" is")[0]}, {"k": 1}
            if "[jobs |" in instructions:
                found = [{"company": m} for m in re.findall(r"(\w+):", scope)]
                return (found[:1] if contract.get("type") == "array" else found[0]), {"k": 2}
            return {"created": "today"}, {"k": 3}

    found = extraction.extract(documents, schema, Runner)
    data = {r.doc_id: json.loads(r.data) for r in found.data.collect()}
    assert data == {1: {"basic": {"name": "Ann Lee"}, "jobs": [{"company": "Acme"}, {"company": "Beta"}], "created": "today"}, 2: {}, 3: {}}
    assert found.issues.count() == 0
    assert [(r.doc_id, r.rule) for r in found.errors.collect()] == [(3, "call failed")]
    assert found.maps.first().map.split("\n")[:3] == ["0 a", "1 b.0", "2 b.1"] and found.prompts == {"router": "default", "recount": "default", "specialist": "default"}
    assert extraction.typed(found, "created string, jobs array<struct<company:string>>").where("doc_id = 1").first().jobs[1].company == "Beta"


def test_hints(spark):
    units = units_table(spark, decompose(SCHEMA))
    found = lines_of(spark, ["0 a\n1-4 b.0\n2-4 b.0.c.0,b.0.c.1\n5 -\nb: 2\nb.0.c: 2\nd: 0\na: 1\ne: 1"])
    dests, told = route_map.destinations(found, units), route_map.declarations(found, units)
    assert [(r.code, r.parent, r.chunks, r.n) for r in hints.merged_nested(dests, told).collect()] == [("c", 0, 3, 2)]
    assert [r.code for r in hints.pending_zeros(told, units).collect()] == ["d"] and [r.code for r in hints.undrawn(told, dests).collect()] == ["e"]
    assert {(r.code, r.item, r.chunk_id) for r in hints.chain_fed(dests).collect()} == {("b", 0, n) for n in (2, 3, 4)}
    assert {(r.code, r.parent) for r in hints.drawn_pairs(dests).collect()} == {("a", None), ("b", None), ("c", 0)}
    assert {(r.code, r.parent): r.n for r in hints.drawn_counts(told, dests).collect()} == {("a", None): 1, ("b", None): 1, ("c", 0): 2, ("d", None): 0, ("e", None): 1}
    errors = spark.createDataFrame([(0, "items differ from the count", "b 2"), (1, "items differ from the count", "b 2"), (1, "overlap", "0 1")], "doc_id long, rule string, detail string")
    assert [r.doc_id for r in hints.passable(errors).collect()] == [0]
    removed = spark.createDataFrame([(0, 3, 5, "3-5 b.0"), (0, 6, 9, "6-9 b.1")], "doc_id long, start long, end long, line string")
    holes = spark.createDataFrame([(0, 4, 4), (0, 11, 11)], "doc_id long, hole_start long, hole_end long")
    assert [(r.hole_start, r.line) for r in hints.uncovered_by(removed, holes).collect()] == [(4, "3-5 b.0")]
    cut = intervals.even_blocks(spark.createDataFrame([(0, 10, 19, 5)], "doc_id long, start long, end long, items long"), F.lit(2).cast("long"))
    assert [r.line for r in hints.block_lines(cut, "b").orderBy("block").collect()] == ["10-14 b.0-1", "15-19 b.2-4"]


def test_claims_and_splices(spark):
    units = units_table(spark, decompose(SCHEMA))
    assert [(r.code, r.n) for r in route_map.zero_counts(route_map.declarations(lines_of(spark, ["0 a\nb: 1"]), units), route_map.destinations(lines_of(spark, ["0 a\nb: 1"]), units), ["b", "d"], lines_of(spark, ["0 a"])).orderBy("code").collect()] == [("b", 1), ("d", 0)]
    replies = spark.createDataFrame([(0, "b: 0\n- Acme\n2. Beta\nd: 3\nnone here\nq: 2")], "doc_id long, text string")
    assert {r.label: (r.n, r.quotes) for r in recounts.claims_of(replies, ["b", "d"]).collect()} == {"b": (2, ["Acme", "Beta"]), "d": (3, ["none here", "q: 2"])}
    dests = route_map.destinations(lines_of(spark, ["0 a\n1-4 -\n5 b.0"]), units)
    answer = route_map.destinations(lines_of(spark, ["1-2 d.0\n4-5 d.1\n3 d.2"]), units)
    assert {(r.start, r.code, r.item_lo) for r in recounts.spliced(dests, answer).collect()} == {(1, "d", 0), (3, "d", 2)}


def test_fresh_counts(spark):
    units = units_table(spark, decompose(SCHEMA))
    lines = lines_of(spark, ["0 a\n1-3 -\n4 b.0\nb: 1\nd: 0", "0 a\n1-4 -\nd: 0"]).select("doc_id", F.col("line_no").cast("int").alias("line_no"), "line")
    parts = spark.createDataFrame([(0, "[0] x", 5, "text"), (1, "[0] x", 5, "text")], "doc_id long, parts string, size long, content string")

    class Runner:
        def run(self, *, instructions, **_):
            assert "RECOUNT" in instructions
            return ("1 d.0\n3 d.1" if "b = " not in instructions else "0 d.0"), None

    got = routing.recounted(lines, parts, parts.select("doc_id", "size"), units, Runner)
    texts = {}
    for row in got.orderBy("doc_id", "line_no").collect():
        texts.setdefault(row.doc_id, []).append(row.line)
    assert texts[0] == ["0 a", "4 b.0", "1 d.0", "3 d.1", "2-2 -", "b: 1", "d: 2"]
    assert texts[1] == ["0 a", "1 d.0", "3 d.1", "2-2 -", "4-4 -", "d: 2"]


def test_fresh_counts_on_other_units_lines(spark):
    units = units_table(spark, decompose(SCHEMA))
    lines = lines_of(spark, ["0 a\n1 b.0\n2 b.1\n3 -\nb: 2\nd: 0"]).select("doc_id", F.col("line_no").cast("int").alias("line_no"), "line")
    parts = spark.createDataFrame([(0, "[0] x", 4, "text")], "doc_id long, parts string, size long, content string")

    class Runner:
        def run(self, **_):
            return "1 d.0\n2 d.1", None

    got = routing.recounted(lines, parts, parts.select("doc_id", "size"), units, Runner)
    assert [r.line for r in got.orderBy("line_no").collect()] == ["0 a", "1 b.0", "2 b.1", "3-3 -", "b: 2", "d = b"]


def test_judge(spark):
    cases = spark.createDataFrame([(0, "s", "o"), (1, "s", "o")], "doc_id long, source string, output string").coalesce(1)
    got = judged(cases, "all is well", lambda: ScriptedRunner([{"ok": True, "reason": "r"}, "?"])).orderBy("doc_id").collect()
    assert [(r.ok, r.reason) for r in got] == [(True, "r"), (False, "")]
    assert canonical({"b": 1, "a": "é"}) == '{"a":"é","b":1}'


def test_streams(spark, tmp_path):
    from siltstone.streaming import chunks

    rows = [(n, TEXT, f"2024-01-01 00:{n:02d}:00") for n in range(30)] + [(0, TEXT, "2024-01-01 00:00:30")]
    spark.createDataFrame(rows, "doc_id long, text string, at string").selectExpr("doc_id", "text", "cast(at as timestamp) at").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string, at timestamp").parquet(str(tmp_path / "in"))
    for name, frame in (("chunked", chunks.stream_chunks(stream)), ("once", chunks.first_versions(stream, "at")), ("counted", chunks.chunk_counts(stream, "at"))):
        frame.writeStream.format("memory").queryName(name).outputMode("complete" if name == "counted" else "append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("chunked").count() == 4 * len(rows)
    assert spark.table("once").count() == 30
    assert sorted(r.documents for r in spark.table("counted").collect()) == [10, 10, 11]


def test_kept_tables_are_broadcast_by_what_they_hold(spark):
    """Files of equal texts are small, and what the driver would hold of them is not."""
    from siltstone.sources.shared import kept

    def joined(n):
        made = kept(spark.range(n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 1000).alias("text")), "made")
        few = made.where("doc_id % 2 = 0")
        found = spark.range(2 * n).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("name")).join(few, "doc_id")
        assert len(found.collect()) == n // 2
        return found._jdf.queryExecution().executedPlan().toString()

    assert "BroadcastExchange" not in joined(20_000)


def test_parts_of_runs_grow_with_the_documents(spark, monkeypatch):
    from siltstone import queries

    assert queries.runs(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4
    monkeypatch.setattr(queries, "PART_BYTES", 10_000)
    assert queries.runs(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 30


def test_a_units_material_needs_no_item_for_every_chunk(spark):
    dests = spark.createDataFrame([(1, 0, 9, "b", 0, 8, None), (1, 5, 11, "b", 9, 9, None), (1, 12, 12, "-", None, None, None), (1, 3, 4, "a", None, None, "bad"), (2, 0, 3, "b", 0, 0, None)], "doc_id long, start long, end long, code string, item_lo long, item_hi long, error string")
    dests = dests.withColumns({"parent_code": F.lit(None).cast("string"), "parent": F.lit(None).cast("long"), "ranged": F.lit(True)})
    chunks = spark.createDataFrame([(d, n, 10 * d + n) for d in (1, 2) for n in range(13)], "doc_id long, chunk_id long, content_len long")
    drawn = route_map.drawn_chunks(dests).withColumnRenamed("code", "unit")
    assert drawn.count() == 16
    points = route_map.assignments(dests).select("doc_id", F.col("code").alias("unit"), "item", "chunk_id")
    by_item = budgets.material(points, chunks).groupBy("doc_id", "unit").agg(F.round(F.sum("material"), 6).alias("material"))
    assert sorted(map(tuple, budgets.unit_material(drawn, chunks).collect())) == sorted(map(tuple, by_item.collect()))
