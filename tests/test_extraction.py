"""Extraction from end to end: repairs over two rounds, arbitration, copies, ranges, yielding fields, quotas."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import siltstone
from siltstone import extraction
from siltstone.operators import copies, corrections, execution, routing, verdicts
from siltstone.plans.quota import Quota, parse_quota
from siltstone.plans.schema import marked_fields
from siltstone.plans.units import decompose, units_table
from siltstone.sources.runner import Pace, ask

# Workers can't import this module, so its runners go to them by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TEXT = "Ann Lee is the applicant\nAcme: engineer from 2001 until 2005\nBeta: manager\nCreated today, a longer closing line here"
SCHEMA = {"type": "object", "properties": {"basic": {"type": "object", "properties": {"name": {"type": "string"}, "age": {"type": "string"}}}, "jobs": {"type": "array", "items": {"type": "object", "properties": {"company": {"type": "string"}}}}}}


def documents(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


class Talker:
    """Answers by what it is asked; histories count the turns of a conversation, and replies say what was asked."""

    MAP = "0 a\n1 b.0\n2 b.1\n3 -\nb: 2"

    def run(self, *, instructions, contract, content, scope="", history=None, feedback=None):
        if instructions.startswith("The document below holds instances"):
            return self.check(instructions, content), None
        if contract == {"type": "string"}:
            return self.MAP, {"map": 1}
        turn = (history or {"n": 0})["n"] + 1
        return self.value(turn, instructions, contract, scope, history, feedback), {"n": turn}

    def check(self, instructions, content):
        return "missing:\nextra:"

    def value(self, turn, instructions, contract, scope, history, feedback):
        if "[basic |" in instructions or feedback and "basic" in feedback[0]:
            if not feedback:
                return {"name": "Ann"}
            # The second round patches on top of the first: its history counts two turns.
            assert history == {"n": turn - 1} and feedback[-1].endswith(extraction.PATCH) and "anyOf" in contract
            return [{"op": "add", "path": "/age", "value": f"{turn}:{feedback[0].split(chr(10))[0]}"}]
        return [{"company": "Acme"}, {"company": "Beta"}] if contract["type"] == "array" else {"company": "Acme"}


def asks(data):
    """A host's rule: an age of the third turn. Its message is what the runner is to hear."""
    age = F.get_json_object("data", "$.basic.age")
    rows = data.where(F.coalesce(~F.startswith(age, F.lit("3:")), F.lit(True)))
    return rows.select("doc_id", F.when(age.isNull(), "basic.age").otherwise("basic").alias("path"), F.concat(F.lit("needs an age, has "), F.coalesce(age, F.lit("none"))).alias("message"), F.lit(False).alias("report_only"), F.lit("age").alias("code"))


def test_two_rounds(spark):
    found = extraction.extract(documents(spark, TEXT, TEXT), SCHEMA, Talker, asks)
    data = {r.doc_id: json.loads(r.data) for r in found.data.collect()}
    assert data[0]["basic"] == {"name": "Ann", "age": "3:basic: needs an age, has 2:basic.age: needs an age, has none"} and data[1] == data[0]
    assert found.issues.count() == 0
    assert sorted((r.doc_id, r.round, r.remedy, tuple(r.paths)) for r in found.corrections.collect()) == [(d, n, "patch", (("basic.age",), ("basic",))[n]) for d in (0, 1) for n in (0, 1)]
    # Plans begin at written tables: the last one is no longer for having had two rounds.
    assert len(found.data._jdf.queryExecution().optimizedPlan().toString()) < 30_000
    assert len(found.issues._jdf.queryExecution().optimizedPlan().toString()) < 3_000


def test_issues_that_stay_are_reported(spark):
    class Stubborn(Talker):
        def value(self, turn, instructions, contract, scope, history, feedback):
            return [] if feedback else super().value(turn, instructions, contract, scope, history, feedback)

    found = extraction.extract(documents(spark, TEXT), SCHEMA, Stubborn, asks)
    (issue,) = found.issues.collect()
    assert (issue.path, issue.code, issue.message, issue.origin) == ("basic.age", "age", "needs an age, has none", 0)
    # An empty patch says that it is not there, so the path is asked for once.
    assert found.corrections.count() == 1
    empty = extraction.extract(documents(spark, "", " "), SCHEMA, Stubborn, asks)
    assert {r.data for r in empty.data.collect()} == {"{}"} and empty.calls.count() == 0 and empty.issues.count() == 2


@pytest.mark.parametrize("answer,revised", [("missing:\nextra:\n- Gamma", 2), ("missing:\nBeta: manager\nextra:", 4), ("who knows", None)])
def test_arbitration(spark, answer, revised):
    class Generous(Talker):
        MAP = "0 a\n1-2 b.0,b.1\n3 -\nb: 2"

        def check(self, instructions, content):
            assert "- Gamma" in instructions and content == TEXT
            return answer

        def value(self, turn, instructions, contract, scope, history, feedback):
            if feedback and "jobs" in feedback[0]:
                return [{"op": "remove", "path": "/2"}] if revised == 2 else [{"op": "add", "path": "/-", "value": {"company": "More"}}]
            return [{"company": c} for c in ("Acme", "Beta", "Gamma")] if contract.get("type") == "array" else {"name": "Ann"}

    found = extraction.extract(documents(spark, TEXT), SCHEMA, Generous)
    (row,) = found.recounts.collect()
    assert (row.path, row.declared, row.actual, row.revised, row.answer) == ("jobs", 2, 3, revised, answer)
    jobs = [j["company"] for j in json.loads(found.data.first().data)["jobs"]]
    assert jobs == {2: ["Acme", "Beta"], 4: ["Acme", "Beta", "Gamma", "More"], None: ["Acme", "Beta", "Gamma"]}[revised]
    # A surplus that no check settles is reported and not repaired.
    assert [(r.path, r.report_only, r.expected, r.got) for r in found.issues.collect()] == ([("jobs", True, "2", "3")] if revised is None else [])


COPIED = {"type": "object", "properties": {"career": {"type": "object", "properties": {"jobs": {"type": "array", "items": {"type": "object", "properties": {"company": {"type": "string", "description": "Firm: name"}, "detail": {"type": "object", "properties": {"duties": {"type": "array", "description": "Duties", "x-verbatim": 0.9, "items": {"type": "string"}}, "head": {"type": "string", "description": "Head: who"}}}}}}}}, "motto": {"type": "string", "x-verbatim": True}}}


def test_copies_from_end_to_end(spark):
    text = "Acme is the firm of hers\nshe ran the large plant in the north for years\nand wrote reports on its daily output\nPer aspera ad astra is her motto"

    class Copyist(Talker):
        MAP = "0-2 a.0\n3 b\na: 1"

        def value(self, turn, instructions, contract, scope, history, feedback):
            if feedback:
                assert any("copy it out" in line for line in feedback) or "heading" in feedback[0]
                return [{"op": "replace", "path": "/0/detail/duties/0", "value": "she ran the large plant in the north for years"}] if "career.jobs" in feedback[0] else [{"op": "replace", "path": "/motto", "value": "Per aspera ad astra"}]
            if "[$misc" in instructions:
                return {"motto": "Through hardships to the stars of the sky"}
            entry = {"company": "Acme", "detail": {"duties": ["managed a big factory somewhere up there", "wrote reports on its daily output", "Head: wrote reports"], "head": "x"}}
            return [entry] if contract.get("type") == "array" else entry

    found = extraction.extract(documents(spark, text), COPIED, Copyist)
    data = json.loads(found.data.first().data)
    assert data["motto"] == "Per aspera ad astra" and data["career"]["jobs"][0]["detail"]["duties"][0].startswith("she ran")
    assert [(r.path, r.code, r.got) for r in found.issues.collect()] == [("career.jobs[0].detail.duties[2]", "heading", "Head: wrote reports")]


def test_marked_fields(spark):
    (motto, duties) = sorted(marked_fields(COPIED), key=lambda m: len(m.steps))
    assert motto.steps == (("motto", False),) and motto.labels == () and motto.ratio == 1.0
    assert duties.steps == (("career", False), ("jobs", True), ("detail", False), ("duties", True)) and duties.labels == ("Firm", "Head")
    data = [(0, '{"motto":"m","career":{"jobs":[{"detail":{"duties":["a"," ",5]}},null,{"detail":{"duties":"no"}},{"detail":{"duties":["b"]}}]}}'), (1, '{"motto":["x"],"career":[]}'), (2, "no json")]
    rows = copies.marked_values(spark.createDataFrame(data, "doc_id long, data string"), marked_fields(COPIED)).collect()
    assert {(r.doc_id, r.path, r.value) for r in rows} == {(0, "motto", "m"), (0, "career.jobs[0].detail.duties[0]", "a"), (0, "career.jobs[3].detail.duties[0]", "b")}


def test_ranges_run_as_one_call(spark):
    text = "Ann Lee\n" + "\n".join(f"Firm {n} where she was clerk" for n in range(4)) + "\nthe end"

    class Ranger(Talker):
        MAP = "0 a\n1-4 b.0-3\n5 -\nb: 4"

        def value(self, turn, instructions, contract, scope, history, feedback):
            if "[basic |" in instructions:
                return {"name": "Ann"}
            firms = [{"company": line.split(" where")[0]} for line in scope.split("\n")]
            return [*firms, firms[0]]

    found = extraction.extract(documents(spark, text), SCHEMA, Ranger)
    calls = {r.unit: r for r in found.calls.collect()}
    assert calls["jobs"].strategy == "ranged" and list(calls["jobs"].batch) == [0, 1, 2, 3] and list(calls["jobs"].chunk_ids) == [1, 2, 3, 4]
    # One entry too many, an exact repeat, goes.
    assert json.loads(found.data.first().data)["jobs"] == [{"company": f"Firm {n}"} for n in range(4)] and found.issues.count() == 0


def test_yielding_fields_are_not_asked_for(spark):
    schema = {"type": "object", "properties": {"work": {"type": "array", "items": {"type": "object", "properties": {"firm": {"type": "string"}, "whole": {"type": "string", "x-override": "parts"}, "parts": {"type": "array", "items": {"type": "object", "properties": {"title": {"type": "string"}}}}}}}}}

    class Worker(Talker):
        MAP = "0-1 a.0\n1 a.0.b.0\n2 a.1\na: 2\na.0.b: 1"

        def value(self, turn, instructions, contract, scope, history, feedback):
            shape = contract.get("items", contract)
            if "title" in shape["properties"]:
                return [{"title": "t"}]
            return {"firm": scope[:4]} | ({"whole": "w"} if "whole" in shape["properties"] else {}) | ({"card": "x"} if "whole" in instructions and "whole" not in shape["properties"] else {})

    found = extraction.extract(documents(spark, "Acme one\nits part, of some length here\nBeta two"), schema, Worker)
    assert json.loads(found.data.first().data) == {"work": [{"firm": "Acme", "parts": [{"title": "t"}]}, {"firm": "Beta", "whole": "w"}]}


def test_quotas_are_kept(spark):
    waits, now = [], [0.0]

    def sleep(seconds):
        waits.append(round(seconds, 6))
        now[0] += seconds

    pace = Pace(Quota(1, calls_per_second=2, tokens_per_second=100, burst=0.0), lambda: now[0], sleep)
    for tokens in (10, 10, 200, 10):
        pace.wait(tokens)
    assert waits == [0.5, 0.5, 1.5]
    pace.correct(10, 110)
    pace.wait(1)
    assert waits[-1] == 1.1
    free = Pace(Quota(1), lambda: now[0], sleep)
    free.wait(1e9)
    assert len(waits) == 4

    class Slow:
        def run(self, *, instructions, contract, content, scope, history, feedback, prompt_parts=None, cache_blocks=None):
            import time

            began = time.time()
            time.sleep(0.05)
            return [[began, time.time()], prompt_parts, cache_blocks], None, 5

    none = F.lit(None).cast("string")
    rows = spark.range(24).select(F.lit(7).cast("long").alias("doc_id"), F.col("id").cast("string").alias("call_key"), *(none.alias(c) for c in ("instructions", "contract", "content", "scope", "history", "feedback")), F.array(F.lit("p")).alias("prompt_parts"), F.lit(2).alias("cache_blocks"))
    got = ask(rows, Slow, parse_quota("8|rps:1000")).withColumn("part", F.spark_partition_id()).collect()
    # One document's calls go to several tasks, and several run at a time in each.
    assert len(got) == 24 and len({r.part for r in got}) > 1 and all(json.loads(r.data)[1:] == [["p"], 2] for r in got)
    spans = {}
    for r in got:
        spans.setdefault(r.part, []).append(json.loads(r.data)[0])
    assert any(b[0] < a[1] for own in spans.values() for a, b in zip(sorted(own), sorted(own)[1:], strict=False))


def test_count_owners_by_direction(spark):
    kinds = "doc_id long, call_seq long, unit string, parent long, strategy string, item long, batch array<long>"
    calls = spark.createDataFrame([(0, 0, "jobs", None, "per-item", None, [0, 1, 2]), (0, 1, "jobs", None, "per-item", 3, None), (0, 2, "$misc", None, "whole", None, None)], kinds)
    state = spark.createDataFrame([(0, 0, '[{"a":1},{"a":2}]'), (0, 1, '{"a":1,"b":2}'), (0, 2, "null")], "doc_id long, call_seq long, data string")
    made = corrections.produced(calls, state)
    assert {r.call_seq: r.got for r in made.collect()} == {0: 2, 1: 1, 2: 0}
    counts = spark.createDataFrame([(0, "jobs", 4)], "doc_id long, path string, declared long")
    sizes = spark.createDataFrame([(0, "jobs", 3)], "doc_id long, path string, actual long")
    issues = corrections.issue_rows(corrections.count_messages(corrections.count_issues(counts, sizes)), 2)
    host = corrections.issue_rows(spark.createDataFrame([(0, "created", "m")], "doc_id long, path string, message string"), 0)
    found = {r.call_seq: (r.paths, r.messages) for r in corrections.routed(issues.unionByName(host), calls, made).collect()}
    # The short call alone is asked for what is missing.
    assert found.keys() == {0, 2} and found[0][0] == ["jobs[3]"] and found[2] == (["created"], ["created: m"])


def test_item_chars(spark):
    budgets = spark.createDataFrame([(0, "jobs", [5, 7]), (0, "notes", [4, 4]), (0, "basic", [9])], "doc_id long, path string, budgets array<long>")
    values = spark.createDataFrame([(0, "jobs", '[{"a":"xy"},{"a":"z"},{"a":null}]'), (0, "notes", '["ab","c"]'), (0, "basic", '{"n":"abc"}')], "doc_id long, path string, value string")
    whole = spark.createDataFrame([(0, "notes")], "doc_id long, path string")
    assert {(r.key, r.budget, r.chars) for r in corrections.item_chars(budgets, values, whole).collect()} == {("jobs[0]", 5, 2), ("jobs[1]", 7, 1), ("jobs[2]", 7, 4), ("notes (total)", 8, 3), ("basic", 9, 3)}


def test_strings_of_entries(spark):
    rows = spark.createDataFrame([(0, 0, '{"a":"long one","b":"x","c":3}'), (0, 1, '"plain"'), (0, 2, "12"), (0, 3, "null"), (0, 4, "{}")], "doc_id long, seq int, entry string")
    got = {r.seq: sorted(r.strings) for r in verdicts.strings_of(rows).collect()}
    assert got == {0: ["long one", "x"], 1: ["plain"], 2: ["12"], 4: []}


def test_public_names():
    assert siltstone.extract is extraction.extract and set(siltstone.__all__) >= {"extract", "ExtractionConfig", "Runner", "chunk", "decompose", "parse_quota"}
    assert all(getattr(siltstone, name) is not None for name in siltstone.__all__)
    with pytest.raises(AttributeError):
        siltstone.nothing


def test_config_is_checked():
    with pytest.raises(ValueError):
        siltstone.ExtractionConfig(router_quota="x")
    with pytest.raises(ValueError):
        siltstone.ExtractionConfig(specialist_instructions="no slot")
