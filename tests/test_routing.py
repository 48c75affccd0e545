"""The routing map's further spellings, and what is done to maps that are right but poorly drawn."""

import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from siltstone.operators import hints, intervals, recounts, route_map, routing
from siltstone.plans.units import decompose, units_table

# Workers can't import this module, so its runners go to them by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = {
    "type": "object",
    "properties": {
        "basic": {"type": "object", "properties": {"name": {"type": "string"}}},
        "jobs": {"type": "array", "items": {"type": "object", "properties": {"company": {"type": "string"}, "roles": {"type": "array", "items": {"type": "object", "properties": {"title": {"type": "string"}}}}}}},
        "notes": {"type": "array", "items": {"type": "object", "properties": {"company": {"type": "string"}}}},
    },
}
# Codes: a basic, b jobs, c jobs.roles, d notes.


def units(spark):
    return units_table(spark, decompose(SCHEMA))


def lines_of(spark, *texts):
    return route_map.lines_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def parsed(spark, *texts):
    found = lines_of(spark, *texts)
    return found, route_map.destinations(found, units(spark)), route_map.declarations(found, units(spark))


def sizes(spark, *counts):
    return spark.createDataFrame(list(enumerate(counts)), "doc_id long, size long")


def test_entries_without_a_parent_hang_under_the_one_on_their_line(spark):
    _, dests, _ = parsed(spark, "0 b.1,c.0-2\n1 b.0,b.1,c.0\n2 c.0\n3 b,c.1\n4 b.0.1.2")
    rows = dests.collect()
    chains = {(r.start, r.code, r.parent_code, r.parent, r.item_lo, r.item_hi) for r in rows if r.error is None and r.parent is not None}
    assert chains == {(0, "c", "b", 1, 0, 2), (3, "c", "b", 0, 1, 1), (4, "c", "b", 0, 1, 1)}
    assert {r.start for r in rows if r.error} == {1, 2}


def test_chains_without_signs_join_the_map(spark):
    base = lines_of(spark, "0 a\n1-3 b.0\nb: 1\nd: 0", "0 a", "0 a")
    replies = spark.createDataFrame([(0, "1 b.0.c.0\n2 b.0.c.1\nb.0.c: 2\nb: 1 @50%"), (1, "0 b.0.c.0\n0 a"), (2, "b: 1")], "doc_id long, text string")
    changes = route_map.overlays(replies, base)
    assert {r.doc_id for r in changes.collect()} == {0}
    got = [r.line for r in route_map.applied(base.where("doc_id = 0"), route_map.net_edits(changes)).orderBy("line_no").collect()]
    assert got[:4] == ["0 a", "1-3 b.0", "1 b.0.c.0", "2 b.0.c.1"] and set(got[4:]) == {"d: 0", "b: 1 @50%", "b.0.c: 2"}


def test_drawing_anew_keeps_a_map(spark):
    text = "0 a\n1-3 b.0\n2 b.0.c.0\n4 b.1,d.0\n5-6 -\n7-9 d.1-3\n10 b.2,b.2.c.0,b.2.c.1\nb: 3 @50%,300\nb.0.c: 1\nb.2.c: 2\nd: 4"
    found, dests, told = parsed(spark, text)
    points = route_map.assignments(dests)
    shown = route_map.redrawn(points, told, sizes(spark, 11))
    assert [r.line for r in shown.orderBy("line_no").collect()] == ["0 a", "1 b.0", "2 b.0,b.0.c.0", "3 b.0", "4 b.1,d.0", "5-6 -", "7-9 d.1-3", "10 b.2,b.2.c.0,b.2.c.1", "b: 3 @50%,300", "b.0.c: 1", "b.2.c: 2", "d: 4"]
    again = route_map.assignments(route_map.destinations(shown, units(spark)))
    key = lambda rows: {tuple(r) for r in rows.select("code", "item", "parent_code", "parent", "chunk_id").collect()}
    assert key(again) == key(points) and route_map.errors(shown, units(spark), sizes(spark, 11)).count() == 0


def test_shared_runs(spark):
    texts = ["0-19 b.0,b.1\n20 -\nb: 2", "0-9 b.0-5\n10-20 d.0\nb: 6\nd: 1", "0-8 b.0\n1 b.0.c.0\n9-20 -\nb: 1\nb.0.c: 1", "0-3 b.0\n4 b.1\n5-20 d.0-9\nb: 2\nd: 10"]
    _, dests, told = parsed(spark, *texts)
    rows = hints.shared_runs(dests, told)
    got = {(r.doc_id, r.code): (r.n, r.span, r.merged, r.short_span, r.short_n) for r in rows.collect()}
    assert got[0, "b"] == (2, 20, 20, None, None) and got[1, "b"] == (6, 10, 10, None, None) and got[1, "d"] == (1, 11, 11, None, None)
    assert got[2, "b"] == (1, 9, 9, None, None) and got[3, "d"] == (10, 16, 16, 16, 10) and (3, "b") not in got
    assert {(r.doc_id, r.code): (r.span, r.n) for r in hints.split_hints(rows).collect()} == {(0, "b"): (20, 2), (1, "d"): (11, 1), (2, "b"): (9, 1), (3, "d"): (16, 10)}


def test_blocks_take_the_place_of_a_run(spark):
    found, dests, told = parsed(spark, "0 a\n1-12 b.0-9\n13 -\nb: 10", "0-11 b.0-9\n3 d.0\n12-13 -\nb: 10\nd: 1")
    shared = hints.shared_runs(dests, told)
    material = spark.createDataFrame([(d, "b", n, 120.0) for d in (0, 1) for n in range(10)], "doc_id long, unit string, item long, material double")
    resolved = spark.createDataFrame([(0, "b", 90)] * 10, "doc_id long, unit string, chars long")
    plans = hints.block_plans(shared, dests, material, resolved)
    assert {(r.doc_id, r.code, r.start, r.end, r["items"], r.blocks) for r in plans.collect()} == {(0, "b", 1, 12, 10, 3), (1, "b", 0, 11, 10, 4)}
    cut, left = hints.adopted_blocks(found, dests, plans)
    assert [r.line for r in cut.orderBy("line_no").collect()] == ["0 a", "1-4 b.0-2", "5-8 b.3-5", "9-12 b.6-9", "13 -", "b: 10"]
    assert [(r.doc_id, r.code) for r in left.collect()] == [(1, "b")]


def test_quotes_fall_back_to_forms_and_beginnings(spark):
    chunks = spark.createDataFrame([(0, 0, "[3] Acme is first"), (0, 1, "Beta Works and Sons"), (0, 2, "Acme is second"), (0, 3, "甲乙 公司"), (1, 0, "Beta Works and Sons")], "doc_id long, chunk_id int, text string")
    quotes = spark.createDataFrame([(0, 0, "[7] Acme is second"), (0, 1, "Beta Works and\\n Daughters"), (0, 2, "[3] Acme is"), (0, 3, "甲乙\\n 未知"), (1, 0, "Beta Works and Daughters")], "doc_id long, quote_no int, quote string")
    assert {(r.doc_id, r.quote_no, r.chunk_id) for r in recounts.anchors(quotes, chunks).collect()} == {(0, 0, 2), (0, 1, 1), (0, 2, 0), (0, 3, 3)}


def test_resplit_moves_chains(spark):
    _, dests, told = parsed(spark, "0-5 b.0\n2 b.0.c.0\n6 b.0.c.1\n7 d.0\nb: 1\nb.0.c: 2\nd: 1")
    points = route_map.assignments(dests)
    found = spark.createDataFrame([(0, 0), (0, 2)], "doc_id long, chunk_id long")
    got = {(r.chunk_id, r.code, r.item, r.parent) for r in recounts.resplit(points, found, "b").collect()}
    # The chain on its parent's chunk follows it; the one that stands alone is left under another instance and goes.
    assert got == {(0, "b", 0, None), (1, "b", 0, None), *((n, "b", 1, None) for n in range(2, 7)), (2, "c", 0, 1), (7, "d", 0, None)}


def test_entries_end_at_sections(spark):
    points = spark.createDataFrame([(d, n) for d in range(3) for n in range(8)], "doc_id long, chunk_id long")
    found = spark.createDataFrame([(0, 1), (0, 4), (1, 1), (2, 3)], "doc_id long, chunk_id long")
    opens = spark.createDataFrame([(0, 4), (0, 6), (2, 3)], "doc_id long, chunk_id long")
    got = {}
    for r in recounts.lay_entries(points, found, opens).collect():
        got.setdefault(r.doc_id, {})[r.chunk_id] = r.item
    assert got == {0: {1: 0, 2: 0, 3: 0, 4: 1, 5: 1}, 1: {1: 0}, 2: {n: 0 for n in range(3, 8)}}


def test_messages_name_remedies(spark):
    texts = ["0-1 b.0\n4 -\nb: 1", "0-9 b.0.c.0\n0-9 b.0\n2-3 b.0.c.0\nb: 1\nb.0.c: 1", "0-3 b.0\n0-3 b.0.c.0\n2-5 b.0.c.1\n6-9 -\nb: 1\nb.0.c: 1"]
    found, dests, told = parsed(spark, *texts)
    wrong = route_map.errors(found, units(spark), sizes(spark, 5, 10, 10))
    removed = spark.createDataFrame([(0, 2, 3, "2-3 d.0")], "doc_id long, start long, end long, line string")
    past = spark.createDataFrame([(0, 0, "not covered", "2 3"), (0, 1, "overlap", "1 2")], "doc_id long, round int, rule string, detail string")
    said = {(r.doc_id, r.rule): r.message for r in hints.messages(wrong, dests, told, removed, past).collect()}
    assert said[0, "not covered"] == 'no line has chunks 2 3; you took out "2-3 d.0", which had them: put it back, unless they belong elsewhere; an earlier round had mended this: do so once more'
    plain = {(r.doc_id, r.rule): r.message for r in hints.messages(wrong, dests, told).collect()}
    assert plain[0, "not covered"] == 'no line has chunks 2 3; go on with "0-3 b.0", or give them "-"'
    assert 'go on with "0-5 b.0.c.0"' in plain[2, "items differ from the count"]
    again = hints.chain_remedies(parsed(spark, "0-5 b.0.c.0,d.0\n2-3 b.0.c.0")[1]).first()
    assert again.detail == "2 3" and again.remedy.startswith('take out "0-5 b.0.c.0,d.0"')
    twice = hints.chain_remedies(parsed(spark, "0-3 b.0,b.0.c.0\n2-5 b.0.c.1")[1]).first()
    assert twice.remedy == "both are entries of b.0: end the earlier one at 1"
    over = hints.chain_remedies(parsed(spark, "0-3 b.0\n2-5 b.0.c.1")[1]).first()
    assert over.remedy == "b.0 is drawn over its own entries: it keeps chunks 0, 1"


class Mapper:
    """Draws a lazy map, and says on a fresh count how instances begin."""

    MAPS = {"plain": "0 a\n1-9 b.0\n10 -\nb: 1\nd: 0", "dense": "0 a\n1-10 b.0-9\nb: 10\nd: 0", "vague": "0 a\n1-9 b.0\n10 -\nb: 1\nd: 0", "nested": "0 a\n1 b.0\n2-9 b.0.c.0,b.0.c.1\n10 -\nb: 1\nb.0.c: 2\nd: 0"}

    def run(self, *, instructions, contract, content, scope="", history=None, feedback=None, prompt_parts=None):
        if "drawn as one" in instructions:
            assert history is None and prompt_parts[0].startswith("Parts:")
            if content == "nested":
                assert "b.0.c = " in instructions
                return "b.0.c: 1\nLine 4 of nested", None
            return ("b: 3\nLine 1 of plain\nLine 4 of\nLine 7 of", None) if content == "plain" else ("b: 2\nnothing like it\nnor this", None)
        if "Look afresh" in instructions:
            return "none", None
        if feedback:
            assert content == "vague" and "9 chunks for 1 instances" in feedback[0]
            return "- 1-9 b.0\n+ 1-5 b.0\n+ 6-9 b.1\n- b: 1\n+ b: 2", {"n": 2}
        return self.MAPS[content], {"n": 1}


def test_poorly_drawn_maps_are_drawn_anew(spark):
    names = ["plain", "dense", "vague", "nested"]
    documents = spark.createDataFrame(list(enumerate(names)), "doc_id long, text string")
    rows = [(d, n, f"Line {n} of {name}" + ("x" * 200 if name == "dense" else ""), False, 10 + (200 if name == "dense" else 0)) for d, name in enumerate(names) for n in range(11)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_id int, text string, opens_section boolean, content_len int")
    plan = decompose(SCHEMA)
    lines, errors = routing.route(documents, chunks, plan, units_table(spark, plan), Mapper)
    assert errors.count() == 0
    got = {}
    for r in lines.orderBy("doc_id", "line_no").collect():
        got.setdefault(names[r.doc_id], []).append(r.line)
    assert got["plain"] == ["0 a", "1-3 b.0", "4-6 b.1", "7-9 b.2", "10 -", "b: 3", "d: 0"]
    # Ten items of ten chunks and about 2,100 characters: seven blocks.
    cut = [(f"{lo}-{hi}", f"{lo - 1}" if lo == hi else f"{lo - 1}-{hi - 1}") for lo, hi in ((1 + j * 10 // 7, (j + 1) * 10 // 7) for j in range(7))]
    assert got["dense"] == ["0 a", *(f"{span} b.{item}" for span, item in cut), "b: 10", "d: 0"]
    assert [x for x in got["vague"] if "b" in x] == ["1-5 b.0", "6-9 b.1", "b: 2"]
    assert got["nested"] == ["0 a", "1-3 b.0", "4 b.0.c.0", "5-9 b.0", "10 -", "b: 1", "b.0.c: 1", "d: 0"]
