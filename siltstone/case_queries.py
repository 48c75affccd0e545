"""Registered queries over cases: every document has one of a few texts by its number, and the SQL says what comes of it.

They show what the tables alone do not hold: spellings, broken and poorly drawn maps, replies, schemas.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import extraction
from siltstone.functions import json_values, text
from siltstone.operators import budgets, corrections, evals, execution, hints, recounts, route_map, routing, verdicts
from siltstone.plans import schema as schemas
from siltstone.plans.quota import parse_quota
from siltstone.plans.units import decompose, stripped, units_table, yields
from siltstone.queries import query, table
from siltstone.sources.documents import spread
from siltstone.sources.runner import ask, judged

#: Codes: a basic, b jobs, c jobs.roles, d notes.
SCHEMA = {
    "type": "object",
    "properties": {
        "basic": {"type": "object", "properties": {"name": {"type": "string"}}},
        "jobs": {"type": "array", "items": {"type": "object", "properties": {"company": {"type": "string"}, "roles": {"type": "array", "items": {"type": "object", "properties": {"title": {"type": "string"}}}}}}},
        "notes": {"type": "array", "items": {"type": "object", "properties": {"company": {"type": "string"}}}},
    },
}


def _literal(value, kind: str) -> str:
    if value is None:
        return f"CAST(NULL AS {kind})"
    if kind == "VARCHAR":
        return "'" + value.replace("'", "''") + "'"
    return f"CAST({str(value).lower() if isinstance(value, bool) else value} AS {kind})"


def expected(names: str, per_case: list[list[tuple]]) -> str:
    """SQL for the rows of every document by its case; ``names`` are ``name KIND, ..``."""
    columns = [part.split() for part in names.split(", ")]
    rows = [f"({k}, {', '.join(_literal(v, kind) for v, (_, kind) in zip(row, columns, strict=True))})" for k, found in enumerate(per_case) for row in found]
    return f"SELECT d.doc_id, {', '.join('v.' + name for name, _ in columns)} FROM documents d JOIN (VALUES {', '.join(rows)}) AS v(k, {', '.join(name for name, _ in columns)}) ON d.doc_id % {len(per_case)} = v.k"


def constant(names: str, rows: list[tuple]) -> str:
    """SQL for rows that no table is needed for."""
    columns = [part.split() for part in names.split(", ")]
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(_literal(v, kind) for v, (_, kind) in zip(row, columns, strict=True)) + ')' for row in rows)}) AS v({', '.join(name for name, _ in columns)})"


def cases(spark: SparkSession, sf_dir: str, texts: list, name: str = "text") -> DataFrame:
    """``doc_id, text`` with the text of each document's case."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id"))
    return docs.select("doc_id", F.element_at(F.array(*map(F.lit, texts)), (F.col("doc_id") % len(texts) + 1).cast("int")).alias(name))


def drawn(spark: SparkSession, sf_dir: str, texts: list) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(lines, destinations, declarations)`` of maps by case."""
    found, units = route_map.lines_of(cases(spark, sf_dir, texts)), units_table(spark, decompose(SCHEMA))
    return found, route_map.destinations(found, units), route_map.declarations(found, units)


# --- schemas and units

RICH = {
    "type": "object",
    "description": "A record",
    "properties": {
        "when": {"type": "string", "format": "date", "description": "Day: of entry"},
        "state": {"anyOf": [{"type": "string", "enum": ["open", "", "shut"]}, {"type": "string", "format": "date"}], "enum": ["open"]},
        "work": {"type": ["array", "null"], "description": "Work\nof hers", "items": {"type": "object", "required": ["firm", "parts"], "properties": {"firm": {"type": "string", "x-verbatim": 0.8}, "whole": {"type": "string", "x-override": "parts"}, "parts": {"type": "array", "items": {"type": "object", "properties": {"title": {"type": "string", "description": "T", "x-verbatim": True}}}}}}},
        "tags": {"type": "array", "items": {"type": "object", "properties": {"tag": {"type": "string"}}}},
    },
}


@query(
    constant(
        "path VARCHAR, kinds VARCHAR, branches BIGINT, options VARCHAR, format VARCHAR, label VARCHAR, ratio DOUBLE",
        [
            ("when", "string", 1, "", "date", "Day", None),
            ("state", "", 2, "open|shut|date", None, None, None),
            ("work", "array|null", 1, "", None, None, None),
            ("work.firm", "string", 1, "", None, "", 0.8),
            ("work.whole", "string", 1, "", None, "", None),
            ("work.parts", "array", 1, "", None, None, None),
            ("work.parts.title", "string", 1, "", None, "T", 1.0),
            ("tags", "array", 1, "", None, None, None),
            ("tags.tag", "string", 1, "", None, "", None),
        ],
    )
)
def schema_fields(spark, sf_dir):
    found = [(path, "|".join(sorted(t for t in schemas.types(p) if t)), len(schemas.branches(p)), "|".join(schemas.options(p)), schemas.value_format(p), schemas.label(p), schemas.copy_ratio(p)) for path, p in schemas.fields(RICH)]
    return spark.createDataFrame(found, "path string, kinds string, branches long, options string, format string, label string, ratio double")


@query(
    constant(
        "path VARCHAR, parent VARCHAR, header VARCHAR, card VARCHAR, fields VARCHAR, required VARCHAR, less VARCHAR, gives VARCHAR",
        [
            ("work", None, "[work | array] Work", "[work | array] Work\n  of hers\n  per item: firm · whole", "firm,whole", "firm", "[work | array] Work\n  of hers\n  per item: whole", "parts:whole"),
            ("work.parts", "work", "[work.parts | array]", "[work.parts | array]\n  per item: title T", "title", None, "[work.parts | array]\n  per item:", ""),
            ("tags", None, "[tags | array]", "[tags | array]\n  per item: tag", "tag", None, "[tags | array]\n  per item:", ""),
            ("$misc", None, "[$misc | scalar] when Day: of entry(date) · state", "[$misc | scalar] when Day: of entry(date) · state", "when,state", None, "[$misc | scalar] state", ""),
        ],
    )
)
def unit_cards(spark, sf_dir):
    """Cards and contracts, also less each unit's first field, and what gives way to what."""
    units = decompose(RICH)
    rows = []
    for unit in units:
        lifted = {u.field for u in units if u.parent == unit.path}
        required = unit.contract.get("required")
        rows.append((unit.path, unit.parent, unit.header, unit.card, ",".join(unit.fields), None if required is None else ",".join(required), stripped(unit, {next(iter(unit.fields))}).card, ";".join(f"{k}:{','.join(sorted(v))}" for k, v in sorted(yields(unit, lifted).items()))))
    return spark.createDataFrame(rows, "path string, parent string, header string, card string, fields string, required string, less string, gives string")


@query(
    constant(
        "head VARCHAR, overall VARCHAR, shown VARCHAR, missing VARCHAR",
        [("JSON Schema:", "A record", '{"description": "@verbatim", "type": "string"}', "the card lacks the slots ['card']")],
    )
)
def prompt_parts(spark, sf_dir):
    """What a model sees of a schema, and a template that lacks a slot."""
    head = schemas.head(RICH)
    shown = json.loads(head.split("\n", 1)[1])["properties"]["work"]["items"]["properties"]
    assert shown["whole"] == {"type": "string"} and shown["parts"]["items"]["properties"]["title"]["description"] == "T @verbatim"
    try:
        schemas.require_slots("no {slot}", ["card"], "the card")
        missing = ""
    except ValueError as error:
        missing = str(error)
    return spark.createDataFrame([(head.split("\n")[0], schemas.instruction(RICH), json.dumps(shown["firm"], sort_keys=True), missing)], "head string, overall string, shown string, missing string")


@query(
    constant(
        "text VARCHAR, concurrency BIGINT, calls DOUBLE, tokens DOUBLE, burst DOUBLE, share BIGINT, fault BOOLEAN",
        [("8", 8, None, None, 1.0, 2, False), ("10|rpm:120|tpm:600|burst:0", 10, 2.0, 10.0, 0.0, 2, False), ("4|rps:3|tps:9", 4, 3.0, 9.0, 1.0, 1, False), *((t, None, None, None, None, None, True) for t in ("rps:1", "0", "8|rpm:1|rps:1", "8|tpm:1|tps:1", "8|x:1", "a"))],
    )
)
def quotas(spark, sf_dir):
    """Quotas, what one of four tasks has of their concurrency, and texts that are none."""
    rows = []
    for said in ("8", "10|rpm:120|tpm:600|burst:0", "4|rps:3|tps:9", "rps:1", "0", "8|rpm:1|rps:1", "8|tpm:1|tps:1", "8|x:1", "a"):
        try:
            q = parse_quota(said)
            rows.append((said, q.concurrency, q.calls_per_second, q.tokens_per_second, q.burst, q.share(4).concurrency, False))
        except ValueError:
            rows.append((said, None, None, None, None, None, True))
    return spark.createDataFrame(rows, "text string, concurrency long, calls double, tokens double, burst double, share long, fault boolean")


# --- values


@query("SELECT conv_id, turn, length(text) + length(CAST(turn AS VARCHAR)) + 8 AS chars, 2 AS n, text AS second FROM conversations")
def value_sizes(spark, sf_dir):
    """Characters of a value's leaves, a list at a path, and an entry of it."""
    rows = table(spark, sf_dir, "conversations")
    data = rows.select("conv_id", "turn", "text", F.to_json(F.struct(F.struct(F.array(F.lit(True), F.lit(None).cast("boolean")).alias("flags"), "turn").alias("meta"), "text")).alias("v"))
    # Nulls of a struct are left out of its JSON, those of an array are not: four characters each for true and null.
    listed = F.to_json(F.struct(F.struct(F.array(F.lit(""), F.col("text")).alias("parts")).alias("a")))
    return data.select("conv_id", "turn", json_values.value_chars("v").alias("chars"), F.size(json_values.list_at(listed, "a.parts")).cast("int").alias("n"), json_values.at(listed, "a.parts[1]").alias("second"))


@query(
    expected(
        "is_patch BOOLEAN, no_fix BOOLEAN, value VARCHAR, failed BOOLEAN",
        [
            [(True, False, '{"a":[1,2,3]}', False)],
            [(True, True, '{"a":[1,2]}', False)],
            [(False, False, '{"b":1}', False)],
            [(True, False, None, True)],
            [(True, False, '{"a":[1]}', False)],
            [(True, False, '{"a":[1,2],"b":1}', False)],
            [(False, False, None, True)],
        ],
    )
)
def patch_forms(spark, sf_dir):
    """Replies to a request for a patch of ``{"a": [1, 2]}``: patches, none needed, a whole value, and what fails."""
    replies = ['[{"op":"add","path":"/a/-","value":3}]', "[]", '{"b":1}', '[{"op":"remove","path":"/c"}]', '[{"op":"move","from":"/a/0","path":"/a/0"}]', '[{"op":"copy","from":"/a/0","path":"/unit/b"},{"op":"test","path":"/b","value":1}]', "no json"]
    rows = cases(spark, sf_dir, replies, "reply")
    kinds = spark.createDataFrame([(r, json_values.is_patch(_read(r)), json_values.is_no_fix(_read(r))) for r in replies], "reply string, is_patch boolean, no_fix boolean")
    patched = json_values.apply_patch(F.lit('{"a":[1,2]}'), F.col("reply"), F.lit("unit"))
    return rows.withColumn("p", patched).join(F.broadcast(kinds), "reply").select("doc_id", "is_patch", "no_fix", F.col("p.value").alias("value"), F.col("p.error").isNotNull().alias("failed"))


def _read(reply: str):
    try:
        return json.loads(reply)
    except ValueError:
        return None


# --- maps

SPELLINGS = ["b", "b.2", "b.1-3", "b.1-b.3", "b.0.c.1", "b.0.roles.0-2", "b.0.1", "d.0.4", "b.1,c.0-1", "a", "-", "c.0", "b.0,-", "a.1", "q", "b.3-1", "b.0.x.1", "b.0,b.0", "d.0,b.0-1"]


@query(
    expected(
        "code VARCHAR, item_lo BIGINT, item_hi BIGINT, parent BIGINT, ranged BOOLEAN, wrong BOOLEAN",
        [
            [("b", 0, 0, None, False, False)],
            [("b", 2, 2, None, False, False)],
            [("b", 1, 3, None, True, False)],
            [("b", 1, 3, None, True, False)],
            [("c", 1, 1, 0, False, False)],
            [("c", 0, 2, 0, False, False)],
            [("c", 1, 1, 0, False, False)],
            [("d", 0, 0, None, False, False)],
            [("b", 1, 1, None, False, False), ("c", 0, 1, 1, False, False)],
            [("a", None, None, None, False, False)],
            [("-", None, None, None, False, False)],
            [(None, None, None, None, None, True)],
            [("b", 0, 0, None, False, False), (None, None, None, None, None, True)],
            *[[(None, None, None, None, None, True)]] * 4,
            [("b", 0, 0, None, False, False)],
            [("d", 0, 0, None, False, False), ("b", 0, 1, None, False, False)],
        ],
    )
)
def map_spellings(spark, sf_dir):
    """One line a map, its destination in every spelling."""
    _, dests, _ = drawn(spark, sf_dir, [f"0-1 {s}" for s in SPELLINGS])
    right = F.col("error").isNull()
    return dests.select("doc_id", *(F.when(right, F.col(c)).alias(c) for c in ("code", "item_lo", "item_hi", "parent", "ranged")), (~right).alias("wrong"))


@query(
    expected(
        "code VARCHAR, parent BIGINT, n BIGINT, source VARCHAR, budget VARCHAR, zeros VARCHAR",
        [
            [("b", None, 2, None, "50%,300", "d")],
            [("b", None, 2, None, "", "d"), ("c", 0, 3, None, "", "d")],
            [("b", None, 1, None, "", "d"), ("c", 0, 5, None, "", "d")],
            [("b", None, 1, None, "", ""), ("d", None, None, "b", "", "")],
            [("b", None, 5, None, "20x3", "d")],
            [("a", None, 1, None, "", "b,d")],
        ],
    )
)
def map_counts(spark, sf_dir):
    """Declarations in every form, with well-formed parts of budgets, and the repeating units that a map leaves out."""
    found, dests, told = drawn(spark, sf_dir, ["0 b.0\nb: 2 @50%, 300 x", "0 b.0\nb: 2\nb.0.c: 3", "0 b.0\nb: 1\nb.0.c.4: 1\nb.0.roles.2: 1", "0 b.0\nb: 1\nd = b", "0 b.0\nb: 2\nb: 5 @20x3", "0 a\na: 1"])
    zero = route_map.zero_counts(told.where("false"), told.select("doc_id", "code").unionByName(hints.drawn_pairs(dests).select("doc_id", "code")), ["b", "d"], found)
    silent = zero.join(told.select("doc_id", "code").unionByName(dests.select("doc_id", "code")), ["doc_id", "code"], "left_anti").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("code")), ",").alias("zeros"))
    tokens = F.array_join(budgets.declared(F.coalesce("budget", F.lit(""))), ",")
    return told.join(silent, "doc_id", "left").select("doc_id", "code", "parent", "n", "source", tokens.alias("budget"), F.coalesce("zeros", F.lit("")).alias("zeros"))


@query(
    expected(
        "item BIGINT, chars BIGINT",
        [[(0, 50), (1, 25), (2, 12)], [(0, 40), (1, 30), (2, 30)], [(0, 20), (1, 20), (2, 20)], [(0, 70), (1, 70), (2, 70)], [(0, 100), (1, 8), (2, 25)]],
    )
)
def arranged_budgets(spark, sf_dir):
    """Budgets of three items with material of 100, 50 and 25: a share, a short list, words to share out, a number, a mixed list."""
    _, dests, told = drawn(spark, sf_dir, [f"0 b.0\n1 b.1\n2 b.2\nb: 3 @{b}" for b in ("50%", "40,30", "20x3", "70", "100%,2x4,25")])
    material = route_map.claims(dests).select("doc_id", "code", "item", F.element_at(F.array(F.lit(100.0), F.lit(50.0), F.lit(25.0)), F.col("item").cast("int") + 1).alias("material"))
    return route_map.resolved_budgets(told, material).select("doc_id", "item", "chars")


@query(
    expected(
        "line_no INTEGER, line VARCHAR",
        [
            [(0, "0 a"), (1, "1 b.0"), (2, "2 b.0,b.0.c.0"), (3, "3 b.0"), (4, "4 b.1,d.0"), (5, "5 -"), (6, "b: 2 @50%"), (7, "b.0.c: 1"), (8, "d: 1")],
            [(0, "0-1 a"), (1, "2-5 b.0-3"), (2, "b: 4")],
            [(0, "0-3 b.0"), (1, "4-5 -"), (2, "b: 1"), (3, "d = b")],
        ],
    )
)
def redrawn_maps(spark, sf_dir):
    """Maps drawn anew from their chunks: neighbours share a line, chains stand after their hosts."""
    _, dests, told = drawn(spark, sf_dir, ["0 a\n4 b.1,d.0\n1-3 b.0\n2 b.0.c.0\n5 -\nb: 2 @50% x\nb.0.c: 1\nd: 1", "0 a\n1 a\n2-5 b.0-3\nb: 4", "0-1 b.0\n2-3 b.0\n4-5 -\nb: 1\nd = b"])
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(6).cast("long").alias("size"))
    return route_map.redrawn(route_map.assignments(dests), told, docs)


@query(
    expected(
        "unit VARCHAR, item BIGINT, item_lo BIGINT, item_hi BIGINT, chunks VARCHAR",
        [
            [("b", 0, None, None, "0,1"), ("b", 0, None, None, "4"), ("b", 1, None, None, "2,3")],
            [("b", None, 0, 3, "0,1,2"), ("b", 4, None, None, "3"), ("d", None, None, None, "4")],
        ],
    )
)
def routed_groups(spark, sf_dir):
    """Groups of consecutive chunks by destination; a range is one group."""
    _, dests, _ = drawn(spark, sf_dir, ["0-1 b.0\n2-3 b.1\n4 b.0", "0-2 b.0-3\n3 b.4\n4 d"])
    points = route_map.assignments(dests).withColumn("unit", F.col("code")).withColumn("item", F.when(F.col("code") != "d", F.col("item")))
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("chunk_id")).withColumn("text", F.col("chunk_id").cast("string"))
    found = execution.groups(points.select("doc_id", "unit", "parent", "item", "chunk_id", "item_lo", "item_hi"), chunks)
    return found.select("doc_id", "unit", "item", "item_lo", "item_hi", F.replace("text", F.lit("\n"), F.lit(",")).alias("chunks"))


@query(
    expected(
        "rule VARCHAR, detail VARCHAR, message VARCHAR, passable BOOLEAN",
        [
            [("items differ from the count", "c 0 1", 'c 0 1: drawn items are not 0 up to the count; go on with "1-5 b.0.c.0", or the count is wrong: say what the document holds', True)],
            [("not covered", "3 4", 'no line has chunks 3 4; go on with "1-4 b.0", or give them "-"; an earlier round had mended this: do so once more', False)],
            [("not covered", "3 4", 'no line has chunks 3 4; you took out "2-4 d.0", which had them: put it back, unless they belong elsewhere', False)],
            [("overlap", "2 3", 'the line of chunks 2 3 begins before one that precedes it has ended; take out "1-4 b.1.c.0", whose parts these lines are', False), ("parent without a line", "b 1", "b 1: an instance with entries has no line of its own", False)],
            [],
        ],
    )
)
def said_errors(spark, sf_dir):
    """What is said of broken maps with nested entries, with what would mend them, and whether counts alone are wrong."""
    found, dests, told = drawn(spark, sf_dir, ["0 a\n1-5 b.0\n1-2 b.0.c.0\n3-5 b.0.c.1\nb: 1\nb.0.c: 1", "0 a\n1-2 b.0\n5 -\nb: 1", "0 a\n1-2 b.0,d.0\n5 -\nb: 1\nd: 1", "0 a\n1-4 b.1.c.0\n2-3 b.1.c.0\n5 b.0\nb: 1\nb.1.c: 1", "0-5 -"])
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(6).cast("long").alias("size"))
    wrong = route_map.errors(found, units_table(spark, decompose(SCHEMA)), docs)
    case = F.col("doc_id") % 5
    removed = docs.where(case == 2).select("doc_id", F.lit(2).cast("long").alias("start"), F.lit(4).cast("long").alias("end"), F.lit("2-4 d.0").alias("line"))
    past = docs.where(case == 1).select("doc_id", F.explode(F.array(F.struct(F.lit(0).alias("round"), F.lit("not covered").alias("rule"), F.lit("3 4").alias("detail")), F.struct(F.lit(1).alias("round"), F.lit("overlap").alias("rule"), F.lit("1 2").alias("detail")))).alias("x")).select("doc_id", "x.*")
    loose = hints.passable(wrong).withColumn("passable", F.lit(True))
    said = hints.messages(wrong, dests, told, removed, past)
    return said.join(loose, "doc_id", "left").select("doc_id", "rule", "detail", "message", F.coalesce("passable", F.lit(False)).alias("passable"))


@query(
    expected(
        "line_no BIGINT, line VARCHAR",
        [
            [(0, "0 a"), (1, "1 b.0,d.0"), (2, "2 -"), (3, "b: 1"), (4, "d: 1")],
            [(0, "0 a"), (1, "1-2 b.0"), (2, "1 b.0.c.0"), (3, "b: 1"), (4, "b.0.c: 1")],
            [(0, "0 a"), (1, "1-2 b.0"), (2, "b: 1")],
        ],
    )
)
def map_replies(spark, sf_dir):
    """A diff, chains alone, and a reply that says nothing of a map, each applied to the same map."""
    replies = cases(spark, sf_dir, ["- 1-2 b.0\n+ 1 b.0,d.0\n2 -\n+ d: 1\n- 9 x\n+ 9 x", "1 b.0.c.0\nb.0.c: 1", "fine"])
    base = route_map.lines_of(cases(spark, sf_dir, ["0 a\n1-2 b.0\nb: 1"]))
    signed = route_map.edits(replies)
    changes = signed.unionByName(route_map.overlays(replies.join(signed.select("doc_id").distinct(), "doc_id", "left_anti"), base).select(*signed.columns))
    return route_map.applied(base, route_map.net_edits(changes)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


@query(
    expected(
        "code VARCHAR, span BIGINT, n BIGINT, nested VARCHAR",
        [[("b", 20, 2, None)], [("d", 16, 10, None)], [(None, None, None, "c 0 3 2")], [("b", 9, 1, None)], []],
    )
)
def lazy_maps(spark, sf_dir):
    """Units that look lazily drawn or guessed, and nested entries that share a line."""
    _, dests, told = drawn(spark, sf_dir, ["0-19 b.0,b.1\nb: 2", "0-3 b.0\n4 b.1\n5-20 d.0-9\nb: 2\nd: 10", "0 b.0\n1-3 b.0.c.0,b.0.c.1\nb: 1\nb.0.c: 2", "0-8 b.0\n1 b.0.c.0\nb: 1\nb.0.c: 1", "0-3 b.0\n4-7 b.1\nb: 2"])
    flat = hints.split_hints(hints.shared_runs(dests, told)).select("doc_id", "code", "span", "n", F.lit(None).cast("string").alias("nested"))
    none = F.lit(None)
    deep = hints.merged_nested(dests, told).select("doc_id", none.cast("string").alias("code"), none.cast("long").alias("span"), none.cast("long").alias("n"), F.concat_ws(" ", "code", *(F.col(c).cast("string") for c in ("parent", "chunks", "n"))).alias("nested"))
    return flat.unionByName(deep)


@query(
    expected(
        "line_no INTEGER, line VARCHAR",
        [[(0, "0 a"), (1, "1-5 b.0-4"), (2, "6-10 b.5-9"), (3, "11 -"), (4, "b: 10")], []],
    )
)
def adopted_blocks(spark, sf_dir):
    """Ten instances in one run are cut into two blocks; a line of another unit within the run keeps its map as it is."""
    found, dests, _ = drawn(spark, sf_dir, ["0 a\n1-10 b.0-9\n11 -\nb: 10", "0 a\n1-10 b.0-9\n4 d.0\n11 -\nb: 10\nd: 1"])
    plans = table(spark, sf_dir, "documents").select("doc_id", F.lit("b").alias("code"), F.lit(1).cast("long").alias("start"), F.lit(10).cast("long").alias("end"), F.lit(10).cast("long").alias("items"), F.lit(2).cast("long").alias("blocks"))
    return hints.adopted_blocks(found, dests, plans)[0]


# --- recounts and replies


@query(
    expected(
        "label VARCHAR, n BIGINT, quotes VARCHAR",
        [[("b", 2, "Acme|Beta"), ("d", 0, "")], [("b.0.c", 1, "Clerk of hers")], []],
    )
)
def fresh_claims(spark, sf_dir):
    """What a fresh count says, quotes against a zero, by units and by nested entries."""
    found = recounts.claims_of(cases(spark, sf_dir, ["b: 0\n- Acme\n2. Beta\nd: 0", "b.0.c: 1\n* Clerk of hers", "none at all"]))
    return found.select("doc_id", "label", "n", F.array_join("quotes", "|").alias("quotes"))


@query(
    expected(
        "forms VARCHAR, beginnings VARCHAR, bare VARCHAR",
        [
            [("Alpha beta", "", "Alpha beta")],
            [("[3] Acme is|Acme is", "", "[3] Acme is")],
            [("one two three four", "one two three four|one two three", "one two three four")],
            [("甲 乙丙", "甲 乙丙", "甲 乙丙")],
        ],
    )
)
def quote_forms(spark, sf_dir):
    """What is sought for a quote, the beginnings that are long enough, and the line without its mark."""
    rows = cases(spark, sf_dir, ['1. "Alpha   beta"', "[3] Acme is", "- one two\\n three four", "* 甲 乙丙"], "q")
    forms = recounts.seek_forms(F.col("q"))
    first = F.get(forms, F.lit(0))
    return rows.select("doc_id", F.array_join(forms, "|").alias("forms"), F.array_join(recounts.beginnings(first), "|").alias("beginnings"), text.one_spaced(F.regexp_replace(F.replace(text.unmarked(F.col("q")), F.lit("\\n"), F.lit(" ")), '"', "")).alias("bare"))


@query(
    expected(
        "chunk_id BIGINT, code VARCHAR, item BIGINT, parent BIGINT",
        [[(0, "b", 0, None), (1, "b", 0, None), (2, "b", 1, None), (2, "c", 0, 1), (3, "b", 1, None), (4, "b", 1, None), (5, "d", 0, None)], [(0, "b", 0, None), (1, "b", 0, None), (2, "b", 0, None), (3, "d", 0, None)]],
    )
)
def resplit_chains(spark, sf_dir):
    """A merged unit split at chunks 0 and 2: a chain on its parent's chunk follows it, a stranded one goes; the other map has no anchors."""
    _, dests, _ = drawn(spark, sf_dir, ["0-3 b.0\n2 b.0.c.0\n4 b.0.c.1\n5 d.0", "0-2 b.0\n3 d.0"])
    found = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select("doc_id", F.explode(F.array(F.lit(0), F.lit(2)).cast("array<bigint>")).alias("chunk_id"))
    return recounts.resplit(route_map.assignments(dests), found, "b").select("doc_id", "chunk_id", "code", "item", "parent")


@query("SELECT doc_id, chunk_id, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN chunk_id >= 4 THEN 1 ELSE 0 END ELSE 0 END AS item FROM documents, (SELECT unnest(range(8)) AS chunk_id) WHERE doc_id % 3 = 0 AND chunk_id BETWEEN 1 AND 5 OR doc_id % 3 = 1 AND chunk_id = 1 OR doc_id % 3 = 2 AND chunk_id >= 3")
def laid_entries(spark, sf_dir):
    """Eight chunks of a parent given to entries at anchors: up to the next section, to the anchor alone, or to the end."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    put = lambda by_case: docs.select("doc_id", F.explode(F.element_at(F.array(*(F.array(*map(F.lit, c)).cast("array<bigint>") for c in by_case)), (F.col("doc_id") % 3 + 1).cast("int"))).alias("chunk_id"))
    return recounts.lay_entries(put([range(8)] * 3), put([[1, 4], [1], [3]]), put([[4, 6], [], [3]]))


# --- calls and repairs


@query(
    expected(
        "path VARCHAR, remedy VARCHAR, data VARCHAR, broken BOOLEAN, no_fix BOOLEAN, feedback VARCHAR",
        [
            [("jobs", "patch", "[1,2]", False, False, '["m","n\\nhow"]')],
            [("jobs[3].roles", "fresh", "[5]", False, False, '["m","n\\nhow"]')],
            [("jobs", "full", "7", False, False, '["m","n\\nhow"]')],
            [("jobs", "patch", "[1]", False, True, '["m","n\\nhow"]')],
            [("jobs", "patch", "[1]", True, False, '["m","n\\nhow"]')],
        ],
    )
)
def remedied_calls(spark, sf_dir):
    """How calls are asked again, what comes of their replies, and what is told with the last message."""
    rows = cases(spark, sf_dir, ["[1]", "[]", "", "[1]", "[1]"], "data").withColumn("data", F.nullif("data", F.lit(""))).withColumns({"broken": F.lit(False), "unit": F.when(F.col("doc_id") % 5 == 1, "jobs.roles").otherwise("jobs"), "parent": F.when(F.col("doc_id") % 5 == 1, F.lit(3).cast("long"))})
    replies = ['[{"op":"add","path":"/-","value":2}]', "[5]", "7", "[]", '[{"op":"remove","path":"/9"}]']
    rows = rows.withColumn("reply", F.element_at(F.array(*map(F.lit, replies)), (F.col("doc_id") % 5 + 1).cast("int")))
    found = corrections.replied(corrections.remedies(rows))
    told = corrections.feedback(F.array(F.lit("m"), F.lit("n")), F.lit("how"))
    return found.select("doc_id", execution.value_path(F.col("unit"), F.col("parent")).alias("path"), "remedy", "data", "broken", "no_fix", told.alias("feedback"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'parts' END AS siblings FROM documents WHERE doc_id % 3 = 0")
def overridden_fields(spark, sf_dir):
    """A call of two items whose entries are routed for both, for one, or for none."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    calls = docs.select("doc_id", F.lit(0).cast("long").alias("call_seq"), F.lit("work").alias("unit"), F.lit(None).cast("long").alias("item"), F.array(F.lit(0), F.lit(1)).cast("array<bigint>").alias("batch"))
    none = F.lit(None).cast("long")
    own = docs.select("doc_id", F.lit("work").alias("unit"), none.alias("parent"), F.explode(F.array(F.lit(0), F.lit(1)).cast("array<bigint>")).alias("item"))
    entries = docs.select("doc_id", F.lit("work.parts").alias("unit"), F.explode(F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(0), F.lit(1))).when(F.col("doc_id") % 3 == 1, F.array(F.lit(0))).cast("array<bigint>")).alias("parent"), F.lit(0).cast("long").alias("item"))
    return execution.overridden(calls, own.unionByName(entries), {"work": {"parts": ["whole"]}}).select("doc_id", F.array_join("siblings", ",").alias("siblings"))


@query(
    """WITH t AS (SELECT conv_id AS doc_id, turn, role FROM conversations)
SELECT doc_id, turn AS call_seq, 'jobs[' || turn || '].a,jobs[' || turn || '].b' AS paths, 'jobs[' || turn || '].b: host|jobs[' || turn || '].a: copy' AS messages FROM t WHERE turn % 2 = 1"""
)
def routed_issues(spark, sf_dir):
    """Two issues a turn from two sources, with their messages in the order of the sources; those of even turns are reported alone."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn")
    none = F.lit(None).cast("long")
    calls = rows.select("doc_id", F.col("turn").alias("call_seq"), F.lit("jobs").alias("unit"), none.alias("parent"), F.lit("per-item").alias("strategy"), F.col("turn").alias("item"), F.lit(None).cast("array<bigint>").alias("batch"))
    issue = lambda field, said, origin: corrections.issue_rows(rows.select("doc_id", F.concat(F.lit("jobs["), F.col("turn").cast("string"), F.lit(f"].{field}")).alias("path"), F.lit(said).alias("message"), (F.col("turn") % 2 == 0).alias("report_only")), origin)
    made = corrections.produced(calls, calls.select("doc_id", "call_seq", F.lit("{}").alias("data")))
    found = corrections.routed(issue("a", "copy", 1).unionByName(issue("b", "host", 0)), calls, made)
    return found.select("doc_id", "call_seq", F.array_join("paths", ",").alias("paths"), F.array_join("messages", "|").alias("messages"))


# --- runners


class Echo:
    """Says of a request what it was, and judges an output by its length."""

    def run(self, *, instructions, contract, content, scope="", history=None, feedback=None):
        if contract.get("required") == ["ok", "reason"]:
            return {"ok": len(content) % 2 == 0, "reason": "even" if len(content) % 2 == 0 else "odd"}, None
        if content.endswith("7"):
            raise ValueError("seven")
        return [scope, (history or 0) + 1], {"told": feedback}, 3


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 7 THEN NULL ELSE '[\"' || doc_id || '\", 3]' END AS data, CASE WHEN doc_id % 10 = 7 THEN NULL ELSE '{\"told\": [\"m\"]}' END AS history, CASE WHEN doc_id % 10 = 7 THEN 'ValueError: seven' END AS error FROM documents")
def asked_rows(spark, sf_dir):
    """A request a document under a quota; a runner that fails fails that request alone."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    rows = docs.select("doc_id", F.lit("k").alias("call_key"), F.lit("do").alias("instructions"), F.lit("{}").alias("contract"), F.col("doc_id").cast("string").alias("content"), F.col("doc_id").cast("string").alias("scope"), F.lit("2").alias("history"), F.lit('["m"]').alias("feedback"))
    return ask(rows, Echo, parse_quota(8)).select("doc_id", "data", "history", "error")


@query("SELECT doc_id, (length(lang) + length(source) + 28) % 2 = 0 AS ok, CASE WHEN (length(lang) + length(source) + 28) % 2 = 0 THEN 'even' ELSE 'odd' END AS reason FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def judged_cases(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("lang is not null and source is not null").select("doc_id", F.col("lang").alias("source"), F.col("source").alias("output"))
    return judged(rows, "all is well", Echo)


class Reader:
    """Draws a map by what the parts say, first without their end, and reads a number from its material."""

    def run(self, *, instructions, contract, content, scope="", history=None, feedback=None):
        if contract == {"type": "string"}:
            parts = content.count("\n") + 1
            if feedback:
                return f"+ {parts - 1} -", history
            return "0 a\n" + "".join(f"{n} b.{n - 1}\n" for n in range(1, parts - 1)) + f"b: {max(parts - 2, 0)}\nd: 0", {"drawn": parts}
        if feedback:
            return [{"op": "replace", "path": "/name", "value": "mended"}], history
        if "[basic |" in instructions:
            return {"name": scope}, {}
        found = [{"company": line} for line in scope.replace("\n\n", "\n").split("\n")]
        return (found if contract.get("type") == "array" else found[0]), {}


EXTRACTED = ["first line of it\nAcme and Sons here\nthe last one, longer than others", "only a name\nand its end, longer than the name", "lead\nBeta\nGamma works\nDelta of the north\nlast line, which is the longest of all"]


@query(
    expected(
        "data VARCHAR, map VARCHAR, calls BIGINT, rounds BIGINT, issues BIGINT",
        [
            [('{"basic":{"name":"mended"},"jobs":[{"company":"Acme and Sons here"}]}', "0 a\n1 b.0\n2 -\nb: 1\nd: 0", 2, 1, 0)],
            [('{"basic":{"name":"only a name"}}', "0 a\n1 -\nb: 0\nd: 0", 1, 0, 0)],
            [('{"basic":{"name":"lead"},"jobs":[{"company":"Beta"},{"company":"Gamma works"},{"company":"Delta of the north"}]}', "0 a\n1 b.0\n2 b.1\n3 b.2\n4 -\nb: 3\nd: 0", 4, 0, 0)],
        ],
    )
)
def extracted_documents(spark, sf_dir):
    """Extraction from end to end: maps are mended once, values read, and one name is repaired."""
    docs = cases(spark, sf_dir, EXTRACTED)

    def names(data):
        return data.where(F.get_json_object("data", "$.basic.name").startswith("first")).select("doc_id", F.lit("basic.name").alias("path"), F.lit("is no name").alias("message"))

    found = extraction.extract(docs, SCHEMA, Reader, names, extraction.ExtractionConfig(batch_cap=1))
    count = lambda rows, name: rows.groupBy("doc_id").agg(F.count("*").alias(name))
    out = found.data.join(found.maps, "doc_id", "left").join(count(found.calls, "calls"), "doc_id", "left").join(count(found.corrections, "rounds"), "doc_id", "left").join(count(found.issues, "issues"), "doc_id", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "data", "map", *(F.coalesce(c, zero).alias(c) for c in ("calls", "rounds", "issues")))


@query("SELECT doc_id, CAST(round_even((2 * length(text) + 100) / 1.6, 0) AS BIGINT) AS tokens, CASE WHEN doc_id % 2 = 0 THEN 'missing' END AS label FROM documents WHERE text IS NOT NULL")
def router_tokens(spark, sf_dir):
    """The tokens that a routing call is thought to take (its text counts twice), and labels of verdicts."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    line = F.when(F.col("doc_id") % 2 == 0, "Missing:").otherwise("Missed:")
    return docs.select("doc_id", text.estimate_tokens(F.col("text"), F.col("text"), F.lit("x" * 100)).alias("tokens"), verdicts.verdict_label(line).alias("label"))


@query("SELECT conv_id AS doc_id, turn, CASE WHEN turn < 2 THEN 10 * (turn + 1) ELSE 20 END AS budget, turn AS place FROM conversations")
def spread_budgets(spark, sf_dir):
    """A short list's last budget goes on, and budgets of items that were put in another order."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn")
    told = F.array(F.lit(10), F.lit(20))
    order = F.sequence(F.lit(0), F.col("turn").cast("int"))
    moved = evals.realigned(F.transform(order, lambda i: i), F.reverse(order))
    return rows.select("doc_id", "turn", budgets.at_item(told, F.col("turn")).alias("budget"), F.get(moved, F.lit(0)).alias("place"))


@query("SELECT doc_id, 'a = [basic | object]' AS first_card, 4 AS cards FROM documents")
def routing_prompts(spark, sf_dir):
    """The legend that a router sees."""
    shown = routing.legend(decompose(SCHEMA))
    heads = [line for line in shown.split("\n") if " = [" in line]
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return docs.select("doc_id", F.lit(heads[0]).alias("first_card"), F.lit(len(heads)).alias("cards"))
