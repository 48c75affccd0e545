"""Routing in rounds: a runner draws the map of each document, code checks it, and what is wrong is asked again.

All documents go through a round together. Each round is a stage of calls whose replies are kept, so the
plan of a round begins at a table. The number of rounds is small and fixed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import estimate_tokens, one_spaced
from siltstone.operators import budgets, hints, intervals, recounts, route_map
from siltstone.plans.quota import Quota
from siltstone.plans.units import Unit, code, name_list
from siltstone.sources.runner import Runner, ask
from siltstone.sources.shared import kept

#: One drawing and four repairs.
ROUNDS = 5

INSTRUCTIONS = """You route the numbered parts of a document to the units below. Answer with one line for each run of
parts, `<start>-<end> <code>`, and code lines for counts. A repeating unit's instances are numbered over the
whole document: `<code>.<n>`. Entries nested in an instance are `<code>.<n>.<code>.<n>`. Parts that concern no
unit take `-`. Every part is in a line and no two lines overlap. Then, for each repeating unit,
`<code>: <count>`, and for entries under an instance `<code>.<n>.<code>: <count>`; a unit that repeats
another's text takes `<code> = <code>`. Counts may end in a budget, `@<chars>`, `@<percent>%` or
`@<chars>x<words>`.
Units:
{legend}
Parts:
{parts}"""
REPAIR = "Answer with the lines to take out, each after `-`, and the lines to put in, each after `+`."
RECOUNT = """RECOUNT. Look afresh for instances of the units below alone. Answer with a line for each run of parts that holds
one, `<start>-<end> <code>.<n>`, and nothing else. If there is none, answer with `none`.
Units:
"""
OPENINGS = """RECOUNT. Instances of the units below were drawn as one. Count them afresh: for each unit a line `<code>: <count>`,
and under it how each instance begins, one a line, in the words of the parts and in their order. A unit named
`<code>.<n>.<code>` is meant under that one instance alone, whose own heading is none of its entries.
Units:
"""
SHARED = "If the parts can tell these units' instances apart, draw a line for each and count them. If they can't, answer with nothing."
CUT = "Draw these runs in the blocks that are given. If a block would cut an instance in two, answer with nothing."


def legend(units: list[Unit]) -> str:
    """A card a unit by code; lists of single strings are told to be budgeted by words."""
    marks = {True: "\n  (a list of words: its budget is @<chars>x<words>)", False: ""}
    return "\n".join(f"{code(n)} = {unit.card}{marks[name_list(unit)]}" for n, unit in enumerate(units))


def listing(chunks: DataFrame) -> DataFrame:
    """``doc_id, parts, size``: numbered parts, line breaks shown by a sign."""
    line = F.concat(F.lit("["), F.col("chunk_id").cast("string"), F.lit("] "), F.replace("text", F.lit("\n"), F.lit(" ¶ ")))
    rows = F.sort_array(F.collect_list(F.struct("chunk_id", line.alias("line"))))
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("parts"), F.count("*").alias("size"))


def _requests(rows: DataFrame, instructions: Column, feedback: Column, history: Column, number: int) -> DataFrame:
    return rows.select("doc_id", F.lit(f"route-{number}").alias("call_key"), instructions.alias("instructions"), F.lit('{"type": "string"}').alias("contract"), F.col("content"), F.lit("").alias("scope"), history.alias("history"), feedback.alias("feedback"))


def _text(reply: Column) -> Column:
    return F.coalesce(F.from_json(F.concat(F.lit('{"t":'), reply, F.lit("}")), "t string")["t"], F.lit(""))


def route(documents: DataFrame, chunks: DataFrame, units: list[Unit], table: DataFrame, factory: Callable[[], Runner], rounds: int = ROUNDS, instructions: str = INSTRUCTIONS, quota: Quota | None = None, lead: str = "", recount_instructions: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(lines, errors)``: the settled lines of each document's map, and what is wrong with maps that did not settle.

    ``table`` is the units as a table. A document that fails its call has no lines and an error.
    """
    parts = kept(listing(chunks).join(documents.select("doc_id", F.col("text").alias("content")), "doc_id"), "parts")
    none = F.lit(None).cast("string")
    told = lead + instructions.replace("{legend}", legend(units))
    first = F.replace(F.lit(told), F.lit("{parts}"), F.col("parts"))
    # The parts say the text once more, so it counts twice.
    tokens = estimate_tokens(F.col("content"), F.col("content"), F.lit(told))
    replies = kept(ask(_requests(parts, first, none, none, 0).join(parts.select("doc_id", tokens.alias("tokens")), "doc_id"), factory, quota), "routes")
    sizes = parts.select("doc_id", "size").join(replies.where("error is null").select("doc_id"), "doc_id", "left_semi")
    failed = replies.where("error is not null").select("doc_id", F.lit("call failed").alias("rule"), F.col("error").alias("detail"))
    lines = kept(route_map.lines_of(replies.where("error is null").select("doc_id", _text(F.col("data")).alias("text"))), "lines")
    history = replies.select("doc_id", "history")
    wrong = route_map.errors(lines, table, sizes)
    past, removed = wrong.withColumn("round", F.lit(0)), None
    for number in range(1, rounds):
        if wrong.isEmpty():
            break
        dests, told = route_map.destinations(lines, table), route_map.declarations(lines, table)
        said = hints.messages(wrong, dests, told, removed, past.where(F.col("round") < number))
        asked = said.groupBy("doc_id").agg(F.to_json(F.concat(F.transform(F.array_sort(F.collect_list(F.struct("rule", "detail", "message"))), lambda e: e["message"]), F.array(F.lit(REPAIR)))).alias("feedback"))
        changed, history = _answered(asked, lines, parts, history, factory, quota, number)
        taken = lines.join(changed.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "line").exceptAll(changed.select("doc_id", "line")).where(F.col("line").rlike(route_map.MAP_LINE))
        start = F.regexp_extract("line", route_map.MAP_LINE, 1).cast("long")
        removed = kept(taken.select("doc_id", start.alias("start"), F.coalesce(F.nullif(F.regexp_extract("line", route_map.MAP_LINE, 2), F.lit("")).cast("long"), start).alias("end"), "line"), "removed")
        lines = kept(_replaced(lines, changed), "lines")
        wrong = route_map.errors(lines, table, sizes)
        past = past.unionByName(wrong.withColumn("round", F.lit(number)))
    # Maps that are right but for counts pass with what they draw; a map's drawing is the better reading.
    loose = hints.passable(wrong)
    settled = kept(lines.join(wrong.select("doc_id").distinct().join(loose, "doc_id", "left_anti"), "doc_id", "left_anti"), "settled")
    right = settled.join(wrong.select("doc_id").distinct(), "doc_id", "left_anti")
    wrong = wrong.join(loose, "doc_id", "left_anti")
    better, history = reshaped(kept(right, "right"), chunks, parts, sizes, table, history, factory, quota)
    settled = kept(_replaced(settled, better), "settled")
    settled = recounted(settled, parts, sizes, table, factory, quota, recount_instructions, codes=[code(n) for n, u in enumerate(units) if u.kind == "array" and u.parent is None])
    return settled, wrong.unionByName(failed)


def _replaced(lines: DataFrame, new: DataFrame) -> DataFrame:
    """Lines, those of some documents by new ones."""
    old = lines.select("doc_id", F.col("line_no").cast("int").alias("line_no"), "line")
    return old.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new.select("doc_id", F.col("line_no").cast("int").alias("line_no"), "line"))


def _valid(new: DataFrame, table: DataFrame, sizes: DataFrame) -> DataFrame:
    """Those of some maps that break no rule."""
    wrong = route_map.errors(new, table, sizes.join(new.select("doc_id").distinct(), "doc_id", "left_semi"))
    return kept(new.join(wrong.select("doc_id").distinct(), "doc_id", "left_anti"), "lines")


def _answered(asked: DataFrame, lines: DataFrame, parts: DataFrame, history: DataFrame, factory: Callable[[], Runner], quota: Quota | None, number: int) -> tuple[DataFrame, DataFrame]:
    """``(lines, history)`` after feedback ``(doc_id, feedback)``: changed maps alone, and all conversations.

    A reply with signs is a diff, one of chains alone joins the map, a blank one declines, and any other is a new map.
    """
    rows = kept(asked.join(parts.select("doc_id", "content"), "doc_id").join(history, "doc_id"), "asked")
    if rows.isEmpty():
        return lines.where("false"), history
    replies = kept(ask(_requests(rows, F.lit(""), F.col("feedback"), F.col("history"), number), factory, quota), "routes")
    told = replies.where("error is null").select("doc_id", _text(F.col("data")).alias("text")).where(F.trim("text") != "")
    signed = route_map.edits(told)
    plain = told.join(signed.select("doc_id").distinct(), "doc_id", "left_anti")
    changes = kept(signed.select("doc_id", "line_no", "sign", "line").unionByName(route_map.overlays(plain, lines)), "changes")
    patched = route_map.applied(lines.join(changes.select("doc_id").distinct(), "doc_id", "left_semi"), route_map.net_edits(changes))
    whole = route_map.lines_of(told.join(changes.select("doc_id").distinct(), "doc_id", "left_anti"))
    new = kept(patched.unionByName(whole.select("doc_id", "line_no", "line")), "lines")
    later = replies.where("error is null").select("doc_id", F.col("history").alias("later"))
    return new, kept(history.join(later, "doc_id", "left").select("doc_id", F.coalesce("later", "history").alias("history")), "history")


def reshaped(lines: DataFrame, chunks: DataFrame, parts: DataFrame, sizes: DataFrame, table: DataFrame, history: DataFrame, factory: Callable[[], Runner], quota: Quota | None = None) -> tuple[DataFrame, DataFrame]:
    """``(lines, history)``: of right maps those that are drawn better now, and all conversations.

    Dense runs are cut into blocks by code. Units whose instances look merged, and nested entries that share a line,
    are counted in a conversation of its own; quotes are sought in the chunks, and the map is drawn anew at them. What
    neither way can do is asked about once. A map that would break a rule stays as it was.
    """
    dests, told = kept(route_map.destinations(lines, table), "destinations"), kept(route_map.declarations(lines, table), "declarations")
    points = kept(route_map.assignments(dests), "points")
    shared = kept(hints.shared_runs(dests, told), "shared")
    by_code = budgets.material(points.select("doc_id", F.col("code").alias("unit"), "item", "chunk_id"), chunks)
    resolved = route_map.resolved_budgets(told, by_code.withColumnRenamed("unit", "code")).withColumnRenamed("code", "unit")
    plans = kept(hints.block_plans(shared, dests, by_code, resolved), "plans")
    cut, left = hints.adopted_blocks(lines, dests, plans)
    cut = _valid(kept(cut, "cut"), table, sizes)
    split = kept(hints.split_hints(shared), "split")
    nested = kept(hints.merged_nested(dests, told), "nested")
    counted = recut(lines.join(cut.select("doc_id").distinct(), "doc_id", "left_anti"), dests, told, points, split, nested, chunks, parts, sizes, table, factory, quota)
    done = cut.unionByName(counted)
    # What is left is asked in the map's own conversation.
    lines_of_plans = hints.block_lines(intervals.even_blocks(left.withColumn("doc_id", F.struct("doc_id", "code")), F.col("blocks")).withColumn("code", F.col("doc_id.code"))).select("doc_id.doc_id", "doc_id.code", "block", "line")
    shown = lines_of_plans.groupBy("doc_id", "code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "line"))), lambda r: r["line"]), "\n").alias("blocks"))
    cuts = shown.select("doc_id", "code", F.concat_ws("\n", F.concat("code", F.lit(":")), "blocks", F.lit(CUT)).alias("message"))
    splits = split.join(left.select("doc_id", "code"), ["doc_id", "code"], "left_anti").select("doc_id", "code", F.concat("code", F.lit(": "), F.col("span").cast("string"), F.lit(" chunks for "), F.col("n").cast("string"), F.lit(" instances. "), F.lit(SHARED)).alias("message"))
    open_ = cuts.unionByName(splits).join(done.select("doc_id").distinct(), "doc_id", "left_anti")
    asked = open_.groupBy("doc_id").agg(F.to_json(F.concat(F.transform(F.array_sort(F.collect_list(F.struct("code", "message"))), lambda m: m["message"]), F.array(F.lit(REPAIR)))).alias("feedback"))
    drawn, history = _answered(asked, lines, parts, history, factory, quota, ROUNDS)
    return kept(done.unionByName(_valid(drawn, table, sizes).select(*done.columns)), "lines"), history


def recut(lines: DataFrame, dests: DataFrame, told: DataFrame, points: DataFrame, split: DataFrame, nested: DataFrame, chunks: DataFrame, parts: DataFrame, sizes: DataFrame, table: DataFrame, factory: Callable[[], Runner], quota: Quota | None = None) -> DataFrame:
    """Lines of maps that are drawn anew at the openings that a fresh count quotes.

    ``split (doc_id, code)`` are merged units, ``nested (doc_id, code, parent)`` merged entries; labels tell them apart
    as a map does. A merged unit's chunks go to the instances that its quotes begin; entries are only ever trimmed: a
    count of more than are drawn lets them stand.
    """
    cards = F.broadcast(table.select("code", F.col("card"), "parent_code"))
    flat = split.join(lines.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "code", F.lit(None).cast("long").alias("parent"))
    deep = nested.join(lines.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "code", "parent")
    wanted = flat.unionByName(deep).join(cards, "code")
    label = F.when(F.col("parent").isNull(), F.col("code")).otherwise(F.concat_ws(".", "parent_code", F.col("parent").cast("string"), "code"))
    wanted = kept(wanted.select("doc_id", "code", "parent", "parent_code", label.alias("label"), F.substring_index("card", "\n", 1).alias("header")), "wanted")
    if wanted.isEmpty():
        return lines.where("false")
    listed = wanted.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" = ", "label", "header"))), "\n").alias("legend"))
    none = F.lit(None).cast("string")
    rows = listed.join(parts, "doc_id")
    request = _requests(rows, F.concat(F.lit(OPENINGS), F.col("legend")), none, none, ROUNDS + 1).join(rows.select("doc_id", F.array(F.concat(F.lit("Parts:\n"), F.col("parts"))).alias("prompt_parts")), "doc_id")
    replies = kept(ask(request, factory, quota), "routes")
    claims = kept(recounts.claims_of(replies.where("error is null").select("doc_id", _text(F.col("data")).alias("text"))).join(wanted, ["doc_id", "label"]), "claims")
    texts = chunks.select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), "text")
    opens = chunks.where("opens_section").select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"))
    # One merged unit a document: the first by code. Others keep their lines, and may be asked about.
    first = claims.where("parent is null").withColumn("at", F.row_number().over(Window.partitionBy("doc_id").orderBy("code"))).where("at = 1")
    usable = first.where((F.col("n") > 0) & (F.col("n") == F.size("quotes")))
    quotes = usable.select("doc_id", "code", F.posexplode("quotes").alias("quote_no", "quote"))
    new_points, new_told = points, told
    changed = usable.select("doc_id").where("false")
    for unit in sorted(r.code for r in usable.select("code").distinct().collect()):
        mine = points.where(((F.col("code") == unit) & F.col("parent").isNull()) | F.coalesce(F.col("parent_code") == unit, F.lit(False))).select("doc_id", "chunk_id").distinct()
        found = kept(recounts.anchors(quotes.where(F.col("code") == unit), mine.join(texts, ["doc_id", "chunk_id"])).select("doc_id", "chunk_id"), "anchors")
        split_points = recounts.resplit(new_points, found, unit)
        new_points = kept(_with_ranges(split_points, new_points.join(found.select("doc_id").distinct(), "doc_id", "left_anti")), "points")
        counts = found.groupBy("doc_id").agg(F.count("*").alias("new"))
        new_told = kept(_recounted_told(new_told, new_points, counts, unit), "told")
        changed = changed.unionByName(counts.select("doc_id"))
    trimmed = claims.where("parent is not null")
    if not trimmed.isEmpty():
        new_points, new_told, also = _trimmed(trimmed, new_points, new_told, texts, opens)
        changed = changed.unionByName(also).distinct()
    changed = kept(changed, "changed")
    drawn = route_map.redrawn(new_points.join(changed, "doc_id", "left_semi"), new_told.join(changed, "doc_id", "left_semi"), sizes.join(changed, "doc_id", "left_semi"))
    return _valid(kept(drawn.select("doc_id", F.col("line_no").cast("int").alias("line_no"), "line"), "lines"), table, sizes)


def _with_ranges(points: DataFrame, untouched: DataFrame) -> DataFrame:
    """Points with the ends of ranges where they were left as they are."""
    none = F.lit(None).cast("long")
    moved = points.join(untouched.select("doc_id").distinct(), "doc_id", "left_anti").withColumns({"item_lo": none, "item_hi": none})
    return moved.unionByName(untouched.select(*moved.columns))


def _recounted_told(told: DataFrame, points: DataFrame, counts: DataFrame, unit: str) -> DataFrame:
    """Declarations with a unit's new count, and with counts of nested entries as they are now drawn."""
    met = told.join(counts, "doc_id", "left")
    mine = (F.col("code") == unit) & F.col("parent").isNull() & F.col("new").isNotNull()
    flat = met.where(~(F.coalesce(F.col("parent_code") == unit, F.lit(False)) & F.col("new").isNotNull())).withColumn("n", F.when(mine, F.col("new")).otherwise(F.col("n"))).drop("new")
    drawn = points.where(F.col("parent_code") == unit).join(counts.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id", "code", "parent_code", "parent").agg(F.countDistinct("item").alias("n"))
    text = F.lit(None).cast("string")
    deep = drawn.withColumns({"source": text, "budget": text, "line_no": F.lit(0)})
    return flat.unionByName(deep.select(*flat.columns))


def _trimmed(claims: DataFrame, points: DataFrame, told: DataFrame, texts: DataFrame, opens: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(points, told, documents)`` with merged entries laid anew at their quotes, or taken out where a fresh count finds none."""
    keys = ["doc_id", "code", "parent"]
    footprint = points.join(claims.select(*keys), keys).select(*keys, "parent_code", "chunk_id").distinct()
    quotes = claims.select(*keys, "n", F.posexplode_outer("quotes").alias("quote_no", "quote"))
    forms = recounts.seek_forms(F.col("quote"))
    body = footprint.join(texts, ["doc_id", "chunk_id"]).select(*keys, "chunk_id", one_spaced(F.col("text")).alias("body"))
    hits = quotes.where("quote is not null").join(body, keys).where(F.exists(forms, lambda f: F.contains(F.col("body"), f))).groupBy(*keys, "quote_no").agg(F.min("chunk_id").alias("chunk_id"))
    found = hits.select(*keys, "chunk_id").distinct()
    drawn = told.where("parent_code is not null").select("doc_id", "code", "parent", F.col("n").alias("drawn"))
    per = claims.select(*keys, "n").join(found.groupBy(*keys).agg(F.count("*").alias("k")), keys, "left").join(drawn, keys, "left")
    k = F.coalesce("k", F.lit(0))
    fit = kept(per.where(((k > 0) & (k <= F.coalesce("drawn", F.lit(0)))) | ((k == 0) & (F.col("n") == 0))).select(*keys, k.alias("k")), "fit")
    case = F.struct(*keys)
    laid = recounts.lay_entries(footprint.join(fit.where("k > 0"), keys, "left_semi").select(case.alias("doc_id"), "chunk_id"), found.join(fit, keys, "left_semi").select(case.alias("doc_id"), "chunk_id"), footprint.join(opens, ["doc_id", "chunk_id"], "left_semi").select(case.alias("doc_id"), "chunk_id"))
    host = footprint.select(*keys, "parent_code").distinct()
    entries = laid.select("doc_id.*", "chunk_id", "item").join(host, keys)
    rest = points.join(fit.select(*keys), keys, "left_anti")
    # Chunks that no entry has any more are the parent's own.
    bare = footprint.join(fit, keys, "left_semi").join(entries, [*keys, "chunk_id"], "left_anti").select("doc_id", F.col("parent_code").alias("code"), F.col("parent").alias("item"), "chunk_id")
    none = F.lit(None).cast("long")
    own = bare.join(rest.where("parent is null").select("doc_id", "code", "item", "chunk_id"), ["doc_id", "code", "item", "chunk_id"], "left_anti").withColumns({"parent_code": F.lit(None).cast("string"), "parent": none, "item_lo": none, "item_hi": none})
    new = entries.withColumns({"item_lo": none, "item_hi": none})
    points = kept(rest.unionByName(own.select(*rest.columns)).unionByName(new.select(*rest.columns)).distinct(), "points")
    met = told.join(fit, keys, "left")
    told = kept(met.where("k is null or k > 0").withColumn("n", F.coalesce("k", "n")).drop("k").select(*told.columns), "told")
    return points, told, fit.select("doc_id").distinct()


def recounted(lines: DataFrame, parts: DataFrame, sizes: DataFrame, table: DataFrame, factory: Callable[[], Runner], quota: Quota | None = None, instructions: str | None = None, codes: list[str] | None = None) -> DataFrame:
    """Lines after one fresh count of units that a map declares empty, or declares and does not draw.

    The count begins without history, so that a first answer is no anchor. Its lines join the map on chunks
    that belonged to no unit. A unit whose lines all fall on what other units have, and whose count is that of one
    other repeating unit alone, says that one's material over again. A map that would then be wrong stays as it is.
    """
    dests, told = route_map.destinations(lines, table), route_map.declarations(lines, table)
    if codes is not None:
        # A repeating unit that a map does not mention reads as zero.
        blank = route_map.zero_counts(told.where("false"), told.select("doc_id", "code").unionByName(hints.drawn_pairs(dests).select("doc_id", "code")), codes, lines).select("doc_id", "code", F.col("n").cast("long").alias("n"))
        silent = blank.join(dests.select("doc_id", "code"), ["doc_id", "code"], "left_anti").join(told.select("doc_id", "code"), ["doc_id", "code"], "left_anti")
        zero = silent.withColumns({c: F.lit(None).cast(told.schema[c].dataType) for c in told.columns if c not in ("doc_id", "code", "n")})
        told = told.unionByName(zero.select(*told.columns))
    open_ = hints.pending_zeros(told, table).unionByName(hints.undrawn(told, dests).select("doc_id", "code")).distinct()
    cards = F.broadcast(table.select("code", "card"))
    rows = open_.join(cards, "code").groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(" = ", "code", "card"))), "\n").alias("legend"))
    asked = kept(rows.join(parts, "doc_id"), "recounts")
    if asked.isEmpty():
        return lines
    none = F.lit(None).cast("string")
    text = F.concat(F.lit(instructions or RECOUNT), F.col("legend"), F.lit("\nParts:\n"), F.col("parts"))
    replies = kept(ask(_requests(asked, text, none, none, ROUNDS), factory, quota), "routes")
    answer = route_map.lines_of(replies.where("error is null").select("doc_id", _text(F.col("data")).alias("text")))
    added = kept(recounts.spliced(dests, route_map.destinations(answer, table)), "answers")
    lines_added = answer.join(added.select("doc_id", "line_no").distinct(), ["doc_id", "line_no"], "left_semi")
    own_codes = added.select("doc_id", F.coalesce("parent_code", "code").alias("code")).distinct()
    arrays = F.broadcast(table.where("kind = 'array' and parent_code is null").select("code"))
    claimed = route_map.destinations(answer, table).where("error is null and parent_code is null and item_hi is not null").join(open_, ["doc_id", "code"], "left_semi").join(arrays, "code", "left_semi").groupBy("doc_id", "code").agg((F.max("item_hi") + 1).alias("n"))
    crossed = claimed.join(own_codes, ["doc_id", "code"], "left_anti")
    others = told.where("n > 0 and source is null and parent_code is null").join(arrays, "code", "left_semi").select("doc_id", "n", F.col("code").alias("other"))
    alike = crossed.join(others, ["doc_id", "n"]).where("other <> code").groupBy("doc_id", "code").agg(F.count("*").alias("k"), F.first("other").alias("other")).where("k = 1")
    mirrors = kept(alike.select("doc_id", "code", F.concat_ws(" = ", "code", "other").alias("line")), "mirrors")
    codes = own_codes.unionByName(mirrors.select("doc_id", "code"))
    counted = added.where("item_hi is not null and parent_code is null").groupBy("doc_id", "code").agg((F.max("item_hi") + 1).alias("n"))
    # The drawing without the chunks that are now given, then the new lines and their counts.
    taken = intervals.expand(added.select("doc_id", "start", "end")).distinct()
    left = intervals.expand(dests.where("code = '-'").select("doc_id", "start", "end")).distinct().join(taken, ["doc_id", "chunk_id"], "left_anti")
    spare = intervals.runs(left.join(codes.select("doc_id").distinct(), "doc_id", "left_semi"), ["doc_id"])
    span = F.concat(F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit(" -"))
    old = lines.join(codes.select("doc_id").distinct(), "doc_id", "left_semi").where(~F.col("line").rlike(r"^\d+(\s*-\s*\d+)?\s+-$"))
    head = F.regexp_extract("line", route_map.COUNT, 1)
    old = old.withColumn("code", head).join(counted.select("doc_id", "code").unionByName(mirrors.select("doc_id", "code")), ["doc_id", "code"], "left_anti").drop("code")
    pieces = [old.select("doc_id", F.when(F.col("line").rlike(route_map.MAP_LINE), 0).otherwise(2).alias("part"), F.col("line_no").cast("long").alias("at"), "line"), lines_added.select("doc_id", F.lit(0).alias("part"), (F.col("line_no") + 100_000).cast("long").alias("at"), "line").where(F.col("line").rlike(route_map.MAP_LINE)), spare.select("doc_id", F.lit(1).alias("part"), "start", span).toDF("doc_id", "part", "at", "line"), counted.select("doc_id", F.lit(3).alias("part"), F.lit(0).cast("long").alias("at"), F.concat_ws(": ", "code", F.col("n").cast("string")).alias("line")), mirrors.select("doc_id", F.lit(4).alias("part"), F.lit(0).cast("long").alias("at"), "line")]
    order = Window.partitionBy("doc_id").orderBy("part", "at", "line")
    new = kept(reduce(DataFrame.unionByName, pieces).withColumn("line_no", F.row_number().over(order) - 1).select("doc_id", "line_no", "line"), "lines")
    wrong = route_map.errors(new, table, sizes.join(new.select("doc_id").distinct(), "doc_id", "left_semi")).select("doc_id").distinct()
    good = kept(new.join(wrong, "doc_id", "left_anti"), "lines")
    return lines.select("doc_id", "line_no", "line").join(good.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(good)


def routed_items(lines: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(assignments, counts)``: what is mapped where (``doc_id, unit, parent, item, chunk_id``), and how many instances are declared by value path.

    Items of a range that stands alone on its line have its ends as ``item_lo, item_hi``. Units that mirror a source
    have its items.
    """
    dests, told = route_map.destinations(lines, table), route_map.declarations(lines, table)
    paths = F.broadcast(table.select("code", "path", "field", "parent_path"))
    rows = route_map.assignments(dests).join(paths, "code").select("doc_id", F.col("path").alias("unit"), "parent", "item", "chunk_id", "item_lo", "item_hi")
    mirrors = told.where("source is not null").join(paths.select("code", F.col("path").alias("unit")), "code").join(F.broadcast(table.select(F.col("code").alias("source"), F.col("path").alias("source_path"))), "source").select("doc_id", F.col("unit").alias("mirror"), F.col("source_path").alias("unit"))
    copied = rows.join(mirrors, ["doc_id", "unit"]).select("doc_id", F.col("mirror").alias("unit"), "parent", "item", "chunk_id", "item_lo", "item_hi")
    every = rows.unionByName(copied)
    own = hints.drawn_counts(told.where("source is null"), dests).join(paths, "code")
    key = F.when(F.col("parent").isNull(), F.col("path")).otherwise(F.concat("parent_path", F.lit("["), F.col("parent").cast("string"), F.lit("]."), "field"))
    arrays = F.broadcast(table.where("kind = 'array'").select("code"))
    counts = own.join(arrays, "code", "left_semi").select("doc_id", key.alias("path"), F.col("n").alias("declared"))
    derived = counts.join(mirrors.select("doc_id", F.col("unit").alias("path"), "mirror"), ["doc_id", "path"]).select("doc_id", F.col("mirror").alias("path"), "declared")
    return every, counts.unionByName(derived)


def spans_of(lines: DataFrame) -> DataFrame:
    """For traces: the settled map of each document as text."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    return lines.withColumn("n", F.row_number().over(order)).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda r: r["line"]), "\n").alias("map"))
