"""The routing map: a line language from chunk ranges to units, parsed, checked, rendered and edited as tables.

Map lines are ``<start>[-<end>] <dest>[,<dest>..]``; a destination is a unit's code, ``code.item``,
``code.lo-hi``, or a chain ``code.item.sub.item`` into a nested unit. Declarations are ``code: n [@budget]``,
``code.item.sub: n [@budget]`` and ``code = source``. ``lines`` have ``doc_id, line_no, line``.

Only the units table is broadcast; it is as small as the schema. Every other join and window is on the document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import strip
from siltstone.operators import budgets, intervals
from siltstone.sources.shared import discard, kept

#: The forms of lines and destinations.
MAP_LINE = r"^(\d+)(?:\s*-\s*(\d+))?\s+(\S.*)$"
COUNT = r"^([a-z]+)\s*:\s*(\d+)\s*(@.*)?$"
CHAIN_COUNT = r"^([a-z]+)\.(\d+)\.([A-Za-z_]\w*)\s*:\s*(\d+)\s*(@.*)?$"
ENTRY_COUNT = r"^([a-z]+)\.(\d+)\.([A-Za-z_]\w*)\.(\d+)\s*:\s*(\d+)\s*(@.*)?$"
DERIVED = r"^([a-z]+)\s*=\s*([a-z]+)\s*(@.*)?$"
BARE, ITEM = r"^([a-z]+)$", r"^([a-z]+)\.(\d+)(?:-(?:([a-z]+)\.)?(\d+))?$"
CHAIN = r"^([a-z]+)\.(\d+)\.([A-Za-z_]\w*)\.(\d+)(?:-(?:\w+\.)?(\d+))?$"
TAIL = r"^([a-z]+)\.(\d+)\.(\d+)(?:\.\d+)*$"

LINES = "doc_id long, line_no int, line string"


def lines_of(replies: DataFrame) -> DataFrame:
    """Stripped lines of ``replies (doc_id, text)`` that are not blank."""
    split = F.filter(F.transform(F.split("text", "\n"), strip), lambda x: x != "")
    return replies.select("doc_id", F.posexplode(split).alias("line_no", "line"))


def _part(column: str, pattern: str, group: int, kind: str = "long") -> Column:
    found = F.nullif(F.regexp_extract(column, pattern, group), F.lit(""))
    return found if kind == "string" else found.cast(kind)


def destinations(lines: DataFrame, units: DataFrame) -> DataFrame:
    """A row a destination: doc_id, line_no, start, end, pos, code, item_lo, item_hi, parent_code, parent, ranged, error.

    Spellings are made one: a bare array is its item 0, a nested unit may be named by its field, ``c.0.0`` is a
    chain if the unit has one nested array and item 0 else (further numbers say nothing), an end that repeats the code
    is a number, and a nested unit without its parent (``b.0,c.0-2``) hangs under the one instance of that parent on
    its line.
    """
    mapped = lines.where(F.col("line").rlike(MAP_LINE))
    start = _part("line", MAP_LINE, 1)
    rows = mapped.select("doc_id", "line_no", start.alias("start"), F.coalesce(_part("line", MAP_LINE, 2), start).alias("end"), F.split(_part("line", MAP_LINE, 3, "string"), r"\s*,\s*").alias("tokens"))
    tokens = rows.select("doc_id", "line_no", "start", "end", F.size("tokens").alias("n"), F.posexplode("tokens").alias("pos", "token"))
    read = tokens.select(
        "*",
        F.coalesce(*(_part("token", p, 1, "string") for p in (BARE, ITEM, CHAIN, TAIL))).alias("code"),
        F.coalesce(_part("token", ITEM, 2), _part("token", CHAIN, 2), _part("token", TAIL, 2)).alias("first"),
        F.coalesce(_part("token", ITEM, 4), F.lit(None).cast("long")).alias("last"),
        _part("token", CHAIN, 3, "string").alias("sub"),
        F.coalesce(_part("token", CHAIN, 4), _part("token", TAIL, 3)).alias("sub_first"),
        _part("token", CHAIN, 5).alias("sub_last"),
        F.col("token").rlike(TAIL).alias("tail"),
    )
    small = F.broadcast(units.select("code", "kind", F.col("parent_path").alias("under"), F.col("parent_code").alias("under_code")))
    nested = units.where("parent_code is not null").select(F.col("parent_code").alias("owner"), F.col("code").alias("sub_code"), "field")
    only = nested.groupBy("owner").agg(F.count("*").alias("n_nested"), F.min("sub_code").alias("only_nested"))
    joined = read.join(small, "code", "left").join(F.broadcast(nested), (F.col("owner") == F.col("code")) & ((F.col("sub_code") == F.col("sub")) | (F.col("field") == F.col("sub"))), "left").drop("owner", "field")
    joined = joined.join(F.broadcast(only), F.col("owner") == F.col("code"), "left").drop("owner")
    # Instances on the same line that could be the parent of a nested unit which names none.
    single = F.col("under").isNull() & (F.col("kind") == "array") & F.col("sub").isNull() & F.col("last").isNull() & ~F.col("tail")
    line = Window.partitionBy("doc_id", "line_no")
    joined = joined.withColumn("hosts", F.array_distinct(F.collect_list(F.when(single, F.struct("code", F.coalesce("first", F.lit(0).cast("long")).alias("first")))).over(line)))
    joined = joined.withColumn("hosts", F.filter("hosts", lambda h: h["code"] == F.col("under_code")))
    folded = F.col("under").isNotNull() & F.col("first").isNotNull() & F.col("sub").isNull() & ~F.col("tail") & (F.size("hosts") == 1)
    host = F.get("hosts", F.lit(0))["first"]
    joined = joined.withColumns({"sub_first": F.when(folded, F.col("first")).otherwise(F.col("sub_first")), "sub_last": F.when(folded, F.col("last")).otherwise(F.col("sub_last"))})
    joined = joined.withColumns({"folded": folded, "first": F.when(folded, host).otherwise(F.col("first")), "last": F.when(~folded, F.col("last"))})
    chained = F.when(F.col("folded"), F.col("code")).when(F.col("sub").isNotNull(), F.col("sub_code")).when(F.col("tail") & (F.col("n_nested") == 1), F.col("only_nested"))
    is_chain = F.col("chain_code").isNotNull()
    none = F.lit(None).cast("long")
    error = (
        F.when((F.col("token") == "-") & (F.col("n") > 1), "the sign for no unit stands alone")
        .when(F.col("token") == "-", F.lit(None))
        .when(F.col("code").isNull(), F.concat(F.lit("not a destination: "), "token"))
        .when(F.col("kind").isNull(), F.concat(F.lit("no such unit: "), "code"))
        .when(F.col("sub").isNotNull() & ~is_chain, F.concat(F.lit("no such nested unit: "), "sub"))
        .when(F.col("under").isNotNull() & ~F.col("folded"), F.concat(F.lit("a nested unit is reached through its parent: "), "code"))
        .when((F.col("kind") != "array") & F.col("first").isNotNull(), F.concat(F.lit("a unit that does not repeat has no items: "), "token"))
        .when((F.col("last") < F.col("first")) | (F.col("sub_last") < F.col("sub_first")), F.concat(F.lit("a range runs backwards: "), "token"))
        .when(F.col("end") < F.col("start"), "a range of chunks runs backwards")
    )
    item = F.when(F.col("kind") == "array", F.coalesce("first", F.lit(0).cast("long")))
    out = joined.withColumn("chain_code", chained).select(
        "doc_id",
        "line_no",
        "start",
        "end",
        "pos",
        F.when(is_chain, F.col("chain_code")).when(F.col("token") == "-", "-").otherwise(F.col("code")).alias("code"),
        F.when(is_chain, F.col("sub_first")).otherwise(item).alias("item_lo"),
        F.when(is_chain, F.coalesce("sub_last", "sub_first")).otherwise(F.coalesce("last", item)).alias("item_hi"),
        F.when(F.col("folded"), F.col("under_code")).when(is_chain, F.col("code")).alias("parent_code"),
        F.when(is_chain, F.col("first")).otherwise(none).alias("parent"),
        (F.col("last").isNotNull() & (F.col("n") == 1)).alias("ranged"),
        error.alias("error"),
    )
    # Saying a destination twice on the same chunks says nothing new.
    return out.dropDuplicates(["doc_id", "start", "end", "code", "item_lo", "item_hi", "parent_code", "parent", "error"])


def declarations(lines: DataFrame, units: DataFrame) -> DataFrame:
    """A row a declaration, the last of equal ones: doc_id, code, parent_code, parent, n, source, budget, line_no.

    Entries that are declared one by one count as the highest of them plus one, unless their parent has a count.
    """
    nested = F.broadcast(units.where("parent_code is not null").select(F.col("parent_code").alias("owner"), F.col("code").alias("sub_code"), "field"))
    none, text = F.lit(None).cast("long"), F.lit(None).cast("string")
    rows = lines.where(~F.col("line").rlike(MAP_LINE))

    def pick(pattern: str, code: Column, parent_code: Column, parent: Column, n: Column, source: Column, budget: int, rank: int) -> DataFrame:
        return rows.where(F.col("line").rlike(pattern)).select("doc_id", "line_no", code.alias("name"), parent_code.alias("parent_code"), parent.alias("parent"), n.alias("n"), source.alias("source"), _part("line", pattern, budget, "string").alias("budget"), F.lit(rank).alias("rank"))

    part = lambda p, g, k="long": _part("line", p, g, k)
    flat = pick(COUNT, part(COUNT, 1, "string"), text, none, part(COUNT, 2), text, 3, 1)
    derived = pick(DERIVED, part(DERIVED, 1, "string"), text, none, none, part(DERIVED, 2, "string"), 3, 1)
    chain = pick(CHAIN_COUNT, part(CHAIN_COUNT, 3, "string"), part(CHAIN_COUNT, 1, "string"), part(CHAIN_COUNT, 2), part(CHAIN_COUNT, 4), text, 5, 1)
    entry = pick(ENTRY_COUNT, part(ENTRY_COUNT, 3, "string"), part(ENTRY_COUNT, 1, "string"), part(ENTRY_COUNT, 2), part(ENTRY_COUNT, 4) + 1, text, 6, 0)
    found = reduce(DataFrame.unionByName, (flat, derived, chain, entry))
    named = found.join(nested, (F.col("owner") == F.col("parent_code")) & ((F.col("sub_code") == F.col("name")) | (F.col("field") == F.col("name"))), "left")
    named = named.withColumn("code", F.coalesce("sub_code", "name")).drop("owner", "field", "sub_code", "name")
    order = Window.partitionBy("doc_id", "code", "parent_code", "parent").orderBy(F.desc("rank"), F.when(F.col("rank") == 0, -F.col("n")).otherwise(-F.col("line_no")))
    return named.withColumn("at", F.row_number().over(order)).where("at = 1").drop("at", "rank")


def claims(dests: DataFrame) -> DataFrame:
    """A row for every item that a destination claims."""
    real = dests.where("error is null and code <> '-'")
    return real.withColumn("item", F.explode(F.when(F.col("item_lo").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.sequence("item_lo", "item_hi"))))


def assignments(dests: DataFrame) -> DataFrame:
    """``doc_id, code, item, parent_code, parent, chunk_id`` of everything mapped, each once.

    ``item_lo, item_hi`` are the ends of a range of several items that stands alone on its line, and null for others;
    an item that is claimed both ways is its range's.
    """
    alone = F.col("ranged") & (F.col("item_hi") > F.col("item_lo"))
    rows = claims(dests).withColumns({"item_lo": F.when(alone, F.col("item_lo")), "item_hi": F.when(alone, F.col("item_hi"))})
    points = intervals.expand(rows.select("doc_id", "code", "item", "parent_code", "parent", "start", "end", "item_lo", "item_hi"))
    return points.groupBy("doc_id", "code", "item", "parent_code", "parent", "chunk_id").agg(F.min("item_lo").alias("item_lo"), F.min("item_hi").alias("item_hi"))


def drawn_chunks(dests: DataFrame) -> DataFrame:
    """``doc_id, code, chunk_id``: chunks of each unit, whatever its items, each once."""
    real = dests.where("error is null and code <> '-'")
    return intervals.expand(real.select("doc_id", "code", "start", "end").distinct()).distinct()


def _error(rows: DataFrame, rule: str, *parts) -> DataFrame:
    return rows.select("doc_id", F.lit(rule).alias("rule"), F.concat_ws(" ", *(F.col(p).cast("string") if isinstance(p, str) else p for p in parts)).alias("detail"))


def errors(lines: DataFrame, units: DataFrame, sizes: DataFrame) -> DataFrame:
    """``doc_id, rule, detail`` of all that is wrong with a map; ``sizes (doc_id, size)`` counts the chunks."""
    # Each rule reads these, so they are written once, and deleted when all rules have been applied.
    dests, told = kept(destinations(lines, units), "destinations"), kept(declarations(lines, units), "declarations")
    known = [MAP_LINE, COUNT, CHAIN_COUNT, ENTRY_COUNT, DERIVED]
    unread = lines.where(~reduce(lambda a, b: a | b, (F.col("line").rlike(p) for p in known)))
    first_map = lines.where(F.col("line").rlike(MAP_LINE)).groupBy("doc_id").agg(F.min("line_no").alias("first"))
    early = told.join(first_map, "doc_id", "left").where("line_no < first or first is null")
    wrong = dests.where("error is not null")
    ranges = dests.where("error is null").select("doc_id", "start", "end", "parent_code", "parent", "code").distinct()
    chains = ranges.where("parent_code is not null")
    plain = claims(dests).where("parent_code is null").select("doc_id", "code", "item", "start", "end").distinct()
    inside = intervals.hosted(chains, plain).select("doc_id", "start", "end", "parent_code", "parent", "code")
    standing = ranges.join(inside, ["doc_id", "start", "end", "code", "parent_code", "parent"], "left_anti").select("doc_id", "start", "end").distinct()
    over = intervals.overlaps(standing)
    beyond = ranges.select("doc_id", "start", "end").distinct().join(sizes, "doc_id").where("end >= size")
    bare = intervals.holes(ranges.select("doc_id", "start", "end"), sizes)
    kinds = F.broadcast(units.select("code", "kind"))
    used = claims(dests).select("doc_id", "code", "parent_code", "parent", "item").distinct()
    arrays = told.join(kinds.where("kind = 'array'").select("code"), "code", "left_semi")
    per_unit = used.where("item is not null").groupBy("doc_id", "code", "parent_code", "parent").agg(F.count("*").alias("used"), F.min("item").alias("low"), F.max("item").alias("high"))
    c, u = arrays.where("source is null").alias("c"), per_unit.alias("u")
    same = reduce(lambda a, b: a & b, (F.col(f"c.{k}").eqNullSafe(F.col(f"u.{k}")) for k in ("doc_id", "code", "parent_code", "parent")))
    both = c.join(u, same, "full").select(*(F.coalesce(f"c.{k}", f"u.{k}").alias(k) for k in ("doc_id", "code", "parent_code", "parent")), F.col("c.n").alias("n"), "used", "low", "high")
    unequal = both.where("n is not null and (coalesce(used, 0) <> n or coalesce(high, n - 1) <> n - 1 or coalesce(low, 0) <> 0)")
    orphan = used.where("parent_code is not null").select("doc_id", F.col("parent_code").alias("code"), F.col("parent").alias("item")).distinct().join(used.where("parent_code is null").select("doc_id", "code", "item"), ["doc_id", "code", "item"], "left_anti")
    sources = told.where("source is not null")
    undeclared = both.where("n is null").join(sources.select("doc_id", "code"), ["doc_id", "code"], "left_anti")
    mapped = used.where("parent_code is null").select("doc_id", F.col("code").alias("source")).distinct()
    groundless = sources.join(mapped, ["doc_id", "source"], "left_anti")
    drawn = sources.join(used.select("doc_id", "code").distinct(), ["doc_id", "code"], "left_semi")
    present = told.where("source is null and n > 0 and parent_code is null").join(kinds.where("kind <> 'array'").select("code"), "code", "left_semi").join(used.select("doc_id", "code").distinct(), ["doc_id", "code"], "left_anti")
    twice = claims(dests.where("ranged")).groupBy("doc_id", "code", "item").count().where("count > 1")
    parts = [
        _error(unread, "unread", "line"),
        _error(early, "declared before the map", "code"),
        _error(wrong, "destination", "error"),
        _error(over, "overlap", "start", "end"),
        _error(beyond, "beyond the text", "start", "end"),
        _error(bare, "not covered", "hole_start", "hole_end"),
        _error(undeclared, "not declared", "code", "parent"),
        _error(unequal, "items differ from the count", "code", "parent", "n"),
        _error(orphan, "parent without a line", "code", "item"),
        _error(groundless, "source is not mapped", "code", "source"),
        _error(drawn, "mirrors and is mapped", "code", "source"),
        _error(present, "declared and not mapped", "code"),
        _error(twice, "in two ranges", "code", "item"),
    ]
    found = kept(reduce(DataFrame.unionByName, parts).distinct(), "errors")
    discard(dests, told)
    return found


def zero_counts(told: DataFrame, dests: DataFrame, codes: list[str], docs: DataFrame) -> DataFrame:
    """Counts with a zero for every top-level array (``codes``) that is neither declared nor mapped."""
    every = docs.select("doc_id").distinct().withColumn("code", F.explode(F.array(*map(F.lit, codes)) if codes else F.array().cast("array<string>")))
    seen = told.select("doc_id", "code").unionByName(dests.select("doc_id", "code")).distinct()
    return told.select("doc_id", "code", "n").unionByName(every.join(seen, ["doc_id", "code"], "left_anti").withColumn("n", F.lit(0).cast("long")))


def token(code: Column, lo: Column, hi: Column, parent_code: Column, parent: Column) -> Column:
    """How a destination is written."""
    own = F.when(lo.isNull(), code).when(lo == hi, F.concat_ws(".", code, lo.cast("string"))).otherwise(F.concat(code, F.lit("."), lo.cast("string"), F.lit("-"), hi.cast("string")))
    return F.when(parent_code.isNull(), own).otherwise(F.concat_ws(".", parent_code, parent.cast("string"), own))


def rendered(dests: DataFrame, told: DataFrame) -> DataFrame:
    """``doc_id, text``: the map as text, map lines in order, then declarations. It parses to the same map."""
    rows = F.sort_array(F.collect_list(F.struct("part", "at", "name", "line")))
    return drawn_lines(dests).unionByName(told_lines(told)).groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text"))


def drawn_lines(dests: DataFrame) -> DataFrame:
    """``doc_id, part, at, name, line``: a line for each range of chunks, its hosts before its chains."""
    cell = token(F.col("code"), F.col("item_lo"), F.col("item_hi"), F.col("parent_code"), F.col("parent"))
    by_line = dests.where("error is null").groupBy("doc_id", "start", "end").agg(F.sort_array(F.collect_list(F.struct(F.col("parent_code").isNotNull().alias("chain"), "line_no", "pos", cell.alias("token")))).alias("cells"))
    span = F.when(F.col("start") == F.col("end"), F.col("start").cast("string")).otherwise(F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string")))
    return by_line.select("doc_id", F.lit(0).alias("part"), F.col("start").alias("at"), F.lit("").alias("name"), F.concat(span, F.lit(" "), F.array_join(F.transform("cells", lambda c: c["token"]), ",")).alias("line"))


def told_lines(told: DataFrame) -> DataFrame:
    """``doc_id, part, at, name, line``: a line for each declaration, with its budget's well-formed parts."""
    name = F.when(F.col("parent_code").isNull(), F.col("code")).otherwise(F.concat_ws(".", "parent_code", F.col("parent").cast("string"), "code"))
    value = F.when(F.col("source").isNull(), F.concat(F.lit(": "), F.col("n").cast("string"))).otherwise(F.concat(F.lit(" = "), F.col("source")))
    tokens = budgets.declared(F.coalesce("budget", F.lit("")))
    suffix = F.when(F.size(tokens) > 0, F.concat(F.lit(" @"), F.array_join(tokens, ","))).otherwise("")
    return told.select("doc_id", F.lit(1).alias("part"), F.lit(0).cast("long").alias("at"), name.alias("name"), F.concat(name, value, suffix).alias("line"))


def cover(points: DataFrame, sizes: DataFrame) -> DataFrame:
    """``doc_id, chunk_id, value``: the destinations of every chunk as they are written, chains after their hosts, ``-`` for none.

    ``points`` are as ``assignments`` has them; a range that stands alone stays one destination.
    """
    cell = token(F.col("code"), F.coalesce("item_lo", "item"), F.coalesce("item_hi", "item"), F.col("parent_code"), F.col("parent"))
    cells = points.select("doc_id", "chunk_id", F.struct(F.col("parent_code").isNotNull().alias("chain"), "code", F.coalesce("parent", F.lit(-1).cast("long")).alias("parent"), F.coalesce("item_lo", "item").alias("lo"), cell.alias("token")).alias("cell"))
    by_chunk = cells.groupBy("doc_id", "chunk_id").agg(F.array_sort(F.collect_set("cell")).alias("cells"))
    every = sizes.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)).alias("chunk_id"))
    return every.join(by_chunk, ["doc_id", "chunk_id"], "left").select("doc_id", "chunk_id", F.coalesce(F.array_join(F.transform("cells", lambda c: c["token"]), ","), F.lit("-")).alias("value"))


def redrawn(points: DataFrame, told: DataFrame, sizes: DataFrame) -> DataFrame:
    """``doc_id, line_no, line``: lines of a map that is given chunk by chunk; neighbours of equal destinations share a line."""
    spans = intervals.merged_neighbours(cover(points, sizes), F.col("value"), ["doc_id"])
    span = F.when(F.col("start") == F.col("end"), F.col("start").cast("string")).otherwise(F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string")))
    mapped = spans.select("doc_id", F.lit(0).alias("part"), F.col("start").alias("at"), F.lit("").alias("name"), F.concat_ws(" ", span, "value").alias("line"))
    order = Window.partitionBy("doc_id").orderBy("part", "at", "name")
    return mapped.unionByName(told_lines(told)).withColumn("line_no", F.row_number().over(order) - 1).select("doc_id", "line_no", "line")


def edits(replies: DataFrame) -> DataFrame:
    """``doc_id, sign, line`` of a diff; lines in the map's own language are additions once the reply has a sign at all."""
    lines = lines_of(replies)
    signed = lines.withColumn("sign", F.when(F.col("line").rlike(r"^[-+]\s*\S") & ~F.col("line").rlike(r"^-\s*$"), F.substring("line", 1, 1)))
    grammar = reduce(lambda a, b: a | b, (F.col("line").rlike(p) for p in (MAP_LINE, COUNT, CHAIN_COUNT, DERIVED)))
    any_sign = F.max(F.col("sign").isNotNull()).over(Window.partitionBy("doc_id"))
    kept = signed.withColumn("diff", any_sign).where(F.col("diff") & (F.col("sign").isNotNull() | grammar))
    return kept.select("doc_id", "line_no", F.coalesce("sign", F.lit("+")).alias("sign"), F.when(F.col("sign").isNotNull(), strip(F.substring("line", 2, 1 << 30))).otherwise(F.col("line")).alias("line"))


def overlays(replies: DataFrame, base: DataFrame) -> DataFrame:
    """Changes that a reply without signs means if its map lines are chains alone: they join the map, and its counts take the place of those of the same units.

    A reply with a line that covers anything else is a map of its own. ``base (doc_id, line_no, line)``.
    """
    lines = lines_of(replies)
    chain = F.exists(F.split(_part("line", MAP_LINE, 3, "string"), r"\s*,\s*"), lambda t: F.length(t) - F.length(F.replace(t, F.lit("."), F.lit(""))) >= 2)
    told = reduce(lambda a, b: a | b, (F.col("line").rlike(p) for p in (COUNT, CHAIN_COUNT, ENTRY_COUNT, DERIVED)))
    name = F.when(told, F.regexp_extract("line", r"^([\w.]+)", 1))
    kind = F.when(F.col("line").rlike(MAP_LINE), F.when(chain, "chain").otherwise("cover")).when(told, "count")
    read = lines.withColumn("kind", kind).where("kind is not null")
    fit = read.groupBy("doc_id").agg(F.max(F.col("kind") == "chain").alias("some"), F.max(F.col("kind") == "cover").alias("other")).where("some and not other").select("doc_id")
    added = read.join(fit, "doc_id").select("doc_id", "line_no", F.lit("+").alias("sign"), "line", F.when(F.col("kind") == "count", name).alias("code"))
    old = base.where(~F.col("line").rlike(MAP_LINE)).select("doc_id", "line_no", "line", name.alias("code")).where("code is not null")
    gone = old.join(added.where("code is not null").select("doc_id", "code").distinct(), ["doc_id", "code"]).select("doc_id", "line_no", F.lit("-").alias("sign"), "line")
    return added.drop("code").unionByName(gone)


def net_edits(changes: DataFrame) -> DataFrame:
    """Changes less those that undo each other, copies counted one by one."""
    order = Window.partitionBy("doc_id", "sign", "line").orderBy("line_no")
    numbered = changes.withColumn("copy", F.row_number().over(order))
    other = numbered.select("doc_id", "line", "copy", F.when(F.col("sign") == "+", "-").otherwise("+").alias("sign"))
    return numbered.join(other, ["doc_id", "line", "copy", "sign"], "left_anti").drop("copy")


def applied(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Lines of ``base`` less the removed, with the added that it has not; map lines before declarations, else in order."""
    removed = changes.where("sign = '-'").select("doc_id", "line").distinct()
    kept = base.select("doc_id", "line_no", "line").join(removed, ["doc_id", "line"], "left_anti").withColumn("new", F.lit(0))
    added = changes.where("sign = '+'").groupBy("doc_id", "line").agg(F.min("line_no").alias("line_no")).join(kept, ["doc_id", "line"], "left_anti").withColumn("new", F.lit(1))
    every = kept.unionByName(added.select("doc_id", "line_no", "line", "new"))
    order = Window.partitionBy("doc_id").orderBy(F.when(F.col("line").rlike(MAP_LINE), 0).otherwise(1), "new", "line_no")
    return every.select("doc_id", (F.row_number().over(order) - 1).alias("line_no"), "line")


def resolved_budgets(told: DataFrame, material: DataFrame) -> DataFrame:
    """``doc_id, code, item, chars`` of declared budgets against ``material (doc_id, code, item, material)``.

    One keyword budget for several items is their total and is shared out evenly.
    """
    tokens = told.select("doc_id", "code", budgets.declared(F.col("budget")).alias("tokens")).where(F.size("tokens") > 0)
    items = material.join(tokens, ["doc_id", "code"])
    one = items.withColumn("b", budgets.parsed(budgets.at_item(F.col("tokens"), F.coalesce("item", F.lit(0)))))
    n = F.count("*").over(Window.partitionBy("doc_id", "code"))
    total = budgets.chars(F.col("b"), F.col("material"))
    return one.select("doc_id", "code", "item", F.when((F.col("b.kind") == "kw") & (F.size("tokens") == 1), F.bround(total / n, 0).cast("long")).otherwise(total).alias("chars"))
