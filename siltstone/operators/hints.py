"""What a map that breaks no rule may still have wrong, and what would mend a map that does."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators import intervals
from siltstone.operators.route_map import assignments, claims, token

#: Material of a run that is worth splitting, and characters of one block.
DENSE, BLOCK = 1000, 300
#: Chunks of an instance from which on a run looks lazily drawn, of one that is worth a count, of a
#: range's that looks guessed, and the excess below which none of them counts.
LAZY, WORTH, GUESSED, EXCESS = 4, 8, 1.5, 5


def drawn_pairs(dests: DataFrame) -> DataFrame:
    """Distinct ``doc_id, code, parent`` that a map draws."""
    return dests.where("error is null and code <> '-'").select("doc_id", "code", "parent").distinct()


def pending_zeros(told: DataFrame, units: DataFrame) -> DataFrame:
    """``doc_id, code`` of top-level arrays that are declared to have no instance."""
    arrays = F.broadcast(units.where("kind = 'array' and parent_code is null").select("code"))
    return told.where("n = 0 and source is null").join(arrays, "code", "left_semi").select("doc_id", "code")


def undrawn(told: DataFrame, dests: DataFrame) -> DataFrame:
    """``doc_id, code, n`` declared with instances that no line draws."""
    return told.where("n > 0 and parent_code is null").join(dests.where("error is null").select("doc_id", "code").distinct(), ["doc_id", "code"], "left_anti").select("doc_id", "code", "n")


def chain_fed(dests: DataFrame) -> DataFrame:
    """``doc_id, code, item, chunk_id``: chunks that a parent instance has by its chains."""
    return assignments(dests).where("parent_code is not null").select("doc_id", F.col("parent_code").alias("code"), F.col("parent").alias("item"), "chunk_id").distinct()


def merged_nested(dests: DataFrame, told: DataFrame) -> DataFrame:
    """``doc_id, code, parent, chunks, n``: nested entries that share a line while their parent has more chunks than entries."""
    rows = claims(dests).where("parent_code is not null")
    shared = rows.groupBy("doc_id", "code", "parent", "start", "end").agg(F.countDistinct("item").alias("entries")).where("entries > 1").select("doc_id", "code", "parent").distinct()
    chunks = assignments(dests).where("parent_code is not null").groupBy("doc_id", "code", "parent").agg(F.countDistinct("chunk_id").alias("chunks"))
    counts = told.where("parent_code is not null").select("doc_id", "code", "parent", "n")
    return shared.join(chunks, ["doc_id", "code", "parent"]).join(counts, ["doc_id", "code", "parent"]).where("chunks > n")


def lazy(span: Column, n: Column, load: float = LAZY) -> Column:
    """Whether a run is far longer than its instances."""
    return (span >= n * load) & (span - n >= EXCESS)


def shared_runs(dests: DataFrame, told: DataFrame) -> DataFrame:
    """``doc_id, code, n, span, merged, short_span, short_n``: units whose instances share lines.

    ``span`` counts the chunks of lines that a unit shares with itself (several of its items, a range, or its only
    item) and ``merged`` those of them that a fresh count is worth: ranges, and lines of eight chunks an instance or
    more. ``short_*`` is the first range that looks guessed. Units on lines with chains are left out, but that an only
    instance has the chunks of its chains as well.
    """
    real = dests.where("error is null and code <> '-'")
    plain = real.where("parent_code is null")
    chained = real.where("parent_code is not null").select("doc_id", "start", "end").distinct()
    riding = plain.join(chained, ["doc_id", "start", "end"], "left_semi").select("doc_id", "code").distinct()
    counts = told.where("parent_code is null and n is not null").select("doc_id", "code", "n")
    lines = plain.where("end > start").join(riding, ["doc_id", "code"], "left_anti")
    alone = F.col("ranged") & (F.col("item_hi") > F.col("item_lo"))
    per = lines.groupBy("doc_id", "code", "start", "end").agg(F.count("*").alias("k"), F.max(alone).alias("alone"), F.max(F.when(alone, F.col("item_hi") - F.col("item_lo") + 1)).alias("items"))
    per = per.join(counts, ["doc_id", "code"], "left").withColumn("size", F.col("end") - F.col("start") + 1)
    shared = per.where("n = 1 or alone or k > 1")
    guess = F.when(F.col("alone") & lazy(F.col("size"), F.col("items"), GUESSED), F.struct("start", "size", "items"))
    worth = F.sum(F.when(F.col("alone") | (F.col("size") >= F.col("k") * WORTH), F.col("size")))
    spans = shared.groupBy("doc_id", "code").agg(F.first("n").alias("n"), F.sum("size").alias("span"), worth.alias("merged"), F.min(guess).alias("short"))
    # An only instance with chains.
    points = assignments(dests)
    own = points.where("parent_code is null").select("doc_id", "code", "chunk_id").unionByName(chain_fed(dests).select("doc_id", "code", "chunk_id")).distinct()
    only = own.join(chain_fed(dests).select("doc_id", "code").distinct(), ["doc_id", "code"], "left_semi").join(counts.where("n = 1"), ["doc_id", "code"]).groupBy("doc_id", "code", "n").agg(F.count("*").alias("fed"))
    both = spans.join(only.withColumnRenamed("n", "one"), ["doc_id", "code"], "full")
    merged = F.greatest("merged", F.when(F.col("fed") >= WORTH, F.col("fed")))
    return both.select("doc_id", "code", F.coalesce("n", "one").alias("n"), F.greatest("span", "fed").alias("span"), merged.alias("merged"), F.col("short.size").alias("short_span"), F.col("short.items").alias("short_n"))


def split_hints(shared: DataFrame) -> DataFrame:
    """``doc_id, code, span, n``: units that look lazily drawn, and ranges that look guessed."""
    short = F.col("short_n").isNotNull()
    slow = F.col("merged").isNotNull() & (F.col("n") > 0) & lazy(F.col("merged"), F.col("n"))
    return shared.where(short | slow).select("doc_id", "code", F.when(short, F.col("short_span")).otherwise(F.col("merged")).alias("span"), F.when(short, F.col("short_n")).otherwise(F.col("n")).alias("n"))


def block_plans(shared: DataFrame, dests: DataFrame, material: DataFrame, resolved: DataFrame) -> DataFrame:
    """``doc_id, code, start, end, items, blocks``: dense runs that are worth cutting, and into how many blocks.

    ``material (doc_id, unit, material)``, a row an item or a unit, and ``resolved (doc_id, unit, chars)`` by code; a unit without budgets
    is cut by its material. Lazily drawn and guessed runs are left to a fresh count.
    """
    wanted = shared.where(F.col("short_n").isNull() & (F.col("n") >= EXCESS) & ~lazy(F.col("span"), F.col("n"))).select("doc_id", F.col("code").alias("unit"), F.col("n").cast("long").alias("items"))
    dense = material.groupBy("doc_id", "unit").agg(F.round(F.sum("material"), 6).alias("m")).where(F.col("m") >= DENSE)
    total = resolved.groupBy("doc_id", "unit").agg(F.sum("chars").alias("c"))
    chars = F.when(F.coalesce("c", F.lit(0)) > 0, F.col("c")).otherwise(F.col("m"))
    ends = dests.where("error is null and parent_code is null").groupBy("doc_id", F.col("code").alias("unit")).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    met = wanted.join(dense, ["doc_id", "unit"]).join(total, ["doc_id", "unit"], "left").join(ends, ["doc_id", "unit"])
    blocks = F.least(F.bround(chars / BLOCK, 0).cast("long"), "items", F.col("end") - F.col("start") + 1)
    return met.select("doc_id", F.col("unit").alias("code"), "start", "end", "items", blocks.alias("blocks")).where("blocks >= 2")


def adopted_blocks(lines: DataFrame, dests: DataFrame, plans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(lines, left)``: maps with the blocks of ``plans`` in the place of their runs' lines, and plans that lines of other units or chains keep from it.

    The first plan of a document is adopted; the others are asked about.
    """
    first = plans.withColumn("at", F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "code"))).where("at = 1").drop("at")
    p = first.select("doc_id", F.col("code").alias("own"), F.col("start").alias("low"), F.col("end").alias("high"))
    over = dests.join(p, "doc_id").where("start <= high and end >= low")
    mine = (F.col("code") == "-") | (F.col("error").isNull() & F.col("parent_code").isNull() & (F.col("code") == F.col("own")))
    fit = over.groupBy("doc_id").agg(F.min(mine).alias("fit"), F.min("line_no").alias("line_no")).where("fit").drop("fit")
    gone = over.join(fit.select("doc_id"), "doc_id", "left_semi").select("doc_id", "line_no").distinct()
    cut = block_lines(intervals.even_blocks(first.join(fit, "doc_id", "left_semi"), F.col("blocks")).join(first.select("doc_id", "code"), "doc_id"))
    kept_lines = lines.select("doc_id", "line_no", "line").join(gone, ["doc_id", "line_no"], "left_anti").select("doc_id", F.col("line_no").cast("long").alias("at"), F.lit(-1).cast("long").alias("block"), "line")
    new = cut.join(fit, "doc_id").select("doc_id", F.col("line_no").cast("long").alias("at"), "block", "line")
    order = Window.partitionBy("doc_id").orderBy("at", "block")
    changed = kept_lines.join(fit.select("doc_id"), "doc_id", "left_semi").unionByName(new).withColumn("line_no", F.row_number().over(order) - 1).select("doc_id", "line_no", "line")
    left = plans.join(first.join(fit, "doc_id", "left_semi").select("doc_id", "code"), ["doc_id", "code"], "left_anti")
    return changed, left


def coverage_hints(holes: DataFrame, segments: DataFrame) -> DataFrame:
    """``doc_id, hole_start, hole_end, start, end``: for each hole the segment before it that could be extended, or none.

    Holes and segments go through one ordered window, so none is paired with all others.
    """
    none = F.lit(None).cast("struct<start:bigint,end:bigint>")
    s = segments.select("doc_id", F.col("end").cast("long").alias("at"), F.lit(0).alias("side"), F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).alias("seg"), F.lit(None).cast("long").alias("hole_end"))
    h = holes.select("doc_id", F.col("hole_start").cast("long").alias("at"), F.lit(1).alias("side"), none.alias("seg"), F.col("hole_end").cast("long").alias("hole_end"))
    order = Window.partitionBy("doc_id").orderBy("at", "side", "seg").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = s.unionByName(h).withColumn("before", F.last("seg", ignorenulls=True).over(order)).where("side = 1")
    return found.select("doc_id", F.col("at").alias("hole_start"), "hole_end", F.col("before.start").alias("start"), F.col("before.end").alias("end"))


def uncovered_by(removed: DataFrame, holes: DataFrame) -> DataFrame:
    """``doc_id, hole_start, line``: the first removed line ``(doc_id, start, end, line)`` whose range has a hole."""
    both = holes.join(removed, "doc_id").where((F.col("start") <= F.col("hole_end")) & (F.col("end") >= F.col("hole_start")))
    return both.groupBy("doc_id", "hole_start").agg(F.min_by("line", "start").alias("line"))


def block_lines(blocks: DataFrame, code: str | None = None) -> DataFrame:
    """``doc_id, block, line``: map lines of blocks that ``intervals.even_blocks`` has cut, of one unit or of their ``code``."""
    span = F.concat_ws("-", F.col("block_start").cast("string"), F.col("block_end").cast("string"))
    items = F.when(F.col("item_lo") == F.col("item_hi"), F.col("item_lo").cast("string")).otherwise(F.concat_ws("-", F.col("item_lo").cast("string"), F.col("item_hi").cast("string")))
    unit = F.col("code") if code is None else F.lit(code)
    return blocks.where("block_start <= block_end and item_lo <= item_hi").select("doc_id", "block", F.concat(span, F.lit(" "), unit, F.lit("."), items).alias("line"))


#: What is said of each rule; ``{}`` is its detail.
SAID = {
    "unread": "this is no line of a map and no count: {}",
    "declared before the map": "{}: counts come after the map's lines",
    "destination": "{}",
    "overlap": "the line of chunks {} begins before one that precedes it has ended",
    "beyond the text": "chunks {} are beyond the last one",
    "not covered": "no line has chunks {}",
    "not declared": "{} is drawn and has no count",
    "items differ from the count": "{}: drawn items are not 0 up to the count",
    "parent without a line": "{}: an instance with entries has no line of its own",
    "source is not mapped": "{}: the unit that is repeated has no line",
    "mirrors and is mapped": "{}: a unit that repeats another has no lines of its own",
    "declared and not mapped": "{} is said to be there and has no line",
    "in two ranges": "{}: an item stands in two ranges",
}


def _spans(dests: DataFrame) -> DataFrame:
    """``doc_id, start, end, cells, hosts, chains``: the lines of maps with their destinations as written, what they host, and the parents of their chains."""
    cell = token(F.col("code"), F.col("item_lo"), F.col("item_hi"), F.col("parent_code"), F.col("parent"))
    chain = F.col("parent_code").isNotNull()
    host = F.explode_outer(F.when(~chain & F.col("item_lo").isNotNull(), F.sequence("item_lo", "item_hi")))
    real = dests.where("error is null")
    hosts = real.withColumn("item", host).where("item is not null").groupBy("doc_id", "start", "end").agg(F.collect_set(F.concat_ws(".", "code", F.col("item").cast("string"))).alias("hosts"))
    own = real.groupBy("doc_id", "start", "end").agg(F.array_sort(F.collect_set(cell)).alias("cells"), F.array_sort(F.collect_set(F.when(chain, F.concat_ws(".", "parent_code", F.col("parent").cast("string"))))).alias("chains"), F.array_sort(F.collect_set(F.when(chain, cell))).alias("links"))
    return own.join(hosts, ["doc_id", "start", "end"], "left").withColumn("hosts", F.coalesce("hosts", F.array().cast("array<string>")))


def chain_remedies(dests: DataFrame) -> DataFrame:
    """``doc_id, detail, remedy`` for overlaps with chains: what would mend the line that begins at ``detail``'s chunks.

    A slice of a destination that a wider line holds: that line goes. Two entries of one instance: the earlier ends
    before the later. A parent over its own chains: it keeps the chunks that they leave.
    """
    lines = _spans(dests)
    before = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    met = lines.withColumn("w", F.max(F.struct(F.col("end").alias("reach"), F.col("start").alias("from"), "cells", "hosts", "chains")).over(before)).where((F.size("links") > 0) & (F.col("w.reach") >= F.col("start")))
    fed = dests.where("error is null and parent_code is not null").select("doc_id", F.concat_ws(".", "parent_code", F.col("parent").cast("string")).alias("host"), F.explode(F.sequence("start", "end")).alias("chunk_id")).groupBy("doc_id", "host").agg(F.collect_set("chunk_id").alias("fed"))
    hosted = F.get(F.array_intersect("chains", "w.hosts"), F.lit(0))
    same = F.get(F.array_intersect("chains", "w.chains"), F.lit(0))
    joined = met.withColumns({"host": hosted, "same": same}).join(fed, ["doc_id", "host"], "left")
    left = F.array_except(F.sequence("w.from", "w.reach"), F.coalesce("fed", F.array().cast("array<bigint>")))
    wide = F.concat(F.col("w.from").cast("string"), F.lit("-"), F.col("w.reach").cast("string"))
    twice = (F.col("w.from") <= F.col("start")) & (F.col("end") <= F.col("w.reach")) & F.arrays_overlap("links", "w.cells")
    remedy = (
        F.when(twice, F.concat(F.lit('take out "'), wide, F.lit(" "), F.array_join("w.cells", ","), F.lit('", whose parts these lines are')))
        .when(F.col("host").isNotNull() & F.col("same").isNotNull() & (F.col("w.from") < F.col("start")), F.concat(F.lit("both are entries of "), F.col("same"), F.lit(": end the earlier one at "), (F.col("start") - 1).cast("string")))
        .when(F.col("host").isNotNull() & (F.size(left) == 0), F.concat(F.col("host"), F.lit(" is drawn over its own entries alone: take its line out and give it one over the chunks with its own fields")))
        .when(F.col("host").isNotNull(), F.concat(F.col("host"), F.lit(" is drawn over its own entries: it keeps chunks "), F.array_join(F.transform(left, lambda c: c.cast("string")), ", ")))
    )
    return joined.select("doc_id", F.concat_ws(" ", F.col("start").cast("string"), F.col("end").cast("string")).alias("detail"), remedy.alias("remedy")).where("remedy is not null")


def overdraw_remedies(dests: DataFrame, told: DataFrame) -> DataFrame:
    """``doc_id, detail, remedy`` for nested entries beyond their count: the line of the last that counts could go on over the extra one's chunks."""
    rows = claims(dests).where("parent_code is not null")
    firsts = intervals.first_claim(rows, ["code", "parent_code", "parent", "item"])
    ends = rows.groupBy("doc_id", "code", "parent_code", "parent", "item").agg(F.min_by("end", "start").alias("end"))
    keys = ["doc_id", "code", "parent_code", "parent"]
    met = firsts.join(ends, [*keys, "item"])
    counts = told.where("parent_code is not null and n > 0").select(*keys, "n")
    extra = met.join(counts, keys).where("item >= n").groupBy(*keys, "n").agg(F.min_by(F.struct("item", "first_start", "end"), "item").alias("x"))
    last = met.select(*keys, (F.col("item") + 1).alias("n"), F.struct("first_start", "end").alias("p"))
    both = extra.join(last, [*keys, "n"], "left")
    where = F.concat_ws(" ", "code", F.col("parent").cast("string"), F.col("n").cast("string"))
    grown = F.concat(F.lit('go on with "'), F.col("p.first_start").cast("string"), F.lit("-"), F.col("x.end").cast("string"), F.lit(" "), token(F.col("code"), F.col("n") - 1, F.col("n") - 1, F.col("parent_code"), F.col("parent")), F.lit('", or the count is wrong: say what the document holds'))
    return both.select("doc_id", where.alias("detail"), F.when(F.col("p.first_start") <= F.col("x.first_start"), grown).otherwise("its chunks are those of another entry, or the count is wrong: say what the document holds").alias("remedy"))


def messages(errors: DataFrame, dests: DataFrame, told: DataFrame, removed: DataFrame | None = None, history: DataFrame | None = None) -> DataFrame:
    """``doc_id, rule, detail, message``: what is said of each error, with what would mend it.

    ``removed (doc_id, start, end, line)`` are lines that the last reply took out, ``history (doc_id, round, rule,
    detail)`` the errors of earlier rounds.
    """
    said = reduce(lambda out, rule: F.when(F.col("rule") == rule, F.replace(F.lit(SAID[rule]), F.lit("{}"), F.coalesce("detail", F.lit("")))).otherwise(out), SAID, F.concat_ws(": ", "rule", "detail"))
    parts = F.split("detail", " ")
    holes = errors.where("rule = 'not covered'").select("doc_id", "detail", F.get(parts, F.lit(0)).cast("long").alias("hole_start"), F.get(parts, F.lit(1)).cast("long").alias("hole_end"))
    ranges = dests.where("error is null").select("doc_id", "start", "end").distinct()
    one = dests.where("error is null and code <> '-' and item_lo is not null").groupBy("doc_id", "start", "end").agg(F.count("*").alias("k"), F.first(token(F.col("code"), F.col("item_lo"), F.col("item_hi"), F.col("parent_code"), F.col("parent"))).alias("cell")).where("k = 1")
    near = coverage_hints(holes.select("doc_id", "hole_start", "hole_end"), ranges).where("end = hole_start - 1").join(one, ["doc_id", "start", "end"])
    grown = near.select("doc_id", "hole_start", F.concat(F.lit('go on with "'), F.col("start").cast("string"), F.lit("-"), F.col("hole_end").cast("string"), F.lit(" "), "cell", F.lit('", or give them "-"')).alias("grown"))
    mended = holes.join(grown, ["doc_id", "hole_start"], "left")
    if removed is not None:
        blamed = uncovered_by(removed, holes).select("doc_id", "hole_start", F.concat(F.lit('you took out "'), "line", F.lit('", which had them: put it back, unless they belong elsewhere')).alias("blame"))
        mended = mended.join(blamed, ["doc_id", "hole_start"], "left")
    else:
        mended = mended.withColumn("blame", F.lit(None).cast("string"))
    remedies = [mended.select("doc_id", F.lit("not covered").alias("rule"), "detail", F.coalesce("blame", "grown").alias("remedy")), chain_remedies(dests).withColumn("rule", F.lit("overlap")), overdraw_remedies(dests, told).withColumn("rule", F.lit("items differ from the count"))]
    known = reduce(DataFrame.unionByName, remedies).groupBy("doc_id", "rule", "detail").agg(F.min("remedy").alias("remedy"))
    found = errors.select("doc_id", "rule", "detail", said.alias("said")).join(known, ["doc_id", "rule", "detail"], "left")
    again = F.lit(None).cast("string")
    if history is not None:
        back = regressions(history, errors).withColumn("again", F.lit("an earlier round had mended this: do so once more"))
        found = found.join(back, ["doc_id", "rule", "detail"], "left")
        again = F.col("again")
    return found.select("doc_id", "rule", "detail", F.concat_ws("; ", "said", "remedy", again).alias("message"))


def regressions(history: DataFrame, now: DataFrame) -> DataFrame:
    """``doc_id, rule, detail`` of what was wrong in a round ``(doc_id, round, rule, detail)``, was right in the last one, and is wrong again."""
    last = history.groupBy("doc_id").agg(F.max("round").alias("last"))
    then = history.join(last, "doc_id").groupBy("doc_id", "rule", "detail").agg(F.max(F.col("round") == F.col("last")).alias("in_last")).where("not in_last").drop("in_last")
    return now.select("doc_id", "rule", "detail").join(then, ["doc_id", "rule", "detail"], "left_semi")


def passable(errors: DataFrame) -> DataFrame:
    """``doc_id`` of maps whose only faults are counts: they may pass with the counts that they draw."""
    return errors.groupBy("doc_id").agg(F.min(F.col("rule") == "items differ from the count").alias("only")).where("only").select("doc_id")


def drawn_counts(told: DataFrame, dests: DataFrame) -> DataFrame:
    """``doc_id, code, parent, n`` with counts as drawn where a map draws the unit."""
    drawn = claims(dests).where("item is not null").groupBy("doc_id", "code", "parent").agg(F.countDistinct("item").alias("drawn"))
    t, d = told.alias("t"), drawn.alias("d")
    same = (F.col("t.doc_id") == F.col("d.doc_id")) & (F.col("t.code") == F.col("d.code")) & F.col("t.parent").eqNullSafe(F.col("d.parent"))
    return t.join(d, same, "left").select("t.doc_id", "t.code", "t.parent", F.coalesce("d.drawn", "t.n").alias("n"))
