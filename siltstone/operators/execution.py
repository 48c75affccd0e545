"""From routed groups to calls, and from replies to values.

``groups`` have ``doc_id, seq, unit, parent, item, item_lo, item_hi, chunk_ids, text``; a ranged group has both
ends of its items and no item. All windows and aggregations are on the document and unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.budgets import at_item

#: Budgeted characters of a shared call, and the strategies a host may set.
BATCH_CAP = 300
STRATEGIES = ("whole", "per-item")


def groups(assignments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Groups of consecutive chunks of one destination; ``assignments (doc_id, unit, parent, item, chunk_id)``, and ``item_lo, item_hi`` of ranges.

    A range that was drawn alone on its line is one group for all its items.
    """
    from siltstone.operators.intervals import runs

    none = F.lit(None).cast("long")
    rows = assignments if "item_lo" in assignments.columns else assignments.withColumns({"item_lo": none, "item_hi": none})
    rows = rows.withColumn("item", F.when(F.col("item_lo").isNull(), F.col("item")))
    keys = ["doc_id", "unit", "parent", "item", "item_lo", "item_hi"]
    found = runs(rows.select(*keys, "chunk_id").na.fill(-1, keys[2:]), keys)
    order = Window.partitionBy("doc_id").orderBy("start", "unit", "parent", "item", "item_lo")
    spans = found.withColumn("seq", F.row_number().over(order) - 1)
    met = spans.withColumn("chunk_id", F.explode(F.sequence("start", "end"))).join(chunks.select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), "text"), ["doc_id", "chunk_id"])
    texts = met.groupBy("doc_id", "seq", *keys[1:]).agg(F.sort_array(F.collect_list(F.struct("chunk_id", "text"))).alias("texts"))
    real = [F.nullif(F.col(k), F.lit(-1).cast("long")).alias(k) for k in keys[2:]]
    return texts.select("doc_id", "seq", "unit", *real, F.transform("texts", lambda t: t["chunk_id"]).alias("chunk_ids"), F.array_join(F.transform("texts", lambda t: t["text"]), "\n").alias("text"))


def strategies(rows: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, unit, parent, strategy``: whole if a chunk serves several groups or there is one item, else per item."""
    for unit, strategy in (overrides or {}).items():
        if strategy not in STRATEGIES:
            raise ValueError(f"{unit}: {strategy!r} is none of {STRATEGIES}")
    by = rows.groupBy("doc_id", "unit", "parent").agg(F.flatten(F.collect_list("chunk_ids")).alias("ids"), F.size(F.collect_set(F.coalesce("item", F.lit(-1).cast("long")))).alias("items"))
    natural = F.when((F.size("ids") != F.size(F.array_distinct("ids"))) | (F.col("items") <= 1), "whole").otherwise("per-item")
    fixed = F.lit(None).cast("string")
    for unit, strategy in (overrides or {}).items():
        fixed = F.when(F.col("unit") == unit, strategy).otherwise(fixed)
    return by.select("doc_id", "unit", "parent", F.coalesce(fixed, natural).alias("strategy"))


def batches(items: Column, cap: int = BATCH_CAP) -> Column:
    """Arrays of consecutive items, from an ordered array of ``(item, budget)``: greedy while the budgets' sum fits.

    An item over the cap, or without a budget, is alone. A running sum that starts anew has no window form, so
    the ordered array is folded.
    """
    kind = "struct<done:array<array<bigint>>,open:array<bigint>,total:bigint>"
    zero, empty = F.lit(0).cast("long"), F.array().cast("array<bigint>")
    start = F.struct(F.array().cast("array<array<bigint>>").alias("done"), empty.alias("open"), zero.alias("total")).cast(kind)

    def step(a: Column, x: Column) -> Column:
        closed = F.when(F.size(a["open"]) == 0, a["done"]).otherwise(F.concat(a["done"], F.array(a["open"])))
        own = F.array(x["item"].cast("long"))
        alone = x["budget"].isNull() | (x["budget"] > cap)
        full = (F.size(a["open"]) > 0) & (a["total"] + x["budget"] > cap)
        return (
            F.when(alone, F.struct(F.concat(closed, F.array(own)).alias("done"), empty.alias("open"), zero.alias("total")))
            .when(full, F.struct(closed.alias("done"), own.alias("open"), x["budget"].cast("long").alias("total")))
            .otherwise(F.struct(a["done"].alias("done"), F.concat(a["open"], own).alias("open"), (a["total"] + x["budget"]).cast("long").alias("total")))
            .cast(kind)
        )

    return F.aggregate(items, start, step, lambda a: F.when(F.size(a["open"]) == 0, a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))


CALLS = ["doc_id", "unit", "parent", "strategy", "item", "batch", "chunk_ids", "scope", "budget"]


def plan_calls(rows: DataFrame, budgets: DataFrame, cap: int = BATCH_CAP, overrides: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, call_seq`` and a row a call: one for each ranged group, batches of items, or one for a whole unit.

    ``budgets`` have ``doc_id, unit, budgets`` (a list in item order). Groups become pieces of calls by joins on
    document, unit, parent and item; texts are gathered once, when pieces are put together.
    """
    keys = ["doc_id", "unit", "host"]
    least = F.lit(-1).cast("long")
    coded = rows.select("doc_id", "unit", F.coalesce("parent", least).alias("host"), F.coalesce("item", least).alias("slot"), "item_lo", "item_hi", F.col("seq").cast("long").alias("seq"), "chunk_ids", "text")
    piece = [*keys, "strategy", "call_no", "items", "rank", "seq", "chunk_ids", "text"]
    ranged = coded.where("item_lo is not null").select(*keys, F.lit("ranged").alias("strategy"), F.col("seq").alias("call_no"), F.sequence("item_lo", "item_hi").alias("items"), F.lit(0).cast("long").alias("rank"), "seq", "chunk_ids", "text")
    chosen = strategies(rows, overrides).select("doc_id", "unit", F.coalesce("parent", least).alias("host"), "strategy")
    plain = coded.where("item_lo is null").join(chosen, keys)
    # Groups of the same chunks are one text: the first one's place, the last one's text.
    once = plain.where("strategy = 'whole'").groupBy(*keys, "strategy", "chunk_ids").agg(F.min("seq").alias("seq"), F.max_by("text", "seq").alias("text"))
    whole = once.withColumns({"call_no": F.lit(0).cast("long"), "items": F.lit(None).cast("array<bigint>"), "rank": F.lit(0).cast("long")}).select(*piece)
    single = plain.where("strategy = 'per-item'")
    told = budgets.select("doc_id", "unit", "budgets")
    slots = single.select(*keys, "slot").distinct().join(told, ["doc_id", "unit"], "left")
    spent = F.when(F.col("budgets").isNotNull(), at_item(F.col("budgets"), F.greatest("slot", F.lit(0).cast("long"))))
    listed = slots.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("slot").alias("item"), spent.alias("budget")))).alias("items"))
    runs = listed.select(*keys, F.posexplode(batches(F.col("items"), cap)).alias("call_no", "items"))
    met = runs.withColumn("slot", F.explode("items")).join(single.drop("strategy"), [*keys, "slot"])
    per_item = met.select(*keys, F.lit("per-item").alias("strategy"), F.col("call_no").cast("long").alias("call_no"), "items", F.col("slot").alias("rank"), "seq", "chunk_ids", "text")
    pieces = ranged.select(*piece).unionByName(whole).unionByName(per_item.select(*piece))
    gathered = F.array_sort(F.collect_list(F.struct("rank", "seq", "chunk_ids", "text")))
    calls = pieces.groupBy(*keys, "strategy", "call_no").agg(F.first("items").alias("items"), gathered.alias("pieces"), F.min("seq").alias("seq")).join(told, ["doc_id", "unit"], "left")
    several = (F.col("strategy") == "ranged") | (F.size("items") > 1)
    first = F.get("items", F.lit(0))
    made = calls.select(
        "doc_id",
        "unit",
        F.nullif("host", least).alias("parent"),
        "strategy",
        F.when(~several, F.nullif(first, least)).alias("item"),
        F.when(several, F.col("items")).alias("batch"),
        F.flatten(F.transform("pieces", lambda p: p["chunk_ids"])).alias("chunk_ids"),
        F.array_join(F.transform("pieces", lambda p: p["text"]), "\n\n").alias("scope"),
        F.when(F.col("items").isNull(), F.col("budgets")).when(F.col("budgets").isNotNull(), F.transform("items", lambda i: at_item(F.col("budgets"), F.greatest(i, F.lit(0).cast("long"))))).alias("budget"),
        "seq",
    )
    order = Window.partitionBy("doc_id").orderBy("first_seq", F.col("parent").asc_nulls_first(), F.when(F.col("strategy") == "ranged", 0).otherwise(1), F.coalesce("item", F.get("batch", F.lit(0))).asc_nulls_first(), "seq")
    earliest = rows.groupBy("doc_id", "unit").agg(F.min("seq").alias("first_seq"))
    return made.join(earliest, ["doc_id", "unit"]).withColumn("call_seq", (F.row_number().over(order) - 1).cast("long")).select("call_seq", *CALLS)


def overridden(calls: DataFrame, assigned: DataFrame, gives_way: dict[str, dict[str, list[str]]]) -> DataFrame:
    """``doc_id, call_seq, siblings``: the lifted siblings that all items of a call have reads of their own in, so that fields which give way to them are not asked for.

    ``assigned (doc_id, unit, parent, item)`` is what is routed; ``gives_way`` is unit -> sibling -> fields.
    """
    pairs = [(unit, sibling, f"{unit}.{sibling}") for unit, found in gives_way.items() for sibling in found]
    table = F.broadcast(calls.sparkSession.createDataFrame(pairs, "unit string, sibling string, child string"))
    mine = calls.join(table, "unit").select("doc_id", "call_seq", "unit", "sibling", "child", "item", "batch")
    some = F.col("batch").isNotNull() | F.col("item").isNotNull()
    named = mine.where(some).withColumn("slot", F.explode(F.coalesce("batch", F.array("item")))).drop("item", "batch")
    routed = assigned.select("doc_id", "unit", F.col("item").alias("slot")).distinct()
    whole = mine.where(~some).drop("item", "batch").join(routed, ["doc_id", "unit"])
    covered = assigned.where("parent is not null").select("doc_id", F.col("unit").alias("child"), F.col("parent").alias("slot")).distinct().withColumn("has", F.lit(1))
    every = named.unionByName(whole.select(*named.columns)).join(covered, ["doc_id", "child", "slot"], "left")
    full = every.groupBy("doc_id", "call_seq", "sibling").agg(F.min(F.coalesce("has", F.lit(0))).alias("has")).where("has = 1")
    return full.groupBy("doc_id", "call_seq").agg(F.array_sort(F.collect_set("sibling")).alias("siblings"))


def value_path(unit: Column, parent: Column) -> Column:
    """Where a call's value goes: its unit, or ``parent[n].field`` for a nested one."""
    return F.when(parent.isNull(), unit).otherwise(F.concat(F.regexp_replace(unit, r"\.[^.]*$", ""), F.lit("["), parent.cast("string"), F.lit("]."), F.regexp_extract(unit, r"([^.]*)$", 1)))


def values(calls: DataFrame, replies: DataFrame) -> DataFrame:
    """``doc_id, path, value_seq, value``: calls' values by path as JSON texts, in call order.

    Batches add their entries, items one each; a whole reply is the value. A ranged reply with more entries than
    it was asked for loses exact repeats.
    """
    known = calls.join(replies.select("doc_id", "call_seq", "data"), ["doc_id", "call_seq"]).where("data is not null and data <> 'null'")
    listed = F.transform(F.try_variant_get(F.try_parse_json("data"), "$", "array<variant>"), lambda v: F.to_json(v))
    entries = F.coalesce(listed, F.array("data"))
    over = (F.col("strategy") == "ranged") & (F.size(entries) > F.size("batch"))
    many = F.when(over, F.array_distinct(entries)).otherwise(entries)
    path = value_path(F.col("unit"), F.col("parent"))
    adds = F.col("batch").isNotNull() | (F.col("strategy") == "per-item")
    added = known.where(adds).select("doc_id", path.alias("path"), "call_seq", F.posexplode(F.when(F.col("batch").isNotNull(), many).otherwise(F.array("data"))).alias("n", "entry"))
    rows = F.sort_array(F.collect_list(F.struct("call_seq", "n", "entry")))
    joined = added.groupBy("doc_id", "path").agg(F.max("call_seq").alias("value_seq"), F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r["entry"]), ","), F.lit("]")).alias("value"))
    whole = known.where(~adds).groupBy("doc_id", path.alias("path")).agg(F.max("call_seq").alias("value_seq"), F.max_by("data", "call_seq").alias("value"))
    both = joined.unionByName(whole)
    return both.withColumn("at", F.row_number().over(Window.partitionBy("doc_id", "path").orderBy(F.desc("value_seq")))).where("at = 1").drop("at")


def documents_of(values_: DataFrame, gives_way: dict | None = None) -> DataFrame:
    """``doc_id, data``: each document's values merged into one JSON text."""
    from siltstone.functions.json_values import merge_values

    rows = F.sort_array(F.collect_list(F.struct("value_seq", "path", "value")))
    listed = values_.groupBy("doc_id").agg(F.transform(rows, lambda r: F.struct(r["path"].alias("path"), r["value"].alias("value"))).alias("values"))
    return listed.select("doc_id", merge_values(gives_way)(F.col("values")).alias("data"))
