"""Audits of traces: budgets by item, work that was routed against work that was done, and how budgets fit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.json_values import MISC, at
from siltstone.operators import corrections

#: The band of actual to budgeted characters, and the difference that is let be.
LOW, HIGH, SLACK = 0.4, 2.0, 25


def whole_units(calls: DataFrame) -> DataFrame:
    """``doc_id, unit`` of budgeted calls that ran whole."""
    return calls.where("strategy = 'whole' and size(budget) > 0").select("doc_id", "unit").distinct()


def per_item_budgets(calls: DataFrame) -> DataFrame:
    """``doc_id, unit, budgets``: budgets in item order; items outrank a whole call's list."""
    live = calls.where("size(budget) > 0")
    items = F.when(F.col("batch").isNotNull(), F.col("batch")).when(F.col("item").isNotNull(), F.array("item"))
    spread = live.where("batch is not null or item is not null").select("doc_id", "unit", "call_seq", "budget", F.posexplode(items).alias("n", "i"))
    each = spread.select("doc_id", "unit", "call_seq", "i", F.element_at("budget", F.least(F.col("n") + 1, F.size("budget"))).alias("b"))
    last = each.groupBy("doc_id", "unit", "i").agg(F.max_by("b", "call_seq").alias("b"))
    by_item = last.groupBy("doc_id", "unit").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "b"))), lambda r: r["b"]).alias("budgets"))
    whole = live.where("batch is null and item is null").groupBy("doc_id", "unit").agg(F.max_by("budget", "call_seq").alias("budgets"))
    return by_item.unionByName(whole.join(by_item.select("doc_id", "unit"), ["doc_id", "unit"], "left_anti"))


def overlap(assigned: DataFrame, calls: DataFrame) -> DataFrame:
    """``doc_id, overlap, lost, passed``: chunks assigned less chunks read, items of per-item units that no call has, and whether there is none.

    ``assigned`` has ``doc_id, unit, item, chunks``.
    """
    raw = assigned.groupBy("doc_id").agg(F.sum(F.size("chunks")).alias("raw"))
    read = calls.groupBy("doc_id").agg(F.sum(F.size("chunk_ids")).alias("read"))
    items = F.when(F.col("batch").isNotNull(), F.col("batch")).otherwise(F.array("item"))
    have = calls.select("doc_id", "unit", F.explode(items).alias("item")).distinct()
    singles = calls.where("strategy = 'per-item'").select("doc_id", "unit").distinct()
    want = assigned.join(singles, ["doc_id", "unit"], "left_semi").select("doc_id", "unit", "item").distinct()
    w, h = want.alias("w"), have.alias("h")
    lost = w.join(h, (F.col("w.doc_id") == F.col("h.doc_id")) & (F.col("w.unit") == F.col("h.unit")) & F.col("w.item").eqNullSafe(F.col("h.item")), "left_anti").groupBy("doc_id").agg(F.count("*").alias("lost"))
    zero = F.lit(0).cast("long")
    return raw.join(read, "doc_id", "full").join(lost, "doc_id", "left").select("doc_id", (F.coalesce("raw", zero) - F.coalesce("read", zero)).alias("overlap"), F.coalesce("lost", zero).alias("lost"), (F.coalesce("lost", zero) == 0).alias("passed"))


def fits(budget: Column, chars: Column) -> Column:
    """Whether characters are in the band around their budget, or near it."""
    ratio = chars / budget
    return ((ratio >= LOW) & (ratio <= HIGH)) | (F.abs(chars - budget) <= SLACK)


def budget_fit(items: DataFrame) -> DataFrame:
    """``doc_id, unit, low, high, wild`` for ``items (doc_id, unit, item, budget, chars, kind)``.

    Items are judged one by one, keyword budgets by their total; items without a budget or characters are not judged.
    """
    single = items.where("kind <> 'kw' and budget > 0 and chars > 0").select("doc_id", "unit", "budget", "chars")
    total = items.where("kind = 'kw' and budget > 0").groupBy("doc_id", "unit").agg(F.sum("budget").alias("budget"), F.sum("chars").alias("chars"))
    both = single.unionByName(total)
    ratio = F.bround(F.col("chars") / F.col("budget"), 2)
    return both.groupBy("doc_id", "unit").agg(F.min(ratio).alias("low"), F.max(ratio).alias("high"), F.sum(F.when(fits(F.col("budget"), F.col("chars")), 0).otherwise(1)).alias("wild"))


def value_fit(data: DataFrame, calls: DataFrame, paths: list[str]) -> DataFrame:
    """``doc_id, key, budget, chars, fits`` of the budgeted values in ``data (doc_id, data)``; units that ran whole are judged by their total."""
    told = per_item_budgets(calls).withColumnRenamed("unit", "path").where(F.col("path").isin(paths))
    values = [data.select("doc_id", F.lit(path).alias("path"), F.to_json(at(F.col("data"), path, "variant")).alias("value")) for path in paths if path != MISC]
    found = reduce(DataFrame.unionByName, values).where("value is not null")
    rows = corrections.item_chars(told, found, whole_units(calls).withColumnRenamed("unit", "path"))
    return rows.withColumn("fits", fits(F.col("budget"), F.col("chars")))


def realigned(budgets: Column, order: Column) -> Column:
    """A list of budgets for items that were sorted: place i holds the item ``order[i]``."""
    return F.transform(order, lambda p: F.element_at(budgets, F.least(p.cast("int") + 1, F.size(budgets))))
