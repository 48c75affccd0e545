"""The copy contract: values that must stand in the document, whatever blanks and marks they lost."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.text import copy_form
from siltstone.plans.schema import Marked

#: Pieces that are sought, and what a window has before and after its value.
PIECE, LEAST_PIECE, BEFORE, AFTER = 16, 8, 24, 48


def window(source: Column, value: Column) -> Column:
    """The part of a source that a value seems to copy: around the first of its pieces that the source holds; null without one."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.length(value) - 1, F.lit(0)), F.lit(PIECE)), lambda s: F.least(F.length(value) - s, F.lit(PIECE)) >= LEAST_PIECE)
    hits = F.filter(F.transform(starts, lambda s: F.struct(s.alias("start"), (F.position(F.substr(value, s + 1, F.lit(PIECE)), source) - 1).alias("at"))), lambda h: h["at"] >= 0)
    hit = F.get(hits, F.lit(0))
    low = F.greatest(hit["at"] - hit["start"] - BEFORE, F.lit(0))
    high = hit["at"] - hit["start"] + F.length(value) + AFTER
    return F.when(F.size(hits) > 0, F.substr(source, low + 1, F.greatest(high - low, F.lit(0))))


@F.pandas_udf(T.DoubleType())
def coverage(value: pd.Series, part: pd.Series) -> pd.Series:
    """The share of a value's characters that match within a window."""
    share = lambda a, b: sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks()) / len(a) if a and b else 0.0
    return pd.Series([share(a, b) for a, b in zip(value, part, strict=True)], dtype="float64")


def marked_values(data: DataFrame, marked: list[Marked]) -> DataFrame:
    """``doc_id, path, value, labels, ratio``: the strings of ``data (doc_id, data)`` under a copy contract, blank ones left out."""
    found = []
    for field in marked:
        rows = data.select("doc_id", F.lit("").alias("path"), F.try_parse_json("data").alias("v"))
        for number, (name, listed) in enumerate(field.steps):
            path = F.concat("path", F.lit(("." if number else "") + name))
            inner = F.try_variant_get("v", f"$['{name}']", "variant")
            if listed:
                rows = rows.select("doc_id", path.alias("path"), F.posexplode(F.try_variant_get(inner, "$", "array<variant>")).alias("n", "v"))
                rows = rows.select("doc_id", F.concat("path", F.lit("["), F.col("n").cast("string"), F.lit("]")).alias("path"), "v")
            else:
                rows = rows.select("doc_id", path.alias("path"), inner.alias("v"))
        strings = rows.where(F.schema_of_variant("v") == "STRING").select("doc_id", "path", F.try_variant_get("v", "$", "string").alias("value"))
        found.append(strings.withColumns({"labels": F.array(*map(F.lit, field.labels)).cast("array<string>"), "ratio": F.lit(field.ratio)}))
    return reduce(DataFrame.unionByName, found).where(F.length(F.trim("value")) > 0)


def breaches(values: DataFrame, documents: DataFrame) -> DataFrame:
    """``doc_id, path, code, label, coverage, value`` of values ``(doc_id, path, value, labels, ratio)`` that break the contract.

    A value that begins with the heading of a sibling (label and colon) is a ``heading`` breach; one that is not
    in the document and covers less than ``ratio`` of its best window is a ``verbatim`` one. A document's values meet
    its text together, so it is sent and brought to its normal form once; only windows of values that are not plain
    copies reach the Python matcher.
    """
    marked = values.where(F.length(F.trim("value")) > 0).withColumn("norm", copy_form(F.col("value")))
    forms = F.filter(F.transform("labels", lambda x: F.struct(x.alias("label"), copy_form(x).alias("form"))), lambda x: (x["form"] != "") & (F.startswith(F.col("norm"), F.concat(x["form"], F.lit("："))) | F.startswith(F.col("norm"), F.concat(x["form"], F.lit(":")))))
    rows = marked.select("doc_id", "path", "value", "norm", "ratio", F.get(forms, F.lit(0))["label"].alias("label"))
    heading = rows.where("label is not null").select("doc_id", "path", F.lit("heading").alias("code"), "label", F.lit(0.0).alias("coverage"), "value")
    gathered = rows.where("label is null").groupBy("doc_id").agg(F.collect_list(F.struct("path", "value", "norm", "ratio")).alias("found"))
    met = gathered.join(documents.select("doc_id", copy_form(F.col("text")).alias("source")), "doc_id")
    other = F.filter("found", lambda x: ~F.contains(F.col("source"), x["norm"]))
    cut = F.transform(other, lambda x: F.struct(x["path"].alias("path"), x["value"].alias("value"), x["norm"].alias("norm"), x["ratio"].alias("ratio"), window(F.col("source"), x["norm"]).alias("part")))
    measured = met.select("doc_id", F.explode(cut).alias("x")).select("doc_id", "x.*").withColumn("coverage", coverage("norm", F.coalesce("part", F.lit(""))))
    verbatim = measured.where("part is null or coverage < ratio").select("doc_id", "path", F.lit("verbatim").alias("code"), F.lit("").alias("label"), "coverage", "value")
    return heading.unionByName(verbatim)


def copy_issues(found: DataFrame) -> DataFrame:
    """Breaches as issues to repair: ``doc_id, path, message, code, expected, got, report_only``."""
    heading = F.concat(F.lit("begins with the heading "), "label", F.lit(", whose text has a field of its own; give what is left of this block"))
    other = F.concat(F.lit("stands in the document for "), F.bround(F.col("coverage") * 100, 0).cast("int").cast("string"), F.lit(" % only; copy it out word by word, all of it"))
    return found.select("doc_id", "path", F.when(F.col("code") == "heading", heading).otherwise(other).alias("message"), "code", F.lit("a copy from the document").alias("expected"), F.col("value").alias("got"), F.lit(False).alias("report_only"))


def copy_budgets(material: DataFrame, marked: list[str]) -> DataFrame:
    """``doc_id, path, budgets`` of units with copied fields: an item costs its material, a gap the item's before it."""
    rows = material.where(F.col("unit").isin(marked))
    whole = rows.where("item is null").select("doc_id", F.col("unit").alias("path"), F.array(F.bround("material", 0).cast("long")).alias("budgets"))
    top = rows.where("item is not null").groupBy("doc_id", "unit").agg(F.max("item").alias("top"))
    every = top.withColumn("item", F.explode(F.sequence(F.lit(0).cast("long"), "top"))).drop("top").join(rows, ["doc_id", "unit", "item"], "left")
    order = Window.partitionBy("doc_id", "unit").orderBy("item").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = every.withColumn("cost", F.coalesce(F.last("material", ignorenulls=True).over(order), F.lit(0.0)))
    listed = filled.groupBy("doc_id", "unit").agg(F.transform(F.sort_array(F.collect_list(F.struct("item", F.bround("cost", 0).cast("long").alias("c")))), lambda r: r["c"]).alias("budgets"))
    return listed.select("doc_id", F.col("unit").alias("path"), "budgets").join(whole.select("doc_id", "path"), ["doc_id", "path"], "left_anti").unionByName(whole)
