"""Material of routed items, and budgets in their three forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The forms of a budget.
RATIO, KEYWORDS, ABSOLUTE = r"^(\d+)%$", r"^(\d+)[xX×](\d+)$", r"^(\d+)$"


def _number(token: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(token, pattern, group), F.lit("")).cast("long")


def parsed(token: Column) -> Column:
    """A struct of kind, value and count; null if the token is malformed."""
    none = F.lit(None).cast("long")
    return (
        F.when(token.rlike(RATIO), F.struct(F.lit("ratio").alias("kind"), _number(token, RATIO).alias("value"), none.alias("count")))
        .when(token.rlike(KEYWORDS), F.struct(F.lit("kw").alias("kind"), _number(token, KEYWORDS).alias("value"), _number(token, KEYWORDS, 2).alias("count")))
        .when(token.rlike(ABSOLUTE), F.struct(F.lit("abs").alias("kind"), _number(token, ABSOLUTE).alias("value"), none.alias("count")))
    )


def declared(line: Column) -> Column:
    """Well-formed tokens after ``@``, split at commas and blanks."""
    tokens = F.split(F.regexp_extract(line, r"@(.*)$", 1), r"[,\s]+")
    return F.filter(tokens, lambda t: t.rlike(RATIO) | t.rlike(KEYWORDS) | t.rlike(ABSOLUTE))


def chars(budget: Column, material: Column) -> Column:
    """Value characters of a budget: a share of the material with a half rounded to even, a product, or the number."""
    return F.when(budget["kind"] == "ratio", F.bround(budget["value"] * material / 100.0, 0).cast("long")).when(budget["kind"] == "kw", budget["value"] * budget["count"]).otherwise(budget["value"])


def at_item(values: Column, item: Column) -> Column:
    """The value of an item; a short list's last value goes on."""
    return F.element_at(values, F.least(item.cast("int") + 1, F.size(values)))


def material(assignments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Characters that are not blank for each ``doc_id, unit, item``; a chunk that a unit claims k times counts a k-th each time."""
    claims = F.count("*").over(Window.partitionBy("doc_id", "unit", "chunk_id"))
    shared = assignments.withColumn("claims", claims).join(chunks.select("doc_id", "chunk_id", "content_len"), ["doc_id", "chunk_id"])
    return shared.groupBy("doc_id", "unit", "item").agg(F.sum(F.col("content_len") / F.col("claims")).alias("material"))


def unit_material(drawn: DataFrame, chunks: DataFrame) -> DataFrame:
    """``doc_id, unit, material`` of all items of a unit together: every chunk that it claims (``doc_id, unit, chunk_id``) counts once."""
    met = drawn.join(chunks.select("doc_id", "chunk_id", "content_len"), ["doc_id", "chunk_id"])
    return met.groupBy("doc_id", "unit").agg(F.sum("content_len").cast("double").alias("material"))


def mirrored(rows: DataFrame, derived: DataFrame) -> DataFrame:
    """Rows of units that mirror a source: ``derived`` has ``doc_id, unit, source``. It is one row a unit and document."""
    source = derived.select("doc_id", F.col("unit").alias("mirror"), F.col("source").alias("unit"))
    return rows.unionByName(rows.join(source, ["doc_id", "unit"]).drop("unit").withColumnRenamed("mirror", "unit"))


def per_item(resolved: DataFrame) -> DataFrame:
    """Budgets in item order (items without a number last) as one list a unit."""
    rows = F.sort_array(F.collect_list(F.struct(F.col("item").isNull().alias("last"), "item", "chars")))
    return resolved.groupBy("doc_id", "unit").agg(F.transform(rows, lambda r: r["chars"]).alias("budgets"))


def precedence(router: DataFrame, host: DataFrame, copied: DataFrame) -> DataFrame:
    """Budgets by path: those of copied fields before the host's before the router's."""
    keys = ["doc_id", "path"]
    named = [f.select(*keys, F.col("budgets").alias(n)) for f, n in ((router, "r"), (host, "h"), (copied, "c"))]
    return named[0].join(named[1], keys, "full").join(named[2], keys, "full").select(*keys, F.coalesce("c", "h", "r").alias("budgets"))
