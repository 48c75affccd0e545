"""Interval algebra over chunk ranges.

``segments`` have ``doc_id, start, end`` (both ends inside) and what they are mapped to; ``points`` have
``doc_id, chunk_id``. All shuffles are on the document (and destination), so a document's intervals are
worked on where they are; no step pairs intervals with one another except ``hosted``, an equi-join on the
document and destination.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expand(segments: DataFrame) -> DataFrame:
    """A row for every chunk of every segment."""
    return segments.withColumn("chunk_id", F.explode(F.sequence("start", "end"))).drop("start", "end")


def runs(points: DataFrame, keys: list[str], position: str = "chunk_id") -> DataFrame:
    """Consecutive positions of equal keys as ``start, end``: gaps and islands by position less rank."""
    distinct = points.select(*keys, position).distinct()
    island = F.col(position) - F.row_number().over(Window.partitionBy(*keys).orderBy(position))
    return distinct.withColumn("island", island).groupBy(*keys, "island").agg(F.min(position).cast("long").alias("start"), F.max(position).cast("long").alias("end")).drop("island")


def merged_neighbours(points: DataFrame, value: Column, keys: list[str], position: str = "chunk_id") -> DataFrame:
    """Neighbouring positions with equal ``value`` as one segment, in order."""
    order = Window.partitionBy(*keys).orderBy(position)
    marked = points.withColumn("value", value)
    fresh = F.when(F.lag("value").over(order).eqNullSafe(F.col("value")) & (F.lag(position).over(order) == F.col(position) - 1), 0).otherwise(1)
    grouped = marked.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order))
    return grouped.groupBy(*keys, "run").agg(F.min(position).cast("long").alias("start"), F.max(position).cast("long").alias("end"), F.first("value").alias("value"), F.count("*").alias("n")).drop("run")


def holes(segments: DataFrame, sizes: DataFrame) -> DataFrame:
    """Ranges of 0..size-1 that no segment covers; ``sizes`` has ``doc_id, size``.

    A running maximum of ends finds them without listing the chunks.
    """
    order = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fence = sizes.select("doc_id", F.col("size").cast("long").alias("start"), F.col("size").cast("long").alias("end"))
    walked = segments.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).unionByName(fence)
    reached = walked.withColumn("reach", F.coalesce(F.max("end").over(order), F.lit(-1).cast("long")))
    return reached.where("start > reach + 1").select("doc_id", (F.col("reach") + 1).alias("hole_start"), (F.col("start") - 1).alias("hole_end"))


def overlaps(segments: DataFrame) -> DataFrame:
    """Segments that begin before all that precede them have ended."""
    before = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("reach", F.max("end").over(before)).where("start <= reach")


def hosted(chains: DataFrame, hosts: DataFrame) -> DataFrame:
    """Chains inside a host's run of the same parent."""
    c, h = chains.alias("c"), hosts.alias("h")
    same = (F.col("c.doc_id") == F.col("h.doc_id")) & (F.col("c.parent_code") == F.col("h.code")) & (F.col("c.parent") == F.col("h.item"))
    return c.join(h, same & (F.col("h.start") <= F.col("c.start")) & (F.col("c.end") <= F.col("h.end")), "left_semi")


def latest_anchor(points: DataFrame, anchors: DataFrame) -> DataFrame:
    """Each point with the number of the last anchor at or before it (null before the first): a backward as-of join.

    Points and anchors go through one window in order, so nothing is multiplied.
    """
    numbered = anchors.select("doc_id", "chunk_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_id")) - 1).cast("long").alias("anchor"))
    both = points.select("doc_id", "chunk_id", F.lit(None).cast("long").alias("anchor"), F.lit(1).alias("side")).unionByName(numbered.withColumn("side", F.lit(0)))
    order = Window.partitionBy("doc_id").orderBy("chunk_id", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("item", F.last("anchor", ignorenulls=True).over(order)).where("side = 1").select("doc_id", "chunk_id", "item")


def first_claim(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Where each key is first claimed."""
    return segments.groupBy("doc_id", *keys).agg(F.min("start").alias("first_start"))


def even_blocks(runs_: DataFrame, blocks: Column) -> DataFrame:
    """Runs ``start, end, items`` cut into blocks of about equal chunks and items, by whole-number division."""
    cut = runs_.withColumn("blocks", blocks).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    span = F.col("end") - F.col("start") + 1
    at = lambda total, k: F.floor(total * k / F.col("blocks")).cast("long")
    return cut.select(
        "doc_id",
        "block",
        (F.col("start") + at(span, F.col("block"))).alias("block_start"),
        (F.col("start") + at(span, F.col("block") + 1) - 1).alias("block_end"),
        at(F.col("items"), F.col("block")).alias("item_lo"),
        (at(F.col("items"), F.col("block") + 1) - 1).alias("item_hi"),
    )
