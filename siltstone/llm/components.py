"""Connected components by alternating large-star and small-star.

Only pairs of ids move. Minima are pre-aggregated before each shuffle and written. Nodes with more than ``HUB`` pairs are
told to their pairs where these lie, if there are few enough such nodes to broadcast; all others, and beyond that bound
hubs as well, meet their pairs in a join that the adaptive skew join can split. Every round is written to the shared
folder, and the round before it deleted.

Results: null ends and loops are ignored, repeated pairs count once, no pairs give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import discard, written

#: Pairs that make a node a hub, and hubs that may be broadcast, 16 bytes each.
HUB, BROADCAST_HUBS = 256, 1_000_000


def _met(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """``pairs (u, v)`` with the ``m`` of a table ``least (u, m, n)`` that has every u."""
    hubs = least.where(F.col("n") > HUB).select("u", "m")
    if not 0 < hubs.count() <= BROADCAST_HUBS:
        return pairs.join(least.select("u", "m"), "u")
    near = pairs.join(F.broadcast(hubs), "u")
    return near.unionAll(pairs.join(F.broadcast(hubs), "u", "left_anti").join(least.select("u", "m"), "u").select(near.columns))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
    tied = _met(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    out = written(tied.distinct(), "stars")
    discard(least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = written(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
    tied = _met(down, least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    out = written(tied.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
    discard(least)
    return out


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``links (u, v)``; a component is named by its smallest node."""
    edges = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    for _ in range(rounds):
        large = _large_star(edges)
        last, edges = edges, _small_star(large)
        discard(last, large)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    names = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return names.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
