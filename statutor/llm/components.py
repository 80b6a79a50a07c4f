"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statutor.llm.common import cut


def _nearest(edges: DataFrame) -> DataFrame:
    """Per node the smallest of itself and its neighbours; partial minima are taken before the shuffle."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """Rows (node, component): every node of ``edges`` with the smallest node it is linked to.

    Each half step joins the edges with one row per node, so the neighbours of a hub are never gathered in one
    task. Lineage is cut after each round. Nulls link nothing. Self loops keep a node as its own component.
    An empty input gives an empty result.
    """
    e = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).dropna()
    nodes = e.select("u").union(e.select("v")).distinct()
    e = cut(e.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_nearest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        low = _nearest(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v"))).filter("u != v")
        e = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(e, nodes.u == e.u, "left").select(nodes.u.alias("node"), F.coalesce(e.v, nodes.u).alias("component"))
