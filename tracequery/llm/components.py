"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def _least(near: DataFrame) -> DataFrame:
    """Each node with the least of itself and its neighbours."""
    return near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for each linked node but the roots; a root is the least node of its component.

    Every round is two aggregations and two joins by node, with map-side
    minima, and is written to the shared folder, so lineage stays short.  What
    is joined is written first, so that its size is known and a node with a
    large share of all links can be split by the adaptive join.
    """
    pair = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = scratch.cut(pair, "components")
    before = _state(edges)
    while before[0]:
        both = edges.union(edges.select("v", "u"))
        least = scratch.cut(_least(both), "components-least")
        large = scratch.cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "components-large")
        down = scratch.cut(large.groupBy("u").agg(F.min("v").alias("m")), "components-down")
        small = large.join(down, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down).distinct()
        edges = scratch.cut(small, "components")
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
