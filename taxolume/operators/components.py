"""Connected components of a graph of any size, by DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolume.storage import Scratch, join_hot


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", into: Scratch | None = None) -> DataFrame:
    """(node, component) for each node of an edge, component being the smallest node that it reaches.

    Alternates two steps until the edges are stars: each node sends its larger neighbours to its smallest
    neighbour, then its smaller ones. It goes on until a round changes nothing; the number of rounds grows with the
    logarithm of the graph's diameter. Every round shuffles edges only, takes minima map-side first, deals the
    neighbours of a hub out over several tasks, and is written as a table, so a lost executor costs that round at most.
    Edges with a null end are left out; loops make a node its own component. Ties cannot occur: nodes are compared as
    values. No edge or label reaches the driver, counts apart. into: the caller's tables, to which the result is added at once.
    """
    kind, store = edges.schema[a].dataType, Scratch(edges.sparkSession, "components")
    nodes = edges.select(F.col(a).alias("u"), F.col(b).cast(kind).alias("v")).dropna()
    e, seen = store.put(nodes.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            stars = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
            if into is not None:
                stars = into.put(stars)
                store.drop(e)
            return stars
        after = store.put(_small_star(_large_star(e, now[0]).distinct(), now[0]).distinct())
        store.drop(e)
        e, seen = after, now


def _large_star(e: DataFrame, rows: int) -> DataFrame:
    """Edges (u >= v): larger neighbours of each node go to the node's smallest neighbour or itself."""
    larger = e.filter("u > v").select(F.col("v").alias("u"), F.col("u").alias("v"))
    way = larger.union(e)
    least = way.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("_rows"))
    moved = join_hot(larger, least.select("u", "m"), "u", F.xxhash64("v"), least.select("u", "_rows"), rows=rows)
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(e.filter("u = v"))


def _small_star(e: DataFrame, rows: int) -> DataFrame:
    """Edges (u >= v): each node and its smaller neighbours go to the smallest of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_rows"))
    moved = join_hot(e, least.select("u", "m"), "u", F.xxhash64("v"), least.select("u", "_rows"), rows=rows)
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
