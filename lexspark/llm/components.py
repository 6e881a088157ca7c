"""Connected components of a graph of edge rows, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, store


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _state(edges: DataFrame) -> tuple[int, int]:
    n, s = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return n, int(s or 0)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node in ``edges`` (a, b: long); the component is its smallest node.

    Each round joins every node's neighbours to its smallest one: first the larger neighbours (large star), then the smaller ones
    (small star). When a pair of rounds changes nothing, each component is a star about its smallest node. Nothing but counts
    and a check sum reaches the driver.
    """
    spark = edges.sparkSession
    paths: list[str] = []
    now = store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges", paths)
    state = _state(now)
    for _ in range(most_rounds):
        if not state[0]:
            break
        old, paths = paths, []
        both = _both(now)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a > b in every row; the smaller neighbours and the node itself go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        now = store(small.where("a <> b").distinct(), "edges", paths)
        new = _state(now)
        drop(spark, old)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
