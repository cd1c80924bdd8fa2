"""Connected components by alternating star contraction on joins and minimum aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pricemesh import staging


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node below the node's smallest neighbour (or the node itself)."""
    near = _both(edges)
    least = near.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang every smaller neighbour of a node, and the node, below its smallest neighbour."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("low"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(least.select("a", F.col("low").alias("b")))


def labels(edges: DataFrame) -> DataFrame:
    """(node, root): every node of the edges (a, b) with the smallest node of its component.

    Each round shrinks chains at least by half on average; rounds stop when the edges stop changing. The edges of
    a round are a written table, so a lost executor costs one round. Self links are ignored; no edges give no rows.
    """

    def settled(df: DataFrame) -> tuple:
        now = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(now)

    clean = edges.where("a <> b").select("a", "b").distinct()
    now = staging.written(clean, "components")
    state = settled(now)
    while state[0]:
        turned = _small_star(_large_star(now)).where("a <> b").distinct()
        now = staging.written(turned, "components")
        before, state = state, settled(now)
        if state == before:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
