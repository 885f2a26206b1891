"""Connected components of a graph given by its edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillworks.llm.common import staged


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )


def _star(pairs: DataFrame, purpose: str) -> tuple[DataFrame, DataFrame]:
    """Staged pairs (u, v) and the smallest of u and its neighbours, staged as well.

    Both sides of the join that follows then have an exchange of their own, so a node with
    very many neighbours is split.
    """
    pairs = staged(pairs, purpose)
    least = pairs.groupBy("u").agg(F.least(F.min("u"), F.min("v")).alias("m"))
    return pairs, staged(least, f"{purpose}-least")


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """node and root (smallest node of its component) for every node of ``edges`` (a, b).

    Loops and repeated edges are allowed. Only counts and a checksum reach the driver.
    """
    edges = staged(edges.filter(F.col("a") != F.col("b")).distinct(), "cc-edges")
    before = None
    for _ in range(max_rounds):
        pairs, least = _star(_both_ways(edges), "cc-large")
        large = pairs.join(least, "u").filter(F.col("v") > F.col("u"))
        large = large.select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: every node with its smaller neighbours.
        pairs, least = _star(
            large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v"),
            "cc-small",
        )
        small = (
            pairs.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
            .unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        )
        edges = staged(small.filter("a <> b").distinct(), "cc-edges")
        after = tuple(
            edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        )
        if after == before:
            roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            own = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return staged(roots.unionAll(own), "cc-roots")
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
