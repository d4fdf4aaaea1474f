"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.store import Workspace


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Point the larger (or the smaller and equal) neighbours of each node at its least neighbour."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
    joined = near.join(least, near["a"] == least["n"])
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def connected_components(edges: DataFrame, work: Workspace, label: str = "cc", rounds: int = 60) -> DataFrame:
    """``edges`` (a, b) to (node, component), component the least node reachable; nodes without edges are absent.

    Each round is written to the shared folder, so a lost executor costs one round at most. Rounds grow with
    the logarithm of the number of nodes.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = work.save(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b").distinct(), f"{label}0")
    before = state(edges)
    for i in range(1, rounds + 1):
        edges = work.save(_stars(_stars(edges, True), False), f"{label}{i}")
        work.drop(f"{label}{i - 1}")
        now = state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    # every node points at its component's least node, which points nowhere
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
