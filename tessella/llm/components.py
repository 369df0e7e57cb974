"""Connected components of an edge table by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize

#: The rounds grow with the logarithm of the longest chain; this only guards against a fault.
MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. ``edges`` has long columns u, v with u > v."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        out = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        out = out.select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
    return out.where("u > v").distinct()


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """Columns node, root (both long): the smallest node reachable from each node that has an edge.

    ``edges`` has long columns u and v in any order; loops and repeats are allowed, nulls are dropped.
    A hub with many neighbours never meets in one task: its minimum is aggregated before the
    shuffle and joined back, where Spark splits a skewed side. Each round is written to the shared folder,
    in few files; ``rows``, the number of edges where it is known, does that for the first.
    """
    step = edges.where("u is not null and v is not null and u <> v")
    step = step.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current = materialize(step, "edges", rows)
    seen = None
    for _ in range(MAX_ROUNDS):
        digest = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if tuple(digest) == seen or digest["n"] == 0:
            break
        seen = tuple(digest)
        after = materialize(_star(_star(current, large=True), large=False), "edges", digest["n"])
        drop_table(current)
        current = after
    else:
        raise RuntimeError("components did not converge")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
