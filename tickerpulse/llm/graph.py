"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; ``root`` is the smallest node reachable.

    Alternating large-star / small-star steps: each node hooks its larger (smaller) neighbours to
    the smallest node it knows, until every edge points at its root. The steps need about
    log2(nodes) rounds, hold one row per edge, and meet only in aggregates that combine before the
    shuffle and in an equi-join whose hot keys adaptive execution splits. Each round's edges are
    written to the shared checkpoint folder, so lost executors cost one round at most.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = checkpointed(e)
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        hooked = large.join(small_low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = hooked.where("a <> b").unionByName(small_low.select("a", F.col("m").alias("b"))).distinct()
        e = checkpointed(small)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before or now["n"] == 0:
            break
        before = now
    roots = e.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
