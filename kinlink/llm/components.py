"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm.common import remove, store


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (a, b), a > b: neighbours are linked to the least one."""
    if large:
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        met = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        met = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return met.where("a > b").distinct()


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """node, root (the least node of its component) for every node with an edge.

    Every round is stored in the shared folder, so lost executors cost one
    round, and deleted when the next one is there; the number of rounds grows
    with the logarithm of the nodes.
    """
    state = None
    now, path = store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), name)
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_if(F.col("a") < F.col("b"))).first()
        if seen == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select("b", "b").distinct())
        state = seen
        new, at = store(_stars(_stars(now, True), False), name)
        remove(edges.sparkSession, path)
        now, path = new, at
