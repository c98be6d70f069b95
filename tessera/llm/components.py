"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessera.llm.common import shared_dir


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the
    smallest node reachable.  Nodes without an edge do not appear.

    Alternating large-star and small-star rounds; each round is checkpointed to
    the shared folder and the number of rounds grows with the logarithm of the
    largest component.  Group sizes are handled by joins against per-node minima,
    so no neighbourhood is ever gathered into one row.
    """
    shared_dir(edges.sparkSession)
    def told(rows: DataFrame) -> tuple[DataFrame, tuple]:
        """The rows checkpointed, with their number and sum of hashes, in one job."""
        seen = Observation()
        kept = rows.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")).alias("s")).checkpoint()
        return kept, (seen.get["n"], seen.get["s"])

    links, same = told(
        edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct()
    )
    while True:
        both = links.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(links.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        # large star: neighbours above a node move to the smallest neighbour (or itself)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        # small star: a node and its neighbours below move to the smallest of them
        below = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(below, "hi")
        links, now = told(
            moved.where("lo > m")
            .select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
            .unionByName(below.select(F.col("m").alias("lo"), "hi"))
            .distinct()
        )
        if same == now:
            break
        same = now
    roots = links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
