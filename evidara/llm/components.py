"""Connected components over an edge list, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.session import durable


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of (a, b) edges; component is the smallest node reachable.

    Alternates large stars (a node's larger neighbours link to its smallest one) and small stars (its smaller
    neighbours do), until nothing changes; the number of rounds grows with the logarithm of the nodes. Minima are
    pre-aggregated before each shuffle, and no neighbour list is ever gathered, so a node may have any number of edges.
    """
    links = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct())
    before = None
    for _ in range(max_rounds):
        both = links.select(F.col("high").alias("node"), F.col("low").alias("near")).unionByName(links.select(F.col("low").alias("node"), F.col("high").alias("near")))
        least = both.groupBy("node").agg(F.min("near").alias("least")).withColumn("least", F.least("node", "least"))
        large = both.where("near > node").join(least, "node").select(F.col("near").alias("high"), F.col("least").alias("low")).where("high <> low").distinct()
        small_least = large.groupBy("high").agg(F.min("low").alias("least"))
        turned = large.join(small_least, "high")
        small = turned.select(F.explode(F.array(F.struct("high", F.col("least").alias("low")), F.struct(F.col("low").alias("high"), F.col("least").alias("low")))).alias("link")).select("link.*")
        links = durable(small.where("high <> low").distinct())
        state = links.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = links.groupBy("high").agg(F.min("low").alias("component")).select(F.col("high").alias("node"), "component")
    roots = links.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return stars.unionByName(roots)
