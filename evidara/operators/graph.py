"""Nodes and edges as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.session import durable, shuffle_partitions


def canonical_edges(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Different undirected edges, the lesser end first; loops and half-open ones left out."""
    ends = df.select(a.alias("a"), b.alias("b")).where("a <> b")
    return ends.select(F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target")).distinct()


def known_edges(edges: DataFrame, nodes: DataFrame, node_id: str = "id") -> DataFrame:
    """Different edges (source, target and whatever else they have) both of whose ends are nodes."""
    ids = nodes.select(F.col(node_id).alias("node")).distinct()
    for end in ("source", "target"):
        edges = edges.join(ids.withColumnRenamed("node", end), end, "left_semi")
    return edges.distinct()


def visible_nodes(nodes: DataFrame, kinds: list[str], active_only: bool = True) -> DataFrame:
    """Nodes of the kinds shown; with active_only all but concepts must be active."""
    shown = nodes.where(F.col("type").isin(*kinds))
    return shown.where((F.col("type") == "concept") | F.coalesce(F.col("status") == "active", F.lit(False))) if active_only else shown


def search(nodes: DataFrame, edges: DataFrame, wanted: str) -> tuple[DataFrame, DataFrame]:
    """Nodes whose label holds the text, whatever its case, and the edges that touch one of them."""
    found = nodes.where(F.contains(F.lower("label"), F.lit(wanted.strip().lower())))
    ids = found.select(F.col("id").alias("node"))
    from_found = edges.join(ids.withColumnRenamed("node", "source"), "source", "left_semi").select("source", "target")
    to_found = edges.join(ids.withColumnRenamed("node", "target"), "target", "left_semi").select("source", "target")
    return found, from_found.union(to_found).distinct()


# fixed values of the layout: the ring's radius, how far inwards others stand, the golden angle and the spread around a place
RING, INWARDS, GOLDEN_ANGLE, SPREAD, SPREAD_STEP, SPREAD_STEPS = 500, 0.7, 2.39996, 30, 18, 7


def layout(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, x, y): concepts evenly on a ring, in the order of their ids; others around the mean of their concepts' places.

    nodes: id, type. edges: source, target, in either direction. Each node counts each concept once. Orders are global
    ranks by ranges, and places come by a join and one grouping, so nothing is gathered in one task.
    """
    concepts, total = global_rank(nodes.where("type = 'concept'").select("id"), [F.col("id")])
    angle = 2 * F.pi() * F.col("rank") / F.lit(float(max(total, 1))) - F.pi() / 2
    ring = concepts.select("id", (RING * F.cos(angle)).alias("x"), (RING * F.sin(angle)).alias("y"))
    both = edges.select("source", "target").union(edges.select(F.col("target"), F.col("source"))).distinct()
    means = both.join(ring.withColumnRenamed("id", "target"), "target").groupBy(F.col("source").alias("id")).agg(F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"))
    others, _ = global_rank(nodes.where("type <> 'concept'").select("id"), [F.col("id")])
    away, turn = SPREAD + F.col("rank") % SPREAD_STEPS * SPREAD_STEP, F.col("rank") * GOLDEN_ANGLE
    near = lambda mean: F.coalesce(F.col(mean), F.lit(0.0)) * INWARDS
    placed = others.join(means, "id", "left").select("id", (near("mean_x") + away * F.cos(turn)).alias("x"), (near("mean_y") + away * F.sin(turn)).alias("y"))
    return ring.unionByName(placed)


def neighbourhood(edges: DataFrame, node: str) -> DataFrame:
    """The node and all one step away."""
    touching = edges.where((F.col("source") == node) | (F.col("target") == node))
    return touching.select(F.explode(F.array("source", "target", F.lit(node))).alias("node")).distinct()


def global_rank(rows: DataFrame, order: list[Column]) -> tuple[DataFrame, int]:
    """rows with ``rank`` from 0 in the given order, and their number, without any task that sees all rows.

    Rows are range-partitioned by the order and ranked in their range; the ranges' sizes, one row each, give the
    offsets. The order should end in a tie-breaker.
    """
    spark = rows.sparkSession
    part = durable(rows.repartitionByRange(shuffle_partitions(spark), *order).withColumn("range_part", F.spark_partition_id()))
    sizes = sorted((r["range_part"], r["count"]) for r in part.groupBy("range_part").count().collect())  # one row for each partition
    offsets, total = [], 0
    for number, size in sizes:
        offsets.append((number, total))
        total += size
    before = F.broadcast(spark.createDataFrame(offsets, "range_part int, range_before long"))
    local = F.row_number().over(Window.partitionBy("range_part").orderBy(*order)) - 1
    return part.withColumn("rank", local).join(before, "range_part").withColumn("rank", F.col("rank") + F.col("range_before")).drop("range_part", "range_before"), total


def reveal_rank(nodes: DataFrame, order: list[Column]) -> DataFrame:
    """nodes with t from 0 (first in order) to 1 (last) and reveal = 1 + 3t; a single node has t = 0."""
    ranked, total = global_rank(nodes, order)
    return ranked.withColumn("t", F.col("rank") / F.lit(float(max(total - 1, 1)))).withColumn("reveal", 1 + 3 * F.col("t")).drop("rank")
