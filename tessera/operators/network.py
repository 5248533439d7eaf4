"""Support counting over a follow graph: overlap, entity union, tie-aware positions and rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions.hashing import fingerprint
from tessera.session import Scratch


def support(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct sources per node, nodes without any at 0.

    nodes: (node, ...); edges: (source, target), repeats and self links allowed and not counted.
    """
    counted = edges.where("source is not null and target is not null").distinct().groupBy(F.col("target").alias("node")).agg(F.count("*").alias("support"))
    return nodes.join(counted, "node", "left").withColumn("support", F.coalesce("support", F.lit(0).cast("long")))


def levels(supported: DataFrame) -> DataFrame:
    """(support, n, below, total, dense_rank) per distinct level of support.

    Only the distinct levels are ordered, so that the window sees a few rows however many nodes
    there are.
    """
    per = supported.groupBy("support").agg(F.count("*").alias("n"))
    up = W.orderBy("support").rowsBetween(W.unboundedPreceding, -1)
    return per.select(
        "support",
        "n",
        F.coalesce(F.sum("n").over(up), F.lit(0)).cast("long").alias("below"),
        F.sum("n").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).cast("long").alias("total"),
        F.dense_rank().over(W.orderBy(F.desc("support"))).cast("long").alias("dense_rank"),
    )


def position(below: F.Column, total: F.Column):
    """below / (total - 1) as decimal(7,6), rounded half up; 1 where total is 1."""
    share = below.cast("decimal(17,6)") / F.nullif(total - 1, F.lit(0)).cast("decimal(20,0)")
    return F.when(total == 1, F.lit(1)).otherwise(F.round(share, 6)).cast("decimal(7,6)")


def positions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """support() with dense rank and position; a node's position counts those strictly below it."""
    s = support(nodes, edges)
    lv = levels(s)
    return s.join(lv, "support").withColumn("position", position(F.col("below"), F.col("total")))


def ranked(rows: DataFrame, order: list[Column], out: str = "position") -> DataFrame:
    """rows with ``out``: the place of each row in a total order, from 1.

    No task sees all rows: they are cut into ranges of the order, ranked inside their range and moved
    down by the rows of the ranges before. The ranges are written, since a second look at the data
    might cut them otherwise.
    """
    spark = rows.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = Scratch(spark).write(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = cut.withColumn("_k", F.row_number().over(W.partitionBy("_range").orderBy(*order)))
    sizes = cut.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return inside.join(F.broadcast(before), "_range").withColumn(out, (F.col("_before") + F.col("_k")).cast("long")).drop("_range", "_k", "_before")


def overlap(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """support() with position (no ties: by label, then node), dense_rank, and share of all sources."""
    s = support(nodes, edges)
    placed = ranked(s, [F.desc("support"), F.asc("label"), F.asc("node")])
    lv = levels(placed).select("support", "below", "n", "total", "dense_rank")
    total = edges.where("target is not null").agg(F.count_distinct("source").alias("_sources"))
    j = placed.join(lv, "support").join(F.broadcast(total))
    return j.withColumn("share", F.col("support") / F.nullif("_sources", F.lit(0).cast("long"))).drop("_sources")


def entity_union(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_entity, support, channels, dense_rank): distinct source entities of an entity's channels, its own left out.

    edges: source, target; sources: source, source_entity; targets: target, target_entity.
    """
    pairs = edges.join(targets, "target").join(sources, "source").where("source_entity <> target_entity").select("target_entity", "source_entity").distinct()
    got = pairs.groupBy("target_entity").agg(F.count("*").alias("support"))
    every = targets.groupBy("target_entity").agg(F.count_distinct("target").alias("channels"))
    s = every.join(got, "target_entity", "left").withColumn("support", F.coalesce("support", F.lit(0).cast("long")))
    return s.join(levels(s).select("support", "dense_rank"), "support").select("target_entity", "support", "channels", "dense_rank")


def followers_of(edges: DataFrame, accounts: DataFrame, target) -> DataFrame:
    """One account per entity that follows the target: best position, then handle, then id. accounts: x_id, handle, entity, position."""
    j = edges.where(F.col("target") == F.lit(target)).select(F.col("source").alias("x_id")).distinct().join(accounts, "x_id")
    w = W.partitionBy("entity").orderBy(F.asc_nulls_last("position"), F.lower("handle"), "x_id")
    return j.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(node, rank_a, rank_b, gain) of nodes in both rankings."""
    return a.select("node", F.col("rank").alias("rank_a")).join(b.select("node", F.col("rank").alias("rank_b")), "node").withColumn("gain", F.col("rank_a") - F.col("rank_b"))


def ordered_fingerprint(rows: DataFrame, order: list[Column], *keys: str) -> DataFrame:
    """(fingerprint): the address of all rows' keys in a total order.

    Each row is taken with its place, which comes from ranges of the order, and the rows' digests are added up,
    so that no task sees all rows. Equal sequences have equal addresses however they are partitioned, and a row
    more, less or elsewhere changes them.
    """
    return ranked(rows, order, "_place").agg(fingerprint(rows, "_place", *keys).alias("fingerprint"))
