"""Personalised PageRank on the subgraph of sources.

Rank moves along the edges of sources; an edge's weight is one over all edges of its source, those
to nodes that are no sources included. What leaves the sources that way, and the rank of sources
without edges, returns to the seeds. After the iteration one more step spreads the rank over all
nodes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import Scratch, shuffled

DAMPING, TOLERANCE, ROUNDS = 0.85, 1e-10, 200
#: Buckets of edges: at least so many, and else one for so many edges.
LEAST_BUCKETS, BUCKET_EDGES = 12, 4_000_000


class NotConverged(RuntimeError):
    pass


def seed_weights(seeds: DataFrame) -> DataFrame:
    """(node, weight) with weights that add up to 1; repeated nodes add up, weights must be positive."""
    per = seeds.where("weight > 0").groupBy("node").agg(F.sum("weight").alias("weight"))
    total = per.agg(F.sum("weight")).first()[0]
    if not total:
        raise ValueError("no seed has a positive weight")
    return per.select("node", (F.col("weight") / total).alias("weight"))


def _edges_in_place(scratch: Scratch, edges: DataFrame, name: str) -> tuple[DataFrame, int]:
    """edges written in buckets of their source, and the number of these: joins by it leave them where they are."""
    count = max(LEAST_BUCKETS, edges.count() // BUCKET_EDGES)
    edges.repartition(count, "source").write.format("parquet").bucketBy(count, "source").option("path", scratch.path("buckets")).saveAsTable(name)
    return edges.sparkSession.table(name), count


def _flow(rank: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, got): what the edges (source, target, degree) bring from ranks (source, rank)."""
    return edges.join(rank, "source").groupBy(F.col("target").alias("node")).agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))


def _stepped(flow: DataFrame, seeds: DataFrame, damping: float) -> DataFrame:
    """(node, rank) after a step; rows are the nodes that get rank besides the seeds."""
    kept = flow.agg(F.sum("got")).first()[0] or 0.0
    back = 1.0 - damping * kept
    j = flow.join(seeds, "node", "full_outer")
    return j.select("node", (F.coalesce("got", F.lit(0.0)) * damping + F.coalesce("weight", F.lit(0.0)) * back).alias("rank"))


def pagerank(spark: SparkSession, edges: DataFrame, sources: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """(node, score) over all nodes that edges reach, the scores adding up to 1.

    edges: source, target (distinct); sources: node; seeds: node, weight. Raises NotConverged if the
    L1 change does not fall under the tolerance in ``rounds`` rounds. Ranks of every round are
    written tables; only sums reach the driver. Edges stay in buckets of their source: a round shuffles ranks, and
    at most a sum per bucket and target.
    """
    scratch = Scratch(spark)
    who = scratch.write(sources.select("node").distinct(), "sources")
    own = edges.join(shuffled(who.select(F.col("node").alias("source"))), "source", "left_semi").select("source", "target").distinct()
    own = scratch.write(own, "edges")
    degree = own.groupBy("source").agg(F.count("*").alias("degree"))
    own = scratch.write(own.join(shuffled(degree), "source").select("source", "target", "degree"), "edges")
    w = scratch.write(seed_weights(seeds.join(who, "node", "left_semi")), "seeds")
    inner = scratch.write(own.join(shuffled(who.select(F.col("node").alias("target"))), "target", "left_semi").select(*own.columns), "inner")
    name = f"tessera_{uuid.uuid4().hex}"
    ranks, flows = Scratch(spark), Scratch(spark)
    rank = w.withColumnRenamed("weight", "rank")
    named = lambda r: r.select(F.col("node").alias("source"), "rank")
    try:
        placed, count = _edges_in_place(scratch, inner, name)
        for _ in range(rounds):
            flow = flows.write(_flow(named(rank).repartition(count, "source").hint("shuffle_hash"), placed), "flow")
            new = ranks.write(_stepped(flow, w, damping), "rank")
            change = new.withColumnRenamed("rank", "a").join(rank.withColumnRenamed("rank", "b"), "node", "full_outer").agg(F.sum(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))))).first()[0]
            rank = new
            ranks.drop(keep=2)
            flows.drop()
            if change < tolerance:
                break
        else:
            raise NotConverged(f"L1 change {change} after {rounds} rounds")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    flow = scratch.write(_flow(shuffled(named(rank)), own), "flow")
    return _stepped(flow, w, damping).withColumnRenamed("rank", "score")
