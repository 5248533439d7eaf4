"""Connected components of an undirected graph by alternating star contraction, and walks along chains by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import Scratch, shuffled


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the least node of its neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least.select("u", F.col("m").alias("v")))


def components(spark: SparkSession, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); component is its least reachable node.

    Loops and repeated edges are allowed and rows with a null end are ignored. A round costs two
    aggregations and two joins; the number of rounds is logarithmic in practice. Edges stay in
    tables of the shared folder and only a count and a checksum reach the driver. Raises if
    ``rounds`` do not suffice.
    """
    scratch = Scratch(spark)
    now = scratch.write(edges.select("u", "v").where("u is not null and v is not null").distinct(), "edges")
    loops = now.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
    mark = None
    live, stars = now.where("u != v"), Scratch(spark)
    for _ in range(rounds):
        live = stars.write(_small_star(_large_star(live)).distinct(), "stars")
        stars.drop(keep=1)
        row = live.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (row.n, row.s) == mark:
            break
        mark = (row.n, row.s)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = live.select(F.col("v").alias("node"), F.col("v").alias("component"))
    leaves = live.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(roots).union(loops).groupBy("node").agg(F.min("component").alias("component"))


def walked(spark: SparkSession, steps: DataFrame, starts: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, node, ordinal) of the first ``most`` nodes that a walk from each start meets; a start has ordinal 1.

    steps: keys, node, next (null, or no node of steps: the walk ends); a node has one row. starts: keys, node.
    Each round doubles the length of all pointers and of all walks, so it takes log2(most) rounds,
    however many walks there are. In a circle a node keeps the ordinal of its first visit.
    """
    scratch = Scratch(spark)
    at = [*keys, "node"]
    jumps = scratch.write(steps.select(*at, F.col("next").alias("jump")), "jumps")
    met = scratch.write(jumps.select(*at).join(shuffled(starts.select(*at).distinct()), at, "left_semi").withColumn("ordinal", F.lit(1).cast("long")), "met")
    length = 1
    while length < most and jumps.where("jump is not null").limit(1).count():
        ahead = met.join(shuffled(jumps), at).where("jump is not null").select(*keys, F.col("jump").alias("node"), (F.col("ordinal") + length).alias("ordinal"))
        known = ahead.join(shuffled(jumps.select(*at)), at, "left_semi").where(F.col("ordinal") <= most)
        met = scratch.write(met.unionByName(known).groupBy(*at).agg(F.min("ordinal").alias("ordinal")), "met")
        far = jumps.select(*keys, F.col("node").alias("jump"), F.col("jump").alias("_far"))
        jumps = scratch.write(jumps.join(shuffled(far), [*keys, "jump"], "left").select(*at, F.col("_far").alias("jump")), "jumps")
        length *= 2
    return met
