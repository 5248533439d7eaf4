"""Daily lexicographic rank: four layers and the id, with the layer that decided."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions.numbers import mean_position, ratio

LAYERS = ("trusted_votes", "mean_voter_position", "author_position", "public_interactions")


def voters(votes: DataFrame) -> DataFrame:
    """One vote per (day, item, entity); the author's own votes go after the union of all members'.

    votes: day, item, entity, author, position.
    """
    own = votes.groupBy("day", "item", "entity").agg(F.max("author").alias("author"), F.max("position").alias("position"))
    return own.where(~F.col("entity").eqNullSafe(F.col("author")))


def inputs(items: DataFrame, votes: DataFrame) -> DataFrame:
    """The four layers per item of a day; items without votes have 0 and mean position 0.

    items: day, item, author_position, public_interactions.
    """
    v = voters(votes).groupBy("day", "item").agg(F.count("*").alias("trusted_votes"), F.sum("position").alias("_total"))
    j = items.join(v, ["day", "item"], "left")
    n = F.coalesce("trusted_votes", F.lit(0).cast("long"))
    return j.select("day", "item", n.alias("trusted_votes"), mean_position(F.col("_total"), n).alias("mean_voter_position"), F.col("author_position").cast("decimal(7,6)").alias("author_position"), F.col("public_interactions").cast("long").alias("public_interactions"))


def daily_rank(layers: DataFrame) -> DataFrame:
    """layers with daily_rank and decided_at_layer.

    Items are ordered by the layers, greatest first, then by id. The deciding layer is the first in
    which an item differs from the next (the last item: from the one before; a single item: 5).
    """
    w = W.partitionBy("day").orderBy(*[F.desc(c) for c in LAYERS], F.asc("item"))

    def decided(side):
        out = F.lit(5)
        for k in range(len(LAYERS), 0, -1):
            c = LAYERS[k - 1]
            out = F.when(F.col(c) != side(c), k).otherwise(out)
        return out

    nxt, prev = F.lead("item").over(w), F.lag("item").over(w)
    ranked = layers.withColumns({"daily_rank": F.row_number().over(w).cast("long"), "_next": nxt, "_prev": prev, **{f"_n_{c}": F.lead(c).over(w) for c in LAYERS}, **{f"_p_{c}": F.lag(c).over(w) for c in LAYERS}})
    layer = F.when(F.col("_next").isNotNull(), decided(lambda c: F.col(f"_n_{c}"))).when(F.col("_prev").isNotNull(), decided(lambda c: F.col(f"_p_{c}"))).otherwise(5)
    return ranked.select(*layers.columns, "daily_rank", layer.cast("long").alias("decided_at_layer"))


def vote_bucket(n):
    """0, 1, 2, 3-4 or 5+."""
    return F.when(n <= 0, "0").when(n == 1, "1").when(n == 2, "2").when(n <= 4, "3-4").otherwise("5+")


BUCKETS = ("0", "1", "2", "3-4", "5+")


def bucket_stats(ranked: DataFrame, labels: DataFrame, key: str = "item") -> DataFrame:
    """(bucket, n, share, labelled, hit_rate) for every bucket, empty ones at 0 with a null rate.

    labels: key, hit (null or missing: not labelled).
    """
    j = ranked.join(labels, key, "left").withColumn("bucket", vote_bucket(F.col("trusted_votes")))
    got = j.groupBy("bucket").agg(F.count("*").alias("n"), F.count("hit").alias("labelled"), F.sum(F.col("hit").cast("long")).alias("hits"))
    all_buckets = ranked.sparkSession.createDataFrame([(b,) for b in BUCKETS], "bucket string")
    full = all_buckets.join(F.broadcast(got), "bucket", "left").fillna(0, ["n", "labelled", "hits"])
    total = F.sum("n").over(W.partitionBy())
    return full.select("bucket", "n", ratio(F.col("n"), total).alias("share"), "labelled", ratio(F.col("hits"), F.col("labelled")).alias("hit_rate"))


def layer_distribution(ranked: DataFrame) -> DataFrame:
    """(day, layer, n) with day null for all days together: both levels in one pass."""
    return ranked.groupingSets([["day", "decided_at_layer"], ["decided_at_layer"]], "day", "decided_at_layer").agg(F.count("*").alias("n")).select("day", F.col("decided_at_layer").alias("layer"), "n")
