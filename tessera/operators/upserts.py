"""Observation logs, deduplication and upserts as set operations.

Stored tables that a row store would update in place are derived from append-only logs here: a
conflict rule becomes the choice of one row per key, or an aggregate of the key's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def pick(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in the order. The order has to be total for a stable result.

    A row_number filter, which Spark turns into a group limit before the shuffle.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def first_observation(log: DataFrame, keys: list[str], clock: str, tie: str) -> DataFrame:
    """Earliest row per key; refreshes never rewrite it."""
    return pick(log, keys, [F.asc(clock), F.asc(tie)])


def latest(log: DataFrame, keys: list[str], clock: str, tie: str) -> DataFrame:
    return pick(log, keys, [F.desc(clock), F.desc(tie)])


def canonical_posts(log: DataFrame, key: str = "post_id") -> DataFrame:
    """One row per post of a log with direct, discovered_at and priority.

    A direct observation beats an embedded one, then the earliest discovery, then the greater
    priority.
    """
    return pick(log, [key], [F.desc("direct"), F.asc("discovered_at"), F.desc("priority")])


def canonical_relations(log: DataFrame) -> DataFrame:
    """One row per (source, type, target): the earliest discovery, of equal ones the smaller disclosure."""
    return pick(log, ["source_id", "relation_type", "target_id"], [F.asc("discovered_at"), F.asc("disclosure_id")])


def anchors(log: DataFrame) -> DataFrame:
    """(post_id, renderable, roles): renderable if any row is; the distinct roles in order."""
    return log.groupBy("post_id").agg(F.max("renderable").alias("renderable"), F.sort_array(F.collect_set("role")).alias("roles"))


def insert_new(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of incoming whose key is not in existing, one per key (all columns decide ties)."""
    fresh = incoming.join(existing.select(*keys).distinct(), keys, "left_anti")
    return pick(fresh, keys, [F.asc_nulls_first(c) for c in incoming.columns])


def insert_counts(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """(new, total) after insert_new, in one pass over both tables."""
    both = existing.select(*keys, F.lit(True).alias("_old")).union(incoming.select(*keys, F.lit(False).alias("_old")))
    per = both.groupBy(*keys).agg(F.max("_old").alias("_had"))
    return per.agg(F.count_if(~F.col("_had")).alias("new"), F.count("*").alias("total"))


def fold_log(log: DataFrame, keys: list[str], clock: list[str], keep: list[str]) -> DataFrame:
    """Upserts that keep a value where the new one is null: per key the last value of each column that isn't null."""
    order = F.struct(*clock)
    return log.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in keep])


def widen(log: DataFrame, keys: list[str], first: str, last: str, order: list[str], written: str) -> DataFrame:
    """first_seen and last_seen widen, while ``written`` is what the last writer put."""
    return log.groupBy(*keys).agg(F.min(first).alias("first_seen"), F.max(last).alias("last_seen"), F.max_by(written, F.struct(*order)).alias(written))


def changed(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, change) of rows that an upsert would write: inserted, or updated in a value; equal rows are left out.

    Values are compared null-safely.
    """
    o, n = old.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in values], F.lit(True).alias("_had")), new.select(*keys, *values)
    j = n.join(o, keys, "left")
    same = F.lit(True)
    for c in values:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return j.where(F.col("_had").isNull() | ~same).select(*keys, *values, F.when(F.col("_had").isNull(), "inserted").otherwise("updated").alias("change"))


def supported_only(rows: DataFrame, support: DataFrame, keys: list[str]) -> DataFrame:
    """Replacing a catalogue: rows that nothing supports any more go."""
    return rows.join(support.select(*keys).distinct(), keys, "left_semi")


def difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left whose key is missing in right."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def reconcile(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side): keys that are in one table only; empty if both hold the same."""
    l, r = left.select(*keys).distinct().withColumn("_l", F.lit(1)), right.select(*keys).distinct().withColumn("_r", F.lit(1))
    j = l.join(r, keys, "full_outer").where("_l is null or _r is null")
    return j.select(*keys, F.when(F.col("_r").isNull(), "missing").otherwise("extra").alias("side"))
