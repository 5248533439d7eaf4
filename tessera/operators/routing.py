"""Routing: what a model would read of a development, freshness, the gate before it, and reuse of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions import text, time
from tessera.functions.hashing import fingerprint

SHORT = 30


def prune(sources: DataFrame, day: Column) -> DataFrame:
    """Sources of packets without stale posts; the first that is left becomes the root if the root went.

    sources: packet, place, source_type, relation, published. Artifacts stay; packets without a
    current post go.
    """
    post = F.col("source_type") == "x_post"
    s = sources.withColumn("_ok", ~post | time.is_current(F.col("published"), day)).where("_ok")
    w = W.partitionBy("packet")
    s = s.withColumns({"_posts": F.count_if(post).over(w), "_root": F.count_if(post & (F.col("relation") == "root")).over(w), "_k": F.row_number().over(w.orderBy((~post).cast("int"), "place"))})
    s = s.where("_posts > 0")
    relation = F.when(~post | (F.col("_root") > 0), F.col("relation")).when(F.col("_k") == 1, "root").otherwise("same_author_continuation")
    return s.withColumn("relation", relation).drop("_ok", "_posts", "_root", "_k")


def is_visible() -> Column:
    """Whether a source is read: artifacts, roots, independent originals, and continuations that say something."""
    shown = text.display_text(F.col("text"), F.col("source_type") == "x_post")
    return (F.col("source_type") == "artifact") | F.col("relation").isin("root", "independent_original") | ((F.col("relation") == "same_author_continuation") & (F.coalesce(shown, F.lit("")) != ""))


def gate(sources: DataFrame) -> DataFrame:
    """(packet, code, words) of packets; code null goes on to a model.

    Media that nothing reads end it (unsupported_media). One short root post alone (30 words at
    most) ends it too: with an address in it for want of that evidence, else for want of text.
    """
    v = sources.where(is_visible())
    post = F.col("source_type") == "x_post"
    words = text.substantive_words(F.col("text"))
    g = v.groupBy("packet").agg(
        F.max(F.size(F.coalesce("media_types", F.array()))).alias("_m"),
        F.count("*").alias("_n"),
        F.count_if(post).alias("_p"),
        F.count_if(post & (F.col("relation") == "root")).alias("_r"),
        F.sum(F.when(post, words).otherwise(0)).alias("words"),
        F.bool_or(post & F.coalesce(F.col("text").rlike(text.LINK), F.lit(False))).alias("_u"),
    )
    alone = (F.col("_n") == 1) & (F.col("_p") == 1) & (F.col("_r") == 1) & (F.col("words") <= SHORT)
    code = F.when(F.col("_m") > 0, "unsupported_media").when(alone & F.col("_u"), "unavailable_linked_or_media_evidence").when(alone, "short_unsupported_text")
    return g.select("packet", code.alias("code"), "words")


def packet_hash(sources: DataFrame) -> DataFrame:
    """(packet, evidence_sha256): the address of a packet's texts with their places, added up, so that no packet is gathered; times of posting don't count."""
    said = sources.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    return said.groupBy("packet").agg(fingerprint(said, "place", "relation", "source_type", "text_sha256").alias("evidence_sha256"))


def reuse(pending: DataFrame, results: DataFrame, keys: tuple[str, ...] = ("event_id", "evidence_sha256", "input_sha256")) -> DataFrame:
    """pending with status reused and the result where all keys and the contract are equal; else pending stays."""
    k = [*keys, "contract"]
    r = results.where("status = 'complete'").groupBy(*k).agg(F.max_by("result", "finished_at").alias("result"))
    return pending.join(r, k, "left").withColumn("status", F.when(F.col("result").isNotNull(), "reused").otherwise("pending"))


def state(items: DataFrame, results: DataFrame) -> DataFrame:
    """items with routing_state: evaluated, stale (evidence changed since), not_selected, or unavailable without any result of the day.

    items: day, item, evidence_sha256; results: day, item, evidence_sha256, relevant.
    """
    r = results.select("day", "item", F.col("evidence_sha256").alias("_e"), "relevant")
    days = results.select("day", F.lit(True).alias("_d")).distinct()
    j = items.join(r, ["day", "item"], "left").join(days, "day", "left")
    s = F.when(F.col("_d").isNull(), "unavailable").when(F.col("_e").isNull(), "not_selected").when(F.col("_e") == F.col("evidence_sha256"), "evaluated").otherwise("stale")
    return j.withColumn("routing_state", s).drop("_e", "_d")


def telemetry(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, completed, failed, tokens, cached, cache_ratio): counts by status and sums."""
    g = runs.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("status") == "complete").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"),
        F.coalesce(F.sum("cached"), F.lit(0)).cast("long").alias("cached"),
    )
    return g.withColumn("cache_ratio", F.round(F.try_divide(F.col("cached"), F.col("tokens")), 6))


def routing_filter(kind: str) -> Column:
    """A predicate on nullable relevance: relevant, not_relevant or not_evaluated."""
    c = F.col("relevant")
    return {"relevant": F.coalesce(c, F.lit(False)), "not_relevant": F.coalesce(~c, F.lit(False)), "not_evaluated": c.isNull()}[kind]
