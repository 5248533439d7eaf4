"""Developments: events of a day that share an artifact, bundled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.hashing import content_id
from tessera.operators.graph import components
from tessera.session import Scratch


def _bundled(spark: SparkSession, events: DataFrame, artifacts: DataFrame, day: str) -> tuple[DataFrame, DataFrame]:
    """(developments with their component, events with theirs)."""
    scratch = Scratch(spark)
    link = artifacts.where("merge_anchor").join(events.select("event_id"), "event_id", "left_semi").select("event_id", "artifact_id").distinct()
    edges = link.select(F.concat(F.lit("e:"), "event_id").alias("u"), F.concat(F.lit("a:"), "artifact_id").alias("v"))
    comp = components(spark, edges).where("node like 'e:%'").select(F.expr("substring(node, 3)").alias("event_id"), "component")
    named = scratch.write(events.join(comp, "event_id", "left").withColumn("component", F.coalesce("component", F.concat(F.lit("e:"), "event_id"))), "components")
    art = artifacts.where("merge_anchor").join(named.select("event_id", "component"), "event_id")
    shared = art.groupBy("component", "artifact_id", "url").agg(F.count_distinct("event_id").alias("_n"), F.min("source_rank").alias("source_rank"), F.min("first_day").alias("first_day")).where("_n > 1")
    anchor = shared.groupBy("component").agg(F.min(F.struct("source_rank", "url", "artifact_id", "first_day")).alias("a"))
    top = named.groupBy("component").agg(F.min(F.struct(F.when(F.col("is_organisation"), 0).otherwise(1).alias("o"), "daily_rank", "event_id")).alias("p"), F.count("*").alias("n_events"))
    out = top.join(anchor, "component", "left").where(F.col("a").isNull() | (F.coalesce("a.first_day", F.lit(day).cast("date")) >= F.lit(day).cast("date")))
    kind, name = F.when(F.col("a").isNull(), "event").otherwise("artifact"), F.coalesce("a.artifact_id", "p.event_id")
    return out.select("component", content_id(F.lit("development"), kind, name).alias("development_id"), F.col("p.event_id").alias("primary_event"), F.coalesce("a.artifact_id", F.lit("")).alias("anchor"), "n_events"), named


def bundles(spark: SparkSession, events: DataFrame, artifacts: DataFrame, day: str) -> DataFrame:
    """(development_id, primary_event, anchor, n_events) of one day.

    events: event_id, is_organisation, daily_rank. artifacts: event_id, artifact_id, url,
    source_rank, merge_anchor, first_day. Events that share an artifact that may merge are one
    component. Its anchor is the shared artifact of least (rank, address); if that was first seen
    before the day, the component is left out, since it was told already (one without a first day counts as of the day). The primary event is an
    organisation's, then of best rank, then of least id.
    """
    return _bundled(spark, events, artifacts, day)[0].drop("component")


def bundle_events(spark: SparkSession, events: DataFrame, artifacts: DataFrame, day: str) -> DataFrame:
    """bundles() with a row per event (event_id), so that a development may have any number."""
    found, named = _bundled(spark, events, artifacts, day)
    return named.select("component", "event_id").join(found, "component").drop("component")


def participants(votes: DataFrame) -> DataFrame:
    """(development_id, entity, roles, n_urls): what an entity did, united over a development's events; roles are few, addresses are counted."""
    return votes.groupBy("development_id", "entity").agg(F.sort_array(F.collect_set("role")).alias("roles"), F.count_distinct("url").alias("n_urls"))


def participant_counts(people: DataFrame) -> DataFrame:
    """(development_id, posters, amplifiers, attention): posters have posted; amplifiers quoted or retweeted; one may be both."""
    poster = F.array_contains("roles", "post")
    amp = F.arrays_overlap("roles", F.array(F.lit("quote"), F.lit("retweet")))
    return people.groupBy("development_id").agg(F.count_if(poster).alias("posters"), F.count_if(amp).alias("amplifiers"), F.count("*").alias("attention"))


def ordered_roles(roles: Column, priority: tuple[str, ...]) -> Column:
    """The distinct roles, those of ``priority`` first in its order, others by name."""
    place = lambda x: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, priority)), x), F.lit(0)), F.lit(len(priority) + 1))
    return F.transform(F.array_sort(F.transform(F.array_distinct(roles), lambda x: F.struct(place(x).alias("p"), x.alias("r")))), lambda s: s.r)


def shown_artifacts(bundled: DataFrame, inner: tuple[str, ...] = ("source_rank", "merge_anchor", "first_event_day")) -> DataFrame:
    """(development_id, artifact_id, artifact, is_merge_basis, n_events): an artifact as it is shown, without the fields that only ranked it.

    bundled: development_id, event_id, artifact (struct with artifact_id, merge_anchor and others).
    An artifact is the basis of a merge if several events share it and it may merge.
    """
    g = bundled.groupBy("development_id", F.col("artifact.artifact_id").alias("artifact_id")).agg(F.min_by("artifact", "event_id").alias("artifact"), F.count_distinct("event_id").alias("n_events"))
    basis = (F.col("n_events") > 1) & F.col("artifact.merge_anchor")
    return g.select("development_id", "artifact_id", F.col("artifact").dropFields(*inner).alias("artifact"), basis.alias("is_merge_basis"), "n_events")
