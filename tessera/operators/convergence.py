"""Artifacts that redirects prove to be one: all tables that name them change together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import urls
from tessera.operators.events import roots
from tessera.operators.upserts import pick
from tessera.session import Scratch, shuffled

#: What keeps redirects from being applied, in the order in which it is looked for.
REDIRECT_FAULTS = ("bad_final_url", "several_targets", "source_artifact_missing")


def redirect_faults(artifacts: DataFrame, redirects: DataFrame) -> DataFrame:
    """(source_id, fault) of redirects that can't be applied. artifacts: artifact_id. redirects: source_id, target_id (null: the address has no canonical form).

    A source has to be an artifact, or what another redirect leads to.
    """
    bad = redirects.where("target_id is null").select("source_id", F.lit("bad_final_url").alias("fault"))
    away = redirects.where("target_id is not null and target_id <> source_id")
    several = away.groupBy("source_id").agg(F.count_distinct("target_id").alias("n")).where("n > 1").select("source_id", F.lit("several_targets").alias("fault"))
    known = artifacts.select(F.col("artifact_id").alias("source_id")).union(away.select(F.col("target_id").alias("source_id"))).distinct()
    missing = redirects.select("source_id").join(shuffled(known), "source_id", "left_anti").select("source_id", F.lit("source_artifact_missing").alias("fault"))
    return bad.unionByName(several).unionByName(missing).distinct()


def converge_tables(tables: dict[str, DataFrame], redirects: DataFrame) -> dict[str, DataFrame]:
    """All tables after the redirects, or ValueError (a fault, or alias_conflict) or BrokenForest (a circle), and nothing is changed.

    tables: ``artifact`` (artifact_id, canonical_url, host, first_seen_at, last_seen_at, updated_at), ``alias`` (alias_url, artifact_id, alias_kind, first_seen_at,
    last_seen_at), ``item`` (fetch_run_id, artifact_id), each with any other columns, and any others that have artifact_id, which are
    only renamed. redirects: source_id, final_url, seen_at. A source goes; its rows go to the artifact of the final address, through
    further redirects to the last of a chain, whatever the order of redirects. If there is no such artifact it is made from the source that
    comes first (by length of chain, time, id), seen as late as that redirect or the last one of the chain. An existing one isn't
    changed. Of a run's items that meet, the target's own stays, else that of the first source. The addresses of
    sources and final addresses become aliases; one that is there is widened in time, and keeps its kind. An alias that would name two artifacts is a conflict.
    """
    spark = redirects.sparkSession
    scratch = Scratch(spark)
    artifact, alias = tables["artifact"], tables["alias"]
    r = urls.canonical(redirects.select("source_id", "final_url", "seen_at"), F.col("final_url"), "_url")
    r = scratch.write(r.withColumn("target_id", urls.artifact_id(F.col("_url"))), "redirects")
    found = {f.fault for f in redirect_faults(artifact, r).select("fault").distinct().collect()}
    if found:
        raise ValueError(f"artifacts cannot converge: {next(f for f in REDIRECT_FAULTS if f in found)}")
    away = r.where("target_id <> source_id")
    links = away.select("source_id", "target_id").distinct()
    chains = roots(spark, links).where("depth > 0").select(F.col("node").alias("artifact_id"), F.col("root").alias("_to"), F.col("depth").alias("_depth"))
    first = away.groupBy(F.col("source_id").alias("artifact_id")).agg(F.min("seen_at").alias("_at"))
    ends = scratch.write(chains.join(shuffled(first), "artifact_id"), "ends")
    places = away.groupBy(F.col("target_id").alias("_to")).agg(F.min("_url").alias("_url"), F.max("seen_at").alias("_latest"))

    gone = scratch.write(artifact.join(shuffled(ends), "artifact_id"), "gone")
    absent = gone.select("_to").distinct().join(shuffled(artifact.select(F.col("artifact_id").alias("_to"))), "_to", "left_anti")
    base = pick(gone.join(shuffled(absent), "_to"), ["_to"], [F.asc("_depth"), F.asc("_at"), F.asc("artifact_id")]).join(shuffled(places), "_to")
    seen = F.when(F.col("_depth") > 1, F.greatest("_at", "_latest")).otherwise(F.col("_at"))
    new = {"artifact_id": F.col("_to"), "canonical_url": F.col("_url"), "host": urls.host(F.col("_url")), "last_seen_at": F.greatest("last_seen_at", seen), "updated_at": seen}
    made = base.select(*[new[c].alias(c) if c in new else F.col(c) for c in artifact.columns])
    kept = artifact.join(shuffled(ends.select("artifact_id")), "artifact_id", "left_anti").select(*artifact.columns)

    def renamed(df: DataFrame) -> DataFrame:
        return df.join(shuffled(ends), "artifact_id", "left").withColumn("artifact_id", F.coalesce("_to", "artifact_id"))

    between = ends.join(shuffled(places.select(F.col("_to").alias("artifact_id"), "_url")), "artifact_id").select(F.col("_url").alias("alias_url"), F.col("_to").alias("artifact_id"), F.col("_at").alias("seen_at"))
    own = gone.select(F.col("canonical_url").alias("alias_url"), F.col("_to").alias("artifact_id"), F.col("_at").alias("seen_at"))
    final = renamed(r.select(F.col("final_url").alias("alias_url"), F.col("target_id").alias("artifact_id"), "seen_at")).select("alias_url", "artifact_id", "seen_at")
    told = own.unionByName(between).unionByName(final).select("alias_url", "artifact_id", F.lit("redirect").alias("alias_kind"), F.col("seen_at").alias("first_seen_at"), F.col("seen_at").alias("last_seen_at"), F.lit(False).alias("_had"))
    both = scratch.write(renamed(alias).withColumn("_had", F.lit(True)).select(*alias.columns, "_had").unionByName(told, allowMissingColumns=True), "aliases")
    if both.groupBy("alias_url").agg(F.count_distinct("artifact_id").alias("n")).where("n > 1").limit(1).count():
        raise ValueError("artifacts cannot converge: alias_conflict")
    widest = {"first_seen_at": F.min("first_seen_at"), "last_seen_at": F.max("last_seen_at")}
    merged = both.groupBy("alias_url").agg(*[widest[c].alias(c) if c in widest else F.max_by(c, F.col("_had")).alias(c) for c in alias.columns if c != "alias_url"])

    item = renamed(tables["item"])
    order = [F.asc_nulls_first("_depth"), F.asc("_at"), *[F.asc_nulls_first(c) for c in tables["item"].columns if c not in ("fetch_run_id", "artifact_id")]]
    out = {"artifact": kept.unionByName(made), "alias": merged.select(*alias.columns), "item": pick(item, ["fetch_run_id", "artifact_id"], order).select(*tables["item"].columns)}
    for name, df in tables.items():
        if name not in out:
            out[name] = renamed(df).select(*df.columns)
    return out
