"""Removal of what nothing refers to any more: cascades by counts of references, and the clearing of a source's own claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.session import Scratch

#: Facts that a conference import owns.
COMPANY_FACT, CANDIDATE_FACT = "conference_company", "company_x_candidate"


def cascade(spark: SparkSession, holds: DataFrame, gone: DataFrame, prunable: DataFrame) -> DataFrame:
    """(node, round): the nodes of ``gone`` (round 0) and the prunable ones that lose their last holder by it.

    holds: holder, node; repeated rows count once. gone, prunable: node. A node that never had a holder stays, and so do nodes that hold each other. A
    round looks only at what the nodes of the round before held, and adds to the losses of those; there
    are as many rounds as the cascade is deep.
    """
    scratch, lost_in = Scratch(spark), Scratch(spark)
    refs = scratch.write(holds.select("holder", "node").where("holder is not null and node is not null").distinct(), "refs")
    first = scratch.write(gone.select("node").where("node is not null").distinct(), "first")
    able = prunable.select("node").distinct().join(first, "node", "left_anti")
    total = scratch.write(refs.groupBy("node").agg(F.count("*").alias("total")).join(able, "node", "left_semi"), "total")
    out, last, lost, k = scratch.path("gone"), first, None, 0
    while True:
        last.write.parquet(f"{out}/round={k}")
        last = spark.read.schema(first.schema).parquet(f"{out}/round={k}")
        fresh = refs.join(last.select(F.col("node").alias("holder")), "holder").groupBy("node").agg(F.count("*").alias("lost"))
        fresh = fresh.join(total.select("node"), "node", "left_semi")
        touched = fresh.select("node", "lost", F.lit(True).alias("now"))
        if lost is not None:
            touched = touched.unionByName(lost.select("node", "lost", F.lit(False).alias("now")))
        lost = lost_in.write(touched.groupBy("node").agg(F.sum("lost").alias("lost"), F.bool_or("now").alias("now")), "lost")
        lost_in.drop(keep=1)
        last = lost.where("now").join(total, "node").where("lost = total").select("node")
        if not last.limit(1).count():
            schema = f"node {first.schema['node'].dataType.simpleString()}, round int"
            return spark.read.schema(schema).parquet(out)
        k += 1


def _newest(rows: DataFrame, keys: list[str], own, row_id: str) -> DataFrame:
    """rows, of the own ones only the newest per key."""
    w = W.partitionBy(*keys, own).orderBy(F.desc("observed_at"), F.desc(row_id))
    return rows.withColumn("_k", F.row_number().over(w)).where(~own | (F.col("_k") == 1)).drop("_k")


def consolidate(tables: dict[str, DataFrame], others: DataFrame | None = None, prefix: str = "aie-", evidence: str = "ai.engineer/", note: str = "Official company link in AI Engineer") -> dict[str, DataFrame]:
    """The tables when a conference import keeps one claim each, and organisations that only it knew go; also ``removed`` (what, n).

    tables: facts (fact_id, entity_id, fact, source, observed_at), affiliations (affiliation_id, person_id,
    organisation_id, source, observed_at), links (entity_id, channel_id, evidence_url, notes), channels (channel_id, kind), entities
    (entity_id, kind), each with any other columns. others: entity_id that further tables refer to. Own rows are those of a source that
    begins with ``prefix``. Of own facts the newest per entity and fact stays and candidates go; of own affiliations the newest
    per person. A company without a channel loses its own affiliations and company facts. A company that then has no own affiliation loses
    its own website links and company facts, and channels that nothing links any more go. Organisations of both kinds go if no
    table refers to them after all this, whatever the order in which they are taken. Rows of a null source, and rows
    that name no entity, are never own.
    """
    spark = tables["facts"].sparkSession
    scratch = Scratch(spark)
    own = F.coalesce(F.startswith("source", F.lit(prefix)), F.lit(False))
    company = own & (F.col("fact") == COMPANY_FACT)
    facts = tables["facts"].where(~(own & (F.coalesce("fact", F.lit("")) == CANDIDATE_FACT)))
    facts = scratch.write(_newest(facts, ["entity_id", "fact"], own, "fact_id"), "facts")
    affiliations = scratch.write(_newest(tables["affiliations"], ["person_id"], own, "affiliation_id"), "affiliations")
    links = tables["links"]

    def named(df: DataFrame, column: str = "entity_id") -> DataFrame:
        return df.select(F.col(column).alias("entity_id")).where("entity_id is not null").distinct()

    def without(df: DataFrame, which, ids: DataFrame, column: str = "entity_id") -> DataFrame:
        marked = df.join(ids.select(F.col("entity_id").alias(column), F.lit(True).alias("_in")), column, "left")
        return marked.where(~(which & F.coalesce("_in", F.lit(False)))).select(*df.columns)

    bare = scratch.write(named(facts.where(company)).join(named(links), "entity_id", "left_anti"), "bare")
    kept = scratch.write(without(affiliations, own, bare, "organisation_id"), "affiliations")
    facts1 = without(facts, company, bare)
    orphans = scratch.write(named(facts1.where(company)).join(named(kept.where(own), "organisation_id"), "entity_id", "left_anti"), "orphans")
    facts2 = scratch.write(without(facts1, company, orphans), "facts")

    sites = tables["channels"].where("kind = 'website'").select("channel_id", F.lit(True).alias("_site")).distinct()
    said = F.coalesce(F.contains("evidence_url", F.lit(evidence)), F.lit(False)) | F.coalesce(F.startswith("notes", F.lit(note)), F.lit(False))
    told = links.join(sites, "channel_id", "left").join(orphans.withColumn("_in", F.lit(True)), "entity_id", "left")
    cut = said & F.coalesce("_site", F.lit(False)) & F.coalesce("_in", F.lit(False))
    told = scratch.write(told.withColumn("_cut", cut).select(*links.columns, "_cut"), "links")
    left = told.where("not _cut").select(*links.columns)
    loose = told.where("_cut").select("channel_id").distinct().join(left.select("channel_id"), "channel_id", "left_anti")
    channels = tables["channels"].join(loose, "channel_id", "left_anti").select(*tables["channels"].columns)

    held = named(facts2).union(named(kept, "organisation_id")).union(named(kept, "person_id")).union(named(left))
    if others is not None:
        held = held.union(named(others))
    spare = scratch.write(bare.union(orphans).distinct().join(tables["entities"].where("kind = 'organization'").select("entity_id"), "entity_id", "left_semi").join(held, "entity_id", "left_anti"), "spare")
    count = lambda what, df: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    signed = lambda a, b: a.select(F.lit(1).alias("s")).union(b.select(F.lit(-1)))
    less = lambda what, a, b: signed(a, b).agg(F.coalesce(F.sum("s"), F.lit(0)).cast("long").alias("n")).select(F.lit(what).alias("what"), "n")
    counts = [
        less("facts", tables["facts"], facts2),
        less("affiliations", tables["affiliations"], kept),
        less("unresolved_affiliations", affiliations, kept),
        count("unresolved_organisations", spare.join(bare, "entity_id", "left_semi")),
        count("orphan_organisations", spare.join(orphans, "entity_id", "left_semi")),
        count("website_links", told.where("_cut")),
        count("channels", loose),
    ]
    removed = counts[0]
    for c in counts[1:]:
        removed = removed.unionByName(c)
    entities = tables["entities"].join(spare, "entity_id", "left_anti").select(*tables["entities"].columns)
    return {"facts": facts2, "affiliations": kept, "links": left, "channels": channels, "entities": entities, "removed": removed}
