"""Snapshots of a follow graph: pages as they come in, chains of pages, reuse of a parent, checks, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.operators.events import BrokenForest, roots
from tessera.operators.upserts import pick
from tessera.session import Scratch


class Conflict(RuntimeError):
    """Two different pages under one key, or a page that cannot be followed."""


def page_faults(pages: DataFrame) -> DataFrame:
    """(source, cursor, fault): pages that cannot be taken: without a list, with a next page but no cursor for it, with their own cursor again, or with several contents.

    pages: source, cursor (empty: the first), next_cursor, has_next, body, accounts (array of struct; null: no list).
    """
    key = ["source", "cursor"]
    several = pages.groupBy(*key).agg(F.count_distinct(F.sha2(F.col("body").cast("binary"), 256)).alias("n")).where("n > 1").select(*key, F.lit("page_conflict").alias("fault"))
    nxt = F.coalesce("next_cursor", F.lit(""))
    more = F.coalesce("has_next", F.lit(False))
    fault = F.when(F.col("accounts").isNull(), "provider_shape").when(more & (nxt == ""), "cursor_missing").when(more & (nxt == F.col("cursor")), "cursor_repeat")
    single = pages.select(*key, fault.alias("fault")).where("fault is not null").distinct()
    return single.unionByName(several)


def record_pages(kept: DataFrame, incoming: DataFrame) -> DataFrame:
    """Pages to add: those whose (source, cursor) is new, one each; raises Conflict if a page is at fault or differs from the one that is kept."""
    if page_faults(kept.select(*incoming.columns).unionByName(incoming)).limit(1).count():
        raise Conflict("pages cannot be taken as they are")
    fresh = incoming.join(kept.select("source", "cursor").distinct(), ["source", "cursor"], "left_anti")
    return pick(fresh, ["source", "cursor"], [F.asc("body")])


def page_edges(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, accounts) of pages: who follows whom, each once; per account its last description, by source and cursor. accounts: array of struct<x_id, handle>."""
    rows = pages.select("source", "cursor", F.explode("accounts").alias("a")).select("source", "cursor", "a.*").where("x_id is not null")
    edges = rows.select("source", F.col("x_id").alias("target")).distinct()
    accounts = rows.groupBy("x_id").agg(F.max_by("handle", F.struct("source", "cursor")).alias("handle"))
    return edges, accounts


def page_order(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(source, cursor, place, complete): the place of each page in its source's chain, from 1; complete if the chain ends with a last page.

    A page points to the one with its next cursor. Pages that no chain from a first page (an empty
    cursor) reaches are left out; a cycle, or a page that two point to, raises BrokenForest. This is how captured responses are
    replayed: no request is made.
    """
    more = F.col("has_next") & (F.coalesce("next_cursor", F.lit("")) != "")
    name = lambda c: F.to_json(F.array(F.col("source").cast("string"), F.col(c) if isinstance(c, str) else c))
    p = pages.select("source", "cursor", F.when(more, F.col("next_cursor")).alias("next_cursor")).distinct()
    links = p.where("next_cursor is not null").select(name("next_cursor").alias("source_id"), name("cursor").alias("target_id"))
    links = Scratch(spark).write(links, "links")
    if links.groupBy("source_id").count().where("count > 1").limit(1).count():
        raise BrokenForest("several pages point to one")
    found = Scratch(spark).write(roots(spark, links), "chains")
    placed = p.select("source", "cursor", "next_cursor", name("cursor").alias("node"), name(F.lit("")).alias("first")).join(found, "node", "left")
    placed = placed.withColumn("root", F.coalesce("root", "node")).where("root = first").withColumn("place", F.coalesce("depth", F.lit(0)) + 1)
    ends = placed.groupBy("source").agg(F.bool_or(F.col("next_cursor").isNull()).alias("complete"))
    return placed.join(ends, "source").select("source", "cursor", F.col("place").cast("long").alias("place"), "complete")


def reuse_parent(cohort: DataFrame, parent: dict[str, DataFrame], child: dict[str, DataFrame], key: str = "source") -> dict[str, DataFrame]:
    """The child's tables with the parent's rows of sources that are in the cohort and that the child has not yet fetched itself.

    cohort: key. Every table has the key; a source's rows come from one side only, so that its pages
    and edges stay together.
    """
    own = child["pages"].select(key).distinct()
    wanted = cohort.select(key).distinct().join(own, key, "left_anti")
    return {name: rows.unionByName(parent[name].select(*rows.columns).join(wanted, key, "left_semi")) if name in parent else rows for name, rows in child.items()}


def snapshot_faults(sources: DataFrame, pages: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, fault): what speaks against a snapshot.

    sources: source, status, page_count, fetched_count. pages: source, cursor, body, sha256,
    has_next. edges: source, target. Checks: the digest of every body, the number of pages and of
    edges, and that a complete source ends with a last page.
    """
    p = pages.groupBy("source").agg(F.count("*").alias("_p"), F.bool_or(F.sha2(F.col("body").cast("binary"), 256) != F.col("sha256")).alias("_bad"), F.bool_or(~F.col("has_next")).alias("_end"))
    e = edges.groupBy("source").agg(F.count_distinct("target").alias("_e"))
    j = sources.join(p, "source", "left").join(e, "source", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    codes = F.array(
        F.when(F.coalesce("_bad", F.lit(False)), "checksum"),
        F.when(n("page_count") != n("_p"), "page_count"),
        F.when(n("fetched_count") != n("_e"), "edge_count"),
        F.when((F.col("status") == "complete") & ~F.coalesce("_end", F.lit(False)), "unfinished_chain"),
    )
    known = pages.select("source").union(edges.select("source")).distinct().join(sources.select("source"), "source", "left_anti")
    return j.select("source", F.explode(F.array_compact(codes)).alias("fault")).union(known.select("source", F.lit("unknown_source")))


def run_summary(accounts: DataFrame, statuses: tuple[str, ...] = ("complete", "cached", "pending", "failed")) -> DataFrame:
    """(run_id, accounts, pages, provider_requests, cache_hits, cached_pages, a count per status, unfinished): one row per run.

    accounts: run_id, status, page_count, provider_requests, cache_hits.
    """
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    by_status = [F.count_if(F.col("status") == s).alias(s) for s in statuses]
    cached = F.when(F.col("status") == "cached", F.col("page_count"))
    g = accounts.groupBy("run_id").agg(F.count("*").alias("accounts"), total("page_count", "pages"), total("provider_requests", "provider_requests"), total("cache_hits", "cache_hits"), total(cached, "cached_pages"), *by_status)
    return g.withColumn("unfinished", F.col("pending") + F.col("failed"))


def ranking_faults(ranked: DataFrame, sources: int, tolerance: float = 1e-15) -> DataFrame:
    """(node, fault): shares that aren't support over the number of sources, and ranks that don't follow support.

    ranked: node, support, share, dense_rank. Ranks are held against the distinct levels of support, which are ordered once.
    """
    want = ranked.select("support").distinct().withColumn("_rank", F.dense_rank().over(W.orderBy(F.desc("support"))))
    j = ranked.join(want, "support")
    codes = F.array(F.when(F.abs(F.col("share") - F.col("support") / F.lit(sources)) > tolerance, "share"), F.when(F.col("dense_rank") != F.col("_rank"), "rank"))
    return j.select("node", F.explode(F.array_compact(codes)).alias("fault"))
