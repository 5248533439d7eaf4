"""Coverage of days by runs: completeness, gaps and islands, contiguous cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.operators.graph import walked
from tessera.operators.upserts import pick
from tessera.session import Scratch, shuffled


def covered_days(runs: DataFrame, start: str, end: str) -> DataFrame:
    """(day, runs) for every day from start to end: how many runs (date_from, date_to) cover it."""
    spark = runs.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    hit = runs.where("date_from is not null and date_to >= date_from").select(F.explode(F.sequence(F.greatest("date_from", F.lit(start).cast("date")), F.greatest(F.least("date_to", F.lit(end).cast("date")), F.greatest("date_from", F.lit(start).cast("date"))))).alias("day"), "date_from", "date_to")
    hit = hit.where("day between date_from and date_to").groupBy("day").agg(F.count("*").alias("runs"))
    return days.join(F.broadcast(hit), "day", "left").fillna(0, ["runs"])


def missing_days(runs: DataFrame, start: str, end: str) -> DataFrame:
    """Days from start to end that no run covers; none means complete."""
    return covered_days(runs, start, end).where("runs = 0").select("day")


def islands(days: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first_day, last_day, n_days): runs of consecutive days per key. days: keys, day; repeats allowed."""
    w = W.partitionBy(*keys).orderBy("day")
    d = days.select(*keys, "day").where("day is not null").distinct()
    g = d.withColumn("_g", F.date_sub("day", F.row_number().over(w)))
    return g.groupBy(*keys, "_g").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n_days")).drop("_g")


def merged_intervals(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first_day, last_day): unions of overlapping or adjoining intervals per key."""
    w = W.partitionBy(*keys).orderBy("date_from", "date_to")
    reach = F.max("date_to").over(w.rowsBetween(W.unboundedPreceding, -1))
    starts = runs.select(*keys, "date_from", "date_to").where("date_from is not null and date_to >= date_from").distinct().withColumn("_s", (reach.isNull() | (F.col("date_from") > F.date_add(reach, 1))).cast("int"))
    return starts.withColumn("_g", F.sum("_s").over(w.rowsBetween(W.unboundedPreceding, 0))).groupBy(*keys, "_g").agg(F.min("date_from").alias("first_day"), F.max("date_to").alias("last_day")).drop("_g")


def complete_days(pages: DataFrame) -> DataFrame:
    """(key, day, complete): a day is complete if a page seen after the next midnight reaches the day's start or is the last page.

    pages: key, day, observed_at, oldest (time of the oldest row of the page), is_last.
    """
    late = F.col("observed_at") >= F.date_add("day", 1).cast("timestamp")
    reaches = F.coalesce(F.col("oldest") <= F.col("day").cast("timestamp"), F.lit(False)) | F.coalesce("is_last", F.lit(False))
    return pages.groupBy("key", "day").agg(F.bool_or(late & reaches).alias("complete"))


def proven(spark: SparkSession, pages: DataFrame, asked: DataFrame, max_pages: int = 100) -> DataFrame:
    """(handle, complete, reason, pages, newest, oldest): what the captured chain of pages of each handle proves.

    pages: handle, cursor (null or blank: the base page), fetched_at, response_id, has_posts, bad_time, newest,
    oldest, has_next, next_cursor. asked: handle, start_day, end_day. Only responses from after the end day's midnight count, of
    those to one request the latest. The chain runs from the base page along the cursors. It is complete with a page older than the
    start day (``boundary``) or with the last page (``terminal``), and otherwise fails as base_missing,
    cursor_missing, no_posts, bad_time, no_cursor, repeated_cursor or too_many_pages. pages, newest and oldest are those of
    the pages read until then; a page without posts or with a time that can't be read doesn't count.
    """
    scratch = Scratch(spark)
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    own = pages.withColumns({"cursor": blank("cursor"), "next_cursor": blank("next_cursor")}).join(shuffled(asked), "handle")
    late = own.where(F.col("fetched_at") >= F.date_add("end_day", 1).cast("timestamp"))
    fresh = pick(late, ["handle", "cursor"], [F.desc("fetched_at"), F.desc("response_id")])
    stop = (
        F.when(~F.coalesce("has_posts", F.lit(False)), "no_posts")
        .when(F.coalesce("bad_time", F.lit(False)), "bad_time")
        .when(F.col("oldest") < F.col("start_day").cast("timestamp"), "boundary")
        .when(~F.coalesce("has_next", F.lit(False)), "terminal")
        .when(F.col("next_cursor") == "", "no_cursor")
    )
    nodes = scratch.write(fresh.select("handle", F.col("cursor").alias("node"), stop.alias("stop"), "next_cursor", "newest", "oldest"), "nodes")
    steps = nodes.select("handle", "node", F.when(F.col("stop").isNull(), F.col("next_cursor")).alias("next"))
    met = scratch.write(walked(spark, steps, asked.select("handle", F.lit("").alias("node")), ["handle"], max_pages).join(shuffled(nodes), ["handle", "node"]), "met")
    read = ~F.coalesce(F.col("stop").isin("no_posts", "bad_time"), F.lit(False))
    seen = met.groupBy("handle").agg(F.count_if(read).alias("pages"), F.max(F.when(read, F.col("newest"))).alias("newest"), F.min(F.when(read, F.col("oldest"))).alias("oldest"), F.max_by(F.struct("stop", "next_cursor", "ordinal"), "ordinal").alias("last"))
    ends = seen.select("*", F.col("last.next_cursor").alias("node")).join(shuffled(met.select("handle", "node", F.lit(True).alias("again"))), ["handle", "node"], "left")
    open_end = F.when(F.coalesce("again", F.lit(False)), "repeated_cursor").when(F.col("last.ordinal") >= max_pages, "too_many_pages").otherwise("cursor_missing")
    told = ends.select("handle", F.coalesce("last.stop", open_end).alias("reason"), "pages", "newest", "oldest")
    out = asked.select("handle").join(shuffled(told), "handle", "left").fillna({"reason": "base_missing", "pages": 0})
    return out.select("handle", F.col("reason").isin("boundary", "terminal").alias("complete"), "reason", "pages", "newest", "oldest")


def chosen_runs(spark: SparkSession, runs: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, complete, first_uncovered_day, run_ids): runs that cover all days asked for, chosen from day to day.

    runs: key, run_id, date_from, date_to. asked: key, start_day, end_day. From the first day on the run that covers the
    day and ends last is taken (of equal ones that which begins first, then of least id), and the walk goes on
    with the day after its end. Where no run covers a day it ends there. Runs are reduced to one per key and first day before
    anything is ordered, so a key costs the days of its range whatever its runs.
    """
    scratch = Scratch(spark)
    own = runs.where("date_to >= date_from").join(asked, "key").where("date_to >= start_day and date_from <= end_day")
    least = own.groupBy("key", "start_day", "date_from", "date_to").agg(F.min("run_id").alias("run_id"))
    far = F.struct("date_to", F.datediff(F.lit("1970-01-01").cast("date"), "date_from").alias("early"), "run_id")
    begun = least.groupBy("key", F.greatest("date_from", "start_day").alias("day")).agg(F.max(far).alias("far"))
    days = asked.where("end_day >= start_day").select("key", "end_day", F.explode(F.sequence("start_day", "end_day")).alias("day"))
    w = W.partitionBy("key").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    best = days.join(begun, ["key", "day"], "left").withColumn("best", F.max("far").over(w))
    covered = F.coalesce(F.col("best.date_to") >= F.col("day"), F.lit(False))
    after = F.date_add("best.date_to", 1)
    nodes = scratch.write(best.select("key", F.col("day").alias("node"), covered.alias("covered"), F.col("best.run_id").alias("run_id"), F.when(covered & (after <= F.col("end_day")), after).alias("next")), "days")
    most = nodes.groupBy("key").count().agg(F.max("count")).first()[0] or 1
    met = walked(spark, nodes.select("key", "node", "next"), asked.select("key", F.col("start_day").alias("node")), ["key"], most).join(shuffled(nodes), ["key", "node"])
    ids = F.transform(F.array_sort(F.collect_list(F.when(F.col("covered"), F.struct("ordinal", "run_id")))), lambda x: x.run_id)
    found = met.groupBy("key").agg(F.min(F.when(~F.col("covered"), F.col("node"))).alias("first_uncovered_day"), ids.alias("run_ids"))
    out = asked.select("key").join(found, "key", "left")
    return out.select("key", F.col("first_uncovered_day").isNull().alias("complete"), "first_uncovered_day", F.coalesce("run_ids", F.array().cast("array<string>")).alias("run_ids"))
