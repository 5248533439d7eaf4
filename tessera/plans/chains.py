"""Queries over chains and publications: proofs of coverage, chosen runs, cohorts of days."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.operators import coverage, publication
from tessera.plans import adapters as ad
from tessera.session import Scratch

#: A user's events are the pages of a timeline, in order; some are missing, stale, broken, or lead back.
PAGES = """n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events),
pages AS (SELECT user_id AS handle, CASE WHEN k = 0 THEN '' ELSE 'c' || k END AS cursor, event_id AS response_id, CASE WHEN event_id % 41 = 0 THEN TIMESTAMP '2024-01-30 00:00:00' ELSE TIMESTAMP '2024-02-03 00:00:00' END AS fetched_at,
  event_id % 29 <> 0 AS has_posts, event_id % 31 = 0 AS bad_time, TIMESTAMP '2024-02-01 00:00:00' - to_hours((k * 9)::INTEGER) AS newest, TIMESTAMP '2024-02-01 00:00:00' - to_hours((k * 9 + 5)::INTEGER) AS oldest, event_id % 17 <> 0 AS has_next,
  CASE WHEN event_id % 19 = 0 THEN 'c' || greatest(k - 3, 1) WHEN event_id % 23 <> 0 THEN 'c' || (k + 1) END AS next_cursor FROM n WHERE event_id % 37 <> 0)"""
ASKED = "asked AS (SELECT DISTINCT user_id AS handle, CASE WHEN user_id % 2 = 0 THEN DATE '2024-01-28' ELSE DATE '2024-01-01' END AS start_day, DATE '2024-02-01' AS end_day FROM events)"
MAX_PAGES = 12


def proven_coverage(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events")
    i, k = F.col("event_id"), F.col("k")
    at = lambda hours: F.expr(f"timestamp'2024-02-01 00:00:00' - make_interval(0, 0, 0, 0, cast({hours} as int))")
    n = e.withColumn("k", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1)
    cursor = lambda c: F.concat(F.lit("c"), c.cast("string"))
    pages = n.where(i % 37 != 0).select(
        F.col("user_id").alias("handle"),
        F.when(k > 0, cursor(k)).alias("cursor"),
        i.alias("response_id"),
        F.when(i % 41 == 0, F.lit("2024-01-30")).otherwise("2024-02-03").cast("timestamp").alias("fetched_at"),
        (i % 29 != 0).alias("has_posts"),
        (i % 31 == 0).alias("bad_time"),
        at("k * 9").alias("newest"),
        at("k * 9 + 5").alias("oldest"),
        (i % 17 != 0).alias("has_next"),
        F.when(i % 19 == 0, cursor(F.greatest(k - 3, F.lit(1)))).when(i % 23 != 0, cursor(k + 1)).alias("next_cursor"),
    )
    older = pages.where(F.col("response_id") % 3 == 0).withColumns({"fetched_at": F.lit("2024-02-02").cast("timestamp"), "has_next": F.lit(False), "has_posts": F.lit(False)})
    asked = e.select(F.col("user_id").alias("handle")).distinct().withColumns({"start_day": F.when(F.col("handle") % 2 == 0, "2024-01-28").otherwise("2024-01-01").cast("date"), "end_day": F.lit("2024-02-01").cast("date")})
    out = coverage.proven(spark, Scratch(spark).write(pages.where("response_id % 41 <> 0").union(older.where("response_id % 41 <> 0")).union(pages.where("response_id % 41 = 0")), "pages"), asked, MAX_PAGES)
    shown = {c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("")) for c in ("newest", "oldest")}
    return out.withColumns(shown)


def _runs(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events")
    ends = e.groupBy((F.col("user_id") % 40).alias("key"), F.col("user_id").alias("u"), (F.col("event_id") % 3).alias("g")).agg(F.to_date(F.min("ts")).alias("date_from"), (F.count("*") % 9).cast("int").alias("n"))
    return ends.select("key", F.concat(F.col("u").cast("string"), F.lit("-"), F.col("g").cast("string")).alias("run_id"), "date_from", F.expr("date_add(date_from, n)").alias("date_to"))


def chosen_runs(spark, sf_dir):
    asked = ad.table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("key")).distinct()
    asked = asked.select("key", F.lit("2024-01-02").cast("date").alias("start_day"), F.expr("date_add(date'2024-01-05', cast(key % 20 as int))").alias("end_day"))
    out = coverage.chosen_runs(spark, _runs(spark, sf_dir), asked)
    return out.select("key", "complete", F.coalesce(F.col("first_uncovered_day").cast("string"), F.lit("")).alias("first_uncovered_day"), F.array_join("run_ids", ",").alias("run_ids"))


def _items(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events").where("event_type = 'purchase'")
    day = F.to_date("ts").cast("string")
    return e.select(day.alias("day"), F.concat(F.lit("d"), "event_id").alias("development_id"), F.row_number().over(W.partitionBy(day).orderBy("event_id")).cast("long").alias("daily_rank"))


def republished_days(spark, sf_dir):
    """All days are published, then every other day again with its first three."""
    items = Scratch(spark).write(_items(spark, sf_dir), "items")
    runs = items.withColumn("prompt_version", F.lit("p1"))
    root = Scratch(spark).path("cohorts")
    publish = lambda part, limit: publication.publish_cohorts(part, runs, root, "p1", "2024-02-01T00:00:00+00:00", "readers", "top", limit)
    publish(items, 1000)
    publish(items.where("daily_rank <= 3 and day(cast(day as date)) % 2 = 0"), 3)
    return publication.published_cohorts(spark, root).drop("published_at")


def cohort_faults(spark, sf_dir):
    """Cohorts with one fault of each kind by day of the month."""
    items, n = _items(spark, sf_dir), F.dayofmonth(F.col("day").cast("date"))
    bad = items.where(n % 7 != 6).withColumns({
        "development_id": F.when((n % 7 == 1) & (F.col("daily_rank") == 2), F.lit("same")).otherwise(F.col("development_id")),
        "daily_rank": F.when((n % 7 == 2) & (F.col("daily_rank") == 2), 1).otherwise(F.col("daily_rank")),
    })
    runs = items.where(n % 7 != 3).withColumn("prompt_version", F.when(n % 7 == 4, "p0").otherwise("p1"))
    other = items.select(F.when(n % 7 == 5, F.lit("2023-12-31")).otherwise(F.col("day")).alias("day"), "development_id")
    out = publication.cohort_faults(bad, items.select("day").distinct(), other, runs, "p1")
    return out.groupBy("fault", "day").agg(F.count("*").alias("n"))


ITEMS = "items AS (SELECT ts::DATE::VARCHAR AS day, day(ts) AS n, 'd' || event_id AS development_id, row_number() OVER (PARTITION BY ts::DATE ORDER BY event_id) AS daily_rank FROM events WHERE event_type = 'purchase')"

QUERIES = [
    (
        "proven_coverage",
        proven_coverage,
        f"""WITH RECURSIVE {PAGES}, {ASKED}, p AS (SELECT pages.*, start_day, CASE WHEN NOT has_posts THEN 'no_posts' WHEN bad_time THEN 'bad_time' WHEN oldest < start_day THEN 'boundary' WHEN NOT has_next THEN 'terminal' WHEN next_cursor IS NULL THEN 'no_cursor' END AS stop
          FROM pages JOIN asked USING (handle) WHERE fetched_at >= end_day + INTERVAL 1 DAY),
        w AS (SELECT handle, 1 AS n, [cursor] AS seen, stop, next_cursor, newest, oldest FROM p WHERE cursor = ''
          UNION ALL SELECT p.handle, w.n + 1, list_append(w.seen, p.cursor), p.stop, p.next_cursor, p.newest, p.oldest FROM w JOIN p ON p.handle = w.handle AND p.cursor = w.next_cursor WHERE w.stop IS NULL AND w.n < {MAX_PAGES} AND NOT list_contains(w.seen, w.next_cursor)),
        l AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY handle ORDER BY n DESC) = 1),
        g AS (SELECT handle, count(*) AS pages, max(newest) AS newest, min(oldest) AS oldest FROM w WHERE stop IS NULL OR stop NOT IN ('no_posts', 'bad_time') GROUP BY 1),
        r AS (SELECT handle, CASE WHEN l.handle IS NULL THEN 'base_missing' WHEN stop IS NOT NULL THEN stop WHEN list_contains(seen, next_cursor) THEN 'repeated_cursor' WHEN n = {MAX_PAGES} THEN 'too_many_pages' ELSE 'cursor_missing' END AS reason FROM asked LEFT JOIN l USING (handle))
        SELECT handle, reason IN ('boundary', 'terminal') AS complete, reason, coalesce(pages, 0) AS pages, coalesce(strftime(newest, '%Y-%m-%d %H:%M:%S'), '') AS newest, coalesce(strftime(oldest, '%Y-%m-%d %H:%M:%S'), '') AS oldest FROM r LEFT JOIN g USING (handle)""",
    ),
    (
        "chosen_runs",
        chosen_runs,
        """WITH RECURSIVE r AS (SELECT user_id % 40 AS key, user_id || '-' || (event_id % 3) AS run_id, min(ts)::DATE AS f, min(ts)::DATE + (count(*) % 9)::INTEGER AS t FROM events GROUP BY user_id, event_id % 3),
        a AS (SELECT DISTINCT user_id % 40 AS key, DATE '2024-01-02' AS s, DATE '2024-01-05' + (user_id % 40 % 20)::INTEGER AS e FROM events),
        d AS (SELECT a.key, x::DATE AS day, e FROM a, range(DATE '2024-01-02', DATE '2024-02-01', INTERVAL 1 DAY) t(x) WHERE x <= e),
        b AS (SELECT d.key, d.day, d.e, r.run_id, r.t FROM d LEFT JOIN r ON r.key = d.key AND d.day BETWEEN r.f AND r.t QUALIFY row_number() OVER (PARTITION BY d.key, d.day ORDER BY r.t DESC NULLS LAST, r.f, r.run_id) = 1),
        w AS (SELECT key, day, e, run_id, t, CASE WHEN run_id IS NULL THEN [] ELSE [run_id] END AS ids FROM b WHERE day = DATE '2024-01-02'
          UNION ALL SELECT b.key, b.day, b.e, b.run_id, b.t, CASE WHEN b.run_id IS NULL THEN ids ELSE list_append(ids, b.run_id) END FROM w JOIN b ON b.key = w.key AND b.day = w.t + 1 WHERE w.run_id IS NOT NULL)
        SELECT key, run_id IS NOT NULL AS complete, CASE WHEN run_id IS NULL THEN day::VARCHAR ELSE '' END AS first_uncovered_day, array_to_string(ids, ',') AS run_ids FROM w QUALIFY row_number() OVER (PARTITION BY key ORDER BY day DESC) = 1""",
    ),
    (
        "republished_days",
        republished_days,
        f"""WITH {ITEMS}, p AS (SELECT *, CASE WHEN n % 2 = 0 THEN 3 ELSE 1000 END AS selection_limit FROM items WHERE n % 2 = 1 OR daily_rank <= 3),
        c AS (SELECT day, count(*) AS candidate_count, sha256('{{"audience":"readers","candidates":[' || string_agg('{{"daily_rank":' || daily_rank || ',"development_id":"' || development_id || '"}}', ',' ORDER BY daily_rank) || '],"selection_kind":"top","selection_limit":' || any_value(selection_limit) || '}}') AS selection_sha256 FROM p GROUP BY 1)
        SELECT day, development_id, daily_rank, selection_limit::BIGINT AS selection_limit, candidate_count, selection_sha256 FROM p JOIN c USING (day)""",
    ),
    (
        "cohort_faults",
        cohort_faults,
        f"""WITH {ITEMS}, bad AS (SELECT day, n, CASE WHEN n % 7 = 1 AND daily_rank = 2 THEN 'same' ELSE development_id END AS d, CASE WHEN n % 7 = 2 AND daily_rank = 2 THEN 1 ELSE daily_rank END AS r FROM items WHERE n % 7 <> 6),
        f AS (SELECT DISTINCT 'no_candidates' AS fault, day, NULL AS d FROM items WHERE n % 7 = 6 UNION SELECT 'repeated_development', day, d FROM bad GROUP BY day, d HAVING count(*) > 1 UNION SELECT 'repeated_rank', day, NULL FROM bad GROUP BY day, r HAVING count(*) > 1
          UNION SELECT 'several_days', min(day), d FROM bad GROUP BY d HAVING count(DISTINCT day) > 1 UNION SELECT 'other_day', '2023-12-31', development_id FROM items WHERE n % 7 = 5
          UNION SELECT 'no_completed_run', day, d FROM bad b WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.day = b.day AND i.development_id = b.d AND i.daily_rank = b.r AND i.n % 7 NOT IN (3, 4)))
        SELECT fault, day, count(*) AS n FROM f GROUP BY 1, 2""",
    ),
]
