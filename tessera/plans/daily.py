"""Queries over days: rank, votes, weeks, coverage, windows and publication."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import coverage, publication, rank
from tessera.operators import events as ev
from tessera.plans import adapters as ad

#: Users stand for entities with a position, five of their events in a row for an item, event types for roles.
VOTES = """
pos AS (SELECT user_id, round((2000000 * (rank() OVER (ORDER BY n) - 1) + count(*) OVER () - 1) // (2 * (count(*) OVER () - 1)) / 1000000, 6)::DECIMAL(7,6) AS position FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)),
e AS (SELECT events.*, 'i' || (event_id // 5) AS item, ts::DATE::VARCHAR AS day, position FROM events JOIN pos USING (user_id)),
items AS (SELECT day, item, first(position ORDER BY event_id) AS author_position, first(user_id ORDER BY event_id) AS author, max(floor(value)::BIGINT) AS public_interactions FROM e GROUP BY 1, 2),
votes AS (SELECT e.day, e.item, e.user_id AS entity, i.author, e.position FROM e JOIN items i ON i.day = e.day AND i.item = e.item WHERE event_type IN ('click', 'signup', 'view')),
v AS (SELECT day, item, entity, max(position) AS position FROM votes WHERE entity <> author GROUP BY 1, 2, 3),
layers AS (SELECT i.day, i.item, count(entity) AS trusted_votes, coalesce(round((2 * (sum(v.position) * 1000000)::BIGINT + count(entity)) // nullif(2 * count(entity), 0) / 1000000, 6), 0)::DECIMAL(7,6) AS mean_voter_position, any_value(author_position) AS author_position, any_value(public_interactions) AS public_interactions
  FROM items i LEFT JOIN v ON v.day = i.day AND v.item = i.item GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS daily_rank, lead(item) OVER w AS nx, lag(item) OVER w AS pv, lead(trusted_votes) OVER w AS n1, lead(mean_voter_position) OVER w AS n2, lead(author_position) OVER w AS n3, lead(public_interactions) OVER w AS n4,
  lag(trusted_votes) OVER w AS p1, lag(mean_voter_position) OVER w AS p2, lag(author_position) OVER w AS p3, lag(public_interactions) OVER w AS p4
  FROM layers WINDOW w AS (PARTITION BY day ORDER BY trusted_votes DESC, mean_voter_position DESC, author_position DESC, public_interactions DESC, item)),
ranked AS (SELECT day, item, trusted_votes, mean_voter_position::DOUBLE AS mean_voter_position, author_position::DOUBLE AS author_position, public_interactions, daily_rank, (CASE
  WHEN nx IS NOT NULL THEN CASE WHEN n1 <> trusted_votes THEN 1 WHEN n2 <> mean_voter_position THEN 2 WHEN n3 <> author_position THEN 3 WHEN n4 <> public_interactions THEN 4 ELSE 5 END
  WHEN pv IS NOT NULL THEN CASE WHEN p1 <> trusted_votes THEN 1 WHEN p2 <> mean_voter_position THEN 2 WHEN p3 <> author_position THEN 3 WHEN p4 <> public_interactions THEN 4 ELSE 5 END ELSE 5 END)::BIGINT AS decided_at_layer FROM r)
"""


def _ranked(spark, sf_dir):
    from tessera.operators.network import levels, position

    e = ad.table(spark, sf_dir, "events")
    per = e.groupBy("user_id").agg(F.count("*").alias("support"))
    pos = per.join(F.broadcast(levels(per)), "support").select("user_id", position(F.col("below"), F.col("total")).alias("position"))
    e = e.join(pos, "user_id").select("event_id", "user_id", "event_type", "value", "position", F.concat(F.lit("i"), F.floor(F.col("event_id") / 5)).alias("item"), F.to_date("ts").cast("string").alias("day"))
    items = e.groupBy("day", "item").agg(F.min_by("position", "event_id").alias("author_position"), F.min_by("user_id", "event_id").alias("author"), F.max(F.floor("value")).alias("public_interactions"))
    votes = e.where(F.col("event_type").isin("click", "signup", "view")).join(items.select("day", "item", "author"), ["day", "item"]).select("day", "item", F.col("user_id").alias("entity"), "author", "position")
    return rank.daily_rank(rank.inputs(items, votes))


def daily_rank(spark, sf_dir):
    return _ranked(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in ("mean_voter_position", "author_position")})


def _hits(spark, sf_dir):
    return ad.table(spark, sf_dir, "labels").select(F.concat(F.lit("i"), "doc_id").alias("item"), (F.col("quality") == 1).alias("hit"))


def vote_bucket_stats(spark, sf_dir):
    return rank.bucket_stats(_ranked(spark, sf_dir), _hits(spark, sf_dir))


def layer_distribution(spark, sf_dir):
    return rank.layer_distribution(_ranked(spark, sf_dir)).withColumn("day", F.coalesce("day", F.lit("all")))


def top_ranked(spark, sf_dir):
    return daily_rank(spark, sf_dir).where("daily_rank <= 10").select("day", "item", "daily_rank")


def rolling_week(spark, sf_dir):
    d = _ranked(spark, sf_dir).select((F.regexp_extract("item", r"(\d+)", 1).cast("long") % 40).alias("event"), F.to_date("day").alias("day"), "daily_rank", F.col("trusted_votes").alias("member_count"), F.col("item").alias("snapshot"))
    d = d.groupBy("event", "day").agg(F.min("daily_rank").alias("daily_rank"), F.max("member_count").alias("member_count"), F.max("snapshot").alias("snapshot"))
    seen = F.when(F.col("event") % 3 != 0, F.array("day", F.date_sub("day", 2), F.date_add("day", 3)))
    out = ev.week(d.withColumn("activity_days", seen), "2024-01-14", carried=("snapshot",))
    return out.select("event", "best_rank", F.col("best_day").cast("string").alias("best_day"), "member_count", F.col("revision_day").cast("string").alias("revision_day"), "snapshot", F.array_join(F.transform("active_days", lambda x: x.cast("string")), ",").alias("active_days"))


RUNS = "runs AS (SELECT user_id, (min(ts))::DATE AS date_from, (min(ts))::DATE + (count(*) % 4)::INTEGER AS date_to FROM events GROUP BY user_id, event_id % 3)"


def _runs(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events")
    return e.groupBy("user_id", (F.col("event_id") % 3).alias("g")).agg(F.to_date(F.min("ts")).alias("date_from"), (F.count("*") % 4).cast("int").alias("n")).select("user_id", "date_from", F.expr("date_add(date_from, n)").alias("date_to"))


def covered_days(spark, sf_dir):
    return coverage.covered_days(_runs(spark, sf_dir), "2024-01-01", "2024-01-31").withColumn("day", F.col("day").cast("string"))


def missing_days(spark, sf_dir):
    return coverage.missing_days(_runs(spark, sf_dir), "2024-01-01", "2024-02-10").select(F.col("day").cast("string").alias("day"))


def day_islands(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", F.to_date("ts").alias("day"))
    return coverage.islands(e, ["user_id"]).select("user_id", F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"), "n_days")


def merged_intervals(spark, sf_dir):
    return coverage.merged_intervals(_runs(spark, sf_dir), ["user_id"]).select("user_id", F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"))


def complete_days(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events")
    pages = e.select(F.col("user_id").alias("key"), F.to_date("ts").alias("day"), F.expr("cast(ts as timestamp) + make_interval(0, 0, 0, 0, cast(value % 40 as int))").alias("observed_at"), F.expr("cast(ts as timestamp) - make_interval(0, 0, 0, 0, cast(event_id % 24 as int))").alias("oldest"), (F.col("event_id") % 7 == 0).alias("is_last"))
    return coverage.complete_days(pages).withColumn("day", F.col("day").cast("string"))


def tumbling_days(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 day").start.cast("date").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


def sliding_weeks(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "7 days", "1 day").end.cast("date").cast("string").alias("before_day")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


def published_days(spark, sf_dir):
    runs, pointers = publication_tables(spark, sf_dir)
    return publication.current(runs, pointers).select(F.col("day").cast("string").alias("day"), "run_id", "rows")


def publication_tables(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    runs = e.groupBy("day", F.concat(F.lit("r"), F.col("event_id") % 3).alias("run_id")).agg(F.count("*").alias("rows"))
    log = e.where("event_type = 'purchase'").select("day", F.concat(F.lit("r"), F.col("event_id") % 3).alias("run_id"), F.col("ts").alias("published_at"), "event_id")
    return runs, publication.pointers(log, "event_id")


QUERIES = [
    ("daily_rank", daily_rank, f"WITH {VOTES} SELECT * FROM ranked"),
    ("top_ranked", top_ranked, f"WITH {VOTES} SELECT day, item, daily_rank FROM ranked WHERE daily_rank <= 10"),
    (
        "vote_bucket_stats",
        vote_bucket_stats,
        f"""WITH {VOTES}, h AS (SELECT 'i' || doc_id AS item, quality = 1 AS hit FROM labels),
        b AS (SELECT unnest(['0', '1', '2', '3-4', '5+']) AS bucket),
        j AS (SELECT CASE WHEN trusted_votes <= 0 THEN '0' WHEN trusted_votes = 1 THEN '1' WHEN trusted_votes = 2 THEN '2' WHEN trusted_votes <= 4 THEN '3-4' ELSE '5+' END AS bucket, hit FROM ranked LEFT JOIN h USING (item)),
        g AS (SELECT bucket, count(*) AS n, count(hit) AS labelled, sum(hit::INTEGER) AS hits FROM j GROUP BY 1)
        SELECT bucket, coalesce(n, 0)::BIGINT AS n, round(coalesce(n, 0) / sum(n) OVER (), 6) AS share, coalesce(labelled, 0)::BIGINT AS labelled, round(hits / nullif(labelled, 0), 6) AS hit_rate FROM b LEFT JOIN g USING (bucket)""",
    ),
    (
        "layer_distribution",
        layer_distribution,
        f"WITH {VOTES} SELECT day, decided_at_layer AS layer, count(*) AS n FROM ranked GROUP BY 1, 2 UNION ALL SELECT 'all', decided_at_layer, count(*) FROM ranked GROUP BY 2",
    ),
    (
        "rolling_week",
        rolling_week,
        f"""WITH {VOTES}, d AS (SELECT regexp_extract(item, '[0-9]+')::BIGINT % 40 AS event, day::DATE AS day, min(daily_rank) AS daily_rank, max(trusted_votes) AS m, max(item) AS snapshot FROM ranked WHERE day BETWEEN '2024-01-08' AND '2024-01-14' GROUP BY 1, 2),
        a AS (SELECT DISTINCT event, (day + k)::DATE AS x FROM d, (SELECT unnest([0, -2, 3])::INTEGER AS k) WHERE k = 0 OR event % 3 <> 0), g AS (SELECT event, string_agg(x::VARCHAR, ',' ORDER BY x) AS active_days FROM a WHERE x BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' GROUP BY 1)
        SELECT event, min(daily_rank) AS best_rank, first(day::VARCHAR ORDER BY daily_rank, day) AS best_day, max(m) AS member_count, first(day::VARCHAR ORDER BY m DESC, day DESC) AS revision_day, first(snapshot ORDER BY m DESC, day DESC) AS snapshot, any_value(active_days) AS active_days FROM d JOIN g USING (event) GROUP BY 1""",
    ),
    (
        "covered_days",
        covered_days,
        f"WITH {RUNS}, d AS (SELECT unnest(range(DATE '2024-01-01', DATE '2024-02-01', INTERVAL 1 DAY))::DATE AS day) SELECT day::VARCHAR AS day, count(user_id) AS runs FROM d LEFT JOIN runs ON day BETWEEN date_from AND date_to GROUP BY 1",
    ),
    (
        "missing_days",
        missing_days,
        f"WITH {RUNS}, d AS (SELECT unnest(range(DATE '2024-01-01', DATE '2024-02-11', INTERVAL 1 DAY))::DATE AS day) SELECT day::VARCHAR AS day FROM d WHERE NOT EXISTS (SELECT 1 FROM runs WHERE day BETWEEN date_from AND date_to)",
    ),
    (
        "day_islands",
        day_islands,
        """WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events WHERE event_type = 'error'), g AS (SELECT *, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INTEGER AS g FROM d)
        SELECT user_id, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day, count(*) AS n_days FROM g GROUP BY user_id, g""",
    ),
    (
        "merged_intervals",
        merged_intervals,
        f"""WITH {RUNS}, s AS (SELECT *, max(date_to) OVER (PARTITION BY user_id ORDER BY date_from, date_to ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT DISTINCT user_id, date_from, date_to FROM runs)),
        g AS (SELECT *, sum((reach IS NULL OR date_from > reach + 1)::INTEGER) OVER (PARTITION BY user_id ORDER BY date_from, date_to ROWS UNBOUNDED PRECEDING) AS g FROM s)
        SELECT user_id, min(date_from)::VARCHAR AS first_day, max(date_to)::VARCHAR AS last_day FROM g GROUP BY user_id, g""",
    ),
    (
        "complete_days",
        complete_days,
        """SELECT user_id AS key, ts::DATE::VARCHAR AS day, bool_or(ts + to_hours((floor(value % 40))::INTEGER) >= ts::DATE + INTERVAL 1 DAY AND (ts - to_hours((event_id % 24)::INTEGER) <= ts::DATE OR event_id % 7 = 0)) AS complete FROM events GROUP BY 1, 2""",
    ),
    ("tumbling_days", tumbling_days, "SELECT ts::DATE::VARCHAR AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2"),
    (
        "sliding_weeks",
        sliding_weeks,
        "WITH o AS (SELECT unnest(range(1, 8)) AS k) SELECT (ts::DATE + k::INTEGER)::VARCHAR AS before_day, count(*) AS n, count(DISTINCT user_id) AS users FROM events, o GROUP BY 1",
    ),
    (
        "published_days",
        published_days,
        """WITH p AS (SELECT ts::DATE AS day, 'r' || (event_id % 3) AS run_id FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY ts::DATE ORDER BY ts DESC, event_id DESC) = 1),
        r AS (SELECT ts::DATE AS day, 'r' || (event_id % 3) AS run_id, count(*) AS rows FROM events GROUP BY 1, 2) SELECT day::VARCHAR AS day, run_id, rows FROM r JOIN p USING (day, run_id)""",
    ),
]
