"""Queries over posts: the events table as a log of posts with quotes, retweets and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import events as ev
from tessera.operators import feed, upserts
from tessera.plans import adapters as ad
from tessera.session import Scratch

POSTS = """
e AS (SELECT *, (props::JSON->>'k')::BIGINT AS k, CASE WHEN event_id % 10 = 0 THEN 'purchase' ELSE event_type END AS t FROM events),
posts AS (SELECT lpad(event_id::VARCHAR, 10, '0') AS post_id, 'a' || (user_id % 7) AS author,
  CASE t WHEN 'click' THEN 'retweet' WHEN 'signup' THEN 'quote' WHEN 'view' THEN 'reply' ELSE 'original' END AS post_type,
  CASE WHEN t = 'view' AND event_id > k % 5 THEN lpad((event_id - 1 - k % 5)::VARCHAR, 10, '0') END AS in_reply_to,
  CASE WHEN t = 'view' AND event_id > k % 5 THEN lpad((event_id - event_id % 10)::VARCHAR, 10, '0') END AS conversation_id,
  ts AS discovered_at, ts::DATE AS day, date_trunc('day', ts) - to_hours((k % 3)::INTEGER) AS published_at, event_id % 3 = 0 AS direct FROM e),
relations AS (SELECT lpad(event_id::VARCHAR, 10, '0') AS source_id, CASE t WHEN 'click' THEN 'retweet' ELSE 'quote' END AS relation_type,
  CASE WHEN k % 10 = 0 THEN 'x' || (event_id % 50) ELSE lpad((event_id - 1 - k % 20)::VARCHAR, 10, '0') END AS target_id, ts AS discovered_at
  FROM e WHERE t IN ('click', 'signup') AND event_id > k % 20)
"""
LINKS = f"""{POSTS},
links0 AS (SELECT r.source_id, r.target_id, r.relation_type AS link_type FROM relations r JOIN posts p ON p.post_id = r.source_id AND p.in_reply_to IS NULL
  WHERE r.relation_type = p.post_type AND NOT EXISTS (SELECT 1 FROM posts q WHERE q.post_id = r.target_id AND q.in_reply_to IS NOT NULL)),
reps AS (SELECT p.*, c.author AS ra FROM posts p JOIN posts c ON c.post_id = p.conversation_id AND c.author = p.author WHERE p.in_reply_to IS NOT NULL),
links AS (SELECT * FROM links0 UNION ALL SELECT r.post_id, CASE WHEN q.author = r.ra THEN r.in_reply_to ELSE r.conversation_id END, CASE WHEN q.author = r.ra THEN 'reply_parent' ELSE 'primary_thread' END
  FROM reps r LEFT JOIN posts q ON q.post_id = r.in_reply_to)
"""
ROOTS = f"""{LINKS},
up(node, cur, depth) AS (SELECT source_id, target_id, 1 FROM links UNION ALL SELECT node, l.target_id, depth + 1 FROM up JOIN links l ON l.source_id = up.cur),
top AS (SELECT node, cur AS root, depth FROM up WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.source_id = up.cur) UNION SELECT DISTINCT cur, cur, 0 FROM up WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.source_id = up.cur)),
seen AS (SELECT root, node AS post_id, depth, EXISTS (SELECT 1 FROM posts p WHERE p.post_id = node) AS captured FROM top),
mem AS (SELECT * FROM seen WHERE root IN (SELECT root FROM seen GROUP BY 1 HAVING count(*) FILTER (captured) > 1 OR count(*) FILTER (captured) = 1 AND count(*) FILTER (NOT captured) > 0))
"""
W = "WITH RECURSIVE "


def base(spark, sf_dir):
    """The events table with its payload's k and the type that this adapter gives each row."""
    e = ad.table(spark, sf_dir, "events")
    return e.withColumns({"k": F.get_json_object("props", "$.k").cast("long"), "t": F.when(F.col("event_id") % 10 == 0, "purchase").otherwise(F.col("event_type"))})


def _pid(x):
    return F.lpad(x.cast("string"), 10, "0")


def posts(spark, sf_dir):
    e, i, k = base(spark, sf_dir), F.col("event_id"), F.col("k")
    kind = F.when(F.col("t") == "click", "retweet").when(F.col("t") == "signup", "quote").when(F.col("t") == "view", "reply").otherwise("original")
    reply = (F.col("t") == "view") & (i > k % 5)
    return e.select(_pid(i).alias("post_id"), F.concat(F.lit("a"), F.col("user_id") % 7).alias("author"), kind.alias("post_type"), F.when(reply, _pid(i - 1 - k % 5)).alias("in_reply_to"), F.when(reply, _pid(i - i % 10)).alias("conversation_id"), F.col("ts").alias("discovered_at"), F.to_date("ts").alias("day"), (F.date_trunc("day", "ts") - F.expr("make_interval(0, 0, 0, 0, cast(k % 3 as int))")).alias("published_at"), (i % 3 == 0).alias("direct"))


def relations(spark, sf_dir):
    e, i, k = base(spark, sf_dir), F.col("event_id"), F.col("k")
    target = F.when(k % 10 == 0, F.concat(F.lit("x"), i % 50)).otherwise(_pid(i - 1 - k % 20))
    return e.where(F.col("t").isin("click", "signup") & (i > k % 20)).select(_pid(i).alias("source_id"), F.when(F.col("t") == "click", "retweet").otherwise("quote").alias("relation_type"), target.alias("target_id"), F.col("ts").alias("discovered_at"))


def _links(spark, sf_dir, p=None):
    """Links of the posts, which are parsed and written once."""
    p = _written(spark, sf_dir) if p is None else p
    return Scratch(spark).write(ev.all_links(spark, p, relations(spark, sf_dir)), "links")


def _written(spark, sf_dir):
    return Scratch(spark).write(posts(spark, sf_dir), "posts")


def _members(spark, sf_dir, links=None, p=None):
    p = _written(spark, sf_dir) if p is None else p
    links = _links(spark, sf_dir, p) if links is None else links
    return Scratch(spark).write(ev.members(spark, p, links), "members")


def structural_links(spark, sf_dir):
    return _links(spark, sf_dir)


def event_members(spark, sf_dir):
    return _members(spark, sf_dir)


def event_clusters(spark, sf_dir):
    p = _written(spark, sf_dir)
    out = ev.clusters(p, _members(spark, sf_dir, None, p))
    return out.withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


def event_forest_rows(spark, sf_dir):
    p = _written(spark, sf_dir)
    links = _links(spark, sf_dir, p)
    return ev.forest_rows(_members(spark, sf_dir, links, p), links, p)


def event_singletons(spark, sf_dir):
    rejected = spark.createDataFrame([("a3",)], "author string")
    p = _written(spark, sf_dir)
    return ev.singletons(p, _members(spark, sf_dir, None, p), rejected).select("event_id", "post_id", "author", F.col("day").cast("string").alias("day"))


def cutoff_components(spark, sf_dir):
    rejected = spark.createDataFrame([("a3",)], "author string")
    p = _written(spark, sf_dir)
    v = ev.visible_links(p, _links(spark, sf_dir, p), "2024-01-12", rejected)
    return ev.roots(spark, v)


def later_members(spark, sf_dir):
    p = _written(spark, sf_dir)
    links = _links(spark, sf_dir, p)
    none = spark.createDataFrame([], "author string")
    frozen = Scratch(spark).write(ev.roots(spark, ev.visible_links(p, links, "2024-01-12", none)), "frozen")
    own = frozen.select(F.col("node").alias("post_id"), F.col("root").alias("event"))
    return ev.assign_later(spark, own, links, p)


def canonical_days(spark, sf_dir):
    p = _written(spark, sf_dir)
    mem = _members(spark, sf_dir, None, p).join(p.select("post_id", "day", "post_type"), "post_id")
    items = mem.select(F.col("root").alias("event"), "post_id", "day", (F.col("post_type") != "retweet").alias("direct"))
    return ev.canonical_day(items).withColumn("day", F.col("day").cast("string"))


def first_observations(spark, sf_dir):
    log = ad.table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return upserts.first_observation(log, ["user_id", "event_type"], "ts", "event_id").drop("ts")


def latest_observations(spark, sf_dir):
    log = ad.table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return upserts.latest(log, ["user_id", "event_type"], "ts", "event_id").drop("ts")


def folded_log(spark, sf_dir):
    e = base(spark, sf_dir)
    log = e.select("user_id", "ts", "event_id", F.when(F.col("k") % 3 != 0, F.col("k")).alias("k"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("paid"))
    return upserts.fold_log(log, ["user_id"], ["ts", "event_id"], ["k", "paid"]).fillna(-1, ["k", "paid"])


def widened(spark, sf_dir):
    out = upserts.widen(base(spark, sf_dir), ["user_id", "event_type"], "ts", "ts", ["ts", "event_id"], "k")
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_seen", "last_seen")})


def changed_rows(spark, sf_dir):
    e = base(spark, sf_dir)
    one = lambda d: upserts.latest(d, ["user_id"], "ts", "event_id").select("user_id", F.when(F.col("k") % 4 != 0, F.col("k") % 4).alias("k"))
    old = one(e.where("ts < '2024-01-10'")).withColumn("user_id", F.when(F.col("user_id") % 5 == 0, -F.col("user_id") - 1).otherwise(F.col("user_id")))
    return upserts.changed(old, one(e), ["user_id"], ["k"]).withColumn("k", F.coalesce("k", F.lit(-1).cast("long")))


def reconciled(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events")
    half = lambda when: e.where(when).select("user_id", "event_type", F.hour("ts").cast("long").alias("hour"))
    return upserts.reconcile(half("ts < '2024-01-16'"), half("ts >= '2024-01-16'"), ["user_id", "event_type", "hour"])


def insert_new_counts(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events")
    return upserts.insert_counts(e.where("ts < '2024-01-03'"), e.where("ts >= '2024-01-03'"), ["user_id", "event_type"])


def anchors(spark, sf_dir):
    p, r = posts(spark, sf_dir), relations(spark, sf_dir)
    log = p.select("post_id", F.lit(1).alias("renderable"), F.lit("direct").alias("role")).union(r.select(F.col("target_id").alias("post_id"), F.lit(0).alias("renderable"), F.lit("embedded").alias("role")))
    return upserts.anchors(log).select("post_id", F.col("renderable").cast("long").alias("renderable"), F.array_join("roles", ",").alias("roles"))


def retained_replies(spark, sf_dir):
    return feed.retained(posts(spark, sf_dir), relations(spark, sf_dir)).select("post_id", "in_reply_to", "conversation_id")


def shared_opaque_targets(spark, sf_dir):
    return feed.shared_targets(relations(spark, sf_dir), posts(spark, sf_dir))


def _amps(spark, sf_dir):
    r = relations(spark, sf_dir).join(posts(spark, sf_dir).select(F.col("post_id").alias("source_id"), F.col("author").alias("entity")), "source_id")
    return feed.amplifiers(r)


def feed_amplifiers(spark, sf_dir):
    return _amps(spark, sf_dir).select("target_id", "entity", "relation_type", "source_id")


def feed_items(spark, sf_dir):
    rejected = spark.createDataFrame([("a3",)], "author string")
    items = posts(spark, sf_dir).where("post_type <> 'retweet'").select("post_id", "author", (F.col("post_type") == "original").alias("direct"))
    return feed.visible_items(items, _amps(spark, sf_dir), rejected)


AMPS = """amps AS (SELECT target_id, entity, relation_type, source_id FROM (SELECT r.*, p.author AS entity, row_number() OVER (PARTITION BY target_id, p.author ORDER BY (relation_type = 'quote') DESC, r.discovered_at, source_id) AS n
  FROM relations r JOIN posts p ON p.post_id = r.source_id) WHERE n = 1)"""
VISIBLE = """vis AS (SELECT l.* FROM links l JOIN posts p ON p.post_id = l.source_id WHERE p.author <> '{no}' AND p.day <= DATE '2024-01-12'
  AND NOT EXISTS (SELECT 1 FROM posts q WHERE q.post_id = l.target_id AND q.author = '{no}' AND q.day <= DATE '2024-01-12')),
vup(node, cur, depth) AS (SELECT source_id, target_id, 1 FROM vis UNION ALL SELECT node, l.target_id, depth + 1 FROM vup JOIN vis l ON l.source_id = vup.cur),
vtop AS (SELECT node, cur AS root, depth FROM vup WHERE NOT EXISTS (SELECT 1 FROM vis l WHERE l.source_id = vup.cur) UNION SELECT DISTINCT cur, cur, 0 FROM vup WHERE NOT EXISTS (SELECT 1 FROM vis l WHERE l.source_id = vup.cur))"""

QUERIES = [
    ("structural_links", structural_links, f"WITH {LINKS} SELECT * FROM links"),
    ("event_members", event_members, f"{W}{ROOTS} SELECT root, post_id, depth::BIGINT AS depth, captured FROM mem"),
    (
        "event_clusters",
        event_clusters,
        f"""{W}{ROOTS} SELECT sha256('["x","' || root || '"]') AS event_id, root, first(post_id ORDER BY least(depth, 2), discovered_at, published_at, NOT direct, post_id) FILTER (captured) AS representative,
        count(*) FILTER (captured) AS members, count(*) FILTER (depth > 0) AS links, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day, count(DISTINCT day) AS n_days
        FROM mem LEFT JOIN posts USING (post_id) GROUP BY root""",
    ),
    (
        "event_forest_rows",
        event_forest_rows,
        f"""{W}{ROOTS} SELECT root, m.post_id, l.target_id AS parent_id, CASE WHEN l.link_type IN ('reply_parent', 'primary_thread') THEN 'reply' WHEN l.link_type IS NOT NULL THEN l.link_type WHEN depth = 0 THEN 'root' ELSE 'related' END AS relation,
        depth::BIGINT AS depth, EXISTS (SELECT 1 FROM posts q WHERE q.post_id = l.target_id) AS parent_captured FROM mem m LEFT JOIN links l ON l.source_id = m.post_id WHERE captured""",
    ),
    (
        "event_singletons",
        event_singletons,
        f"""{W}{ROOTS} SELECT sha256('["x","' || post_id || '"]') AS event_id, post_id, author, day::VARCHAR AS day FROM posts p WHERE in_reply_to IS NULL AND author <> 'a3' AND NOT EXISTS (SELECT 1 FROM mem m WHERE m.post_id = p.post_id)""",
    ),
    ("cutoff_components", cutoff_components, f"{W}{LINKS}, {VISIBLE.format(no='a3')} SELECT node, root, depth::BIGINT AS depth FROM vtop"),
    (
        "later_members",
        later_members,
        f"""{W}{LINKS}, {VISIBLE.format(no='none')},
        lat AS (SELECT * FROM links WHERE source_id NOT IN (SELECT node FROM vtop)),
        lup(node, cur) AS (SELECT source_id, target_id FROM lat UNION ALL SELECT node, l.target_id FROM lup JOIN lat l ON l.source_id = lup.cur)
        SELECT l.node AS post_id, v.root AS event FROM lup l JOIN vtop v ON v.node = l.cur WHERE l.node IN (SELECT post_id FROM posts)""",
    ),
    (
        "canonical_days",
        canonical_days,
        f"""{W}{ROOTS}, i AS (SELECT root AS event, post_id, day, post_type <> 'retweet' AS direct, min(day) FILTER (post_type <> 'retweet') OVER (PARTITION BY root) AS d FROM mem JOIN posts USING (post_id))
        SELECT event, post_id, day::VARCHAR AS day, direct FROM i WHERE day = d""",
    ),
    ("first_observations", first_observations, "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1"),
    ("latest_observations", latest_observations, "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"),
    (
        "folded_log",
        folded_log,
        f"""WITH {POSTS}, l AS (SELECT user_id, ts, event_id, CASE WHEN k % 3 <> 0 THEN k END AS k, CASE WHEN event_type = 'purchase' THEN value END AS paid FROM e)
        SELECT user_id, coalesce(last(k ORDER BY ts, event_id) FILTER (k IS NOT NULL), -1) AS k, coalesce(last(paid ORDER BY ts, event_id) FILTER (paid IS NOT NULL), -1) AS paid FROM l GROUP BY 1""",
    ),
    ("widened_observations", widened, f"WITH {POSTS} SELECT user_id, event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, last(k ORDER BY ts, event_id) AS k FROM e GROUP BY 1, 2"),
    (
        "changed_rows",
        changed_rows,
        f"""WITH {POSTS}, s AS (SELECT user_id, ts, event_id, CASE WHEN k % 4 <> 0 THEN k % 4 END AS k FROM e),
        o AS (SELECT CASE WHEN user_id % 5 = 0 THEN -user_id - 1 ELSE user_id END AS user_id, k FROM s WHERE ts < '2024-01-10' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
        n AS (SELECT user_id, k FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
        SELECT n.user_id, coalesce(n.k, -1)::BIGINT AS k, CASE WHEN o.user_id IS NULL THEN 'inserted' ELSE 'updated' END AS change FROM n LEFT JOIN o USING (user_id) WHERE o.user_id IS NULL OR n.k IS DISTINCT FROM o.k""",
    ),
    (
        "reconciled_keys",
        reconciled,
        """WITH k AS (SELECT user_id, event_type, hour(ts) AS hour, ts < '2024-01-16' AS early FROM events), a AS (SELECT DISTINCT user_id, event_type, hour FROM k WHERE early), b AS (SELECT DISTINCT user_id, event_type, hour FROM k WHERE NOT early)
        SELECT *, 'missing' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'extra' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    ),
    (
        "insert_new_counts",
        insert_new_counts,
        """SELECT count(*) FILTER (NOT had) AS new, count(*) AS total FROM (SELECT user_id, event_type, bool_or(ts < '2024-01-03') AS had FROM events GROUP BY 1, 2)""",
    ),
    (
        "anchor_roles",
        anchors,
        f"""WITH {POSTS}, l AS (SELECT post_id, 1 AS renderable, 'direct' AS role FROM posts UNION ALL SELECT target_id, 0, 'embedded' FROM relations)
        SELECT post_id, max(renderable)::BIGINT AS renderable, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM l GROUP BY 1""",
    ),
    (
        "retained_replies",
        retained_replies,
        f"""WITH {POSTS} SELECT post_id, in_reply_to, conversation_id FROM posts WHERE in_reply_to IS NULL OR conversation_id IN (SELECT post_id FROM posts WHERE in_reply_to IS NULL UNION SELECT target_id FROM relations)""",
    ),
    ("shared_opaque_targets", shared_opaque_targets, f"WITH {POSTS} SELECT target_id, count(DISTINCT source_id) AS sources FROM relations WHERE target_id NOT IN (SELECT post_id FROM posts) GROUP BY 1 HAVING count(DISTINCT source_id) > 1"),
    ("feed_amplifiers", feed_amplifiers, f"WITH {POSTS}, {AMPS} SELECT * FROM amps"),
    (
        "feed_items",
        feed_items,
        f"""WITH {POSTS}, {AMPS}, i AS (SELECT post_id, author, post_type = 'original' AS direct FROM posts WHERE post_type <> 'retweet')
        SELECT post_id, author, direct, count(DISTINCT entity) FILTER (entity <> author AND entity <> 'a3') AS amplifiers FROM i LEFT JOIN amps ON target_id = post_id GROUP BY 1, 2, 3
        HAVING (direct AND author <> 'a3') OR count(DISTINCT entity) FILTER (entity <> author AND entity <> 'a3') > 0""",
    ),
]
