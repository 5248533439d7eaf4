"""Queries over lineage, packets, forests, registry changes and streams; posts are those of plans.posts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import hashing, text
from tessera.operators import artifacts as art
from tessera.operators import developments as dev
from tessera.operators import events as ev
from tessera.operators import feed, insights, packets, registry, upserts
from tessera.operators import lineage as lin
from tessera.plans import adapters as ad
from tessera.plans.posts import POSTS, ROOTS, W, _links, _members, _written, base, posts, relations
from tessera.session import Scratch
from tessera.streaming import streams


def _posts(spark, sf_dir):
    p = posts(spark, sf_dir)
    return p.select("post_id", F.when(F.substring("post_id", 10, 1) != "7", F.col("author")).otherwise("").alias("author_id"), F.coalesce("conversation_id", F.lit("")).alias("conversation_id"), "post_type", F.md5("post_id").alias("raw_sha256"), "author", "day", "discovered_at")


def _items(spark, sf_dir):
    p = _posts(spark, sf_dir).where("post_type <> 'retweet'")
    later = F.explode(F.sequence(F.lit(0), F.when(F.substring("post_id", 9, 1) < "5", 1).otherwise(0))).alias("d")
    return p.select("post_id", "day", later).select(F.date_add("day", F.col("d")).alias("day"), F.concat(F.lit("e"), "post_id").alias("event_id"), F.col("post_id").alias("root_id"), (F.substring("post_id", 6, 5).cast("long") % 97 + F.col("d")).alias("daily_rank"))


def _evidence(spark, sf_dir):
    p = _posts(spark, sf_dir)
    n = F.substring("post_id", 4, 7).cast("long")
    url = F.when(n % 11 == 0, F.concat(F.lit("https://x.com/i/article/"), n)).otherwise(F.concat(F.lit("https://h.example/p"), n % 50))
    return p.where(n % 2 == 0).select("post_id", F.when(n % 10 == 0, F.lit("other")).otherwise(F.col("post_id")).alias("owner_id"), F.lit("https://t.co/a").alias("observed_url"), url.alias("expanded_url"))


LIN = f"""{POSTS},
lp AS (SELECT post_id, CASE WHEN post_id[10] <> '7' THEN author ELSE '' END AS author_id, coalesce(conversation_id, '') AS conversation_id, post_type, md5(post_id) AS raw_sha256, author, day, discovered_at, post_id::BIGINT AS n FROM posts),
items AS (SELECT day + d::INTEGER AS day, 'e' || post_id AS event_id, post_id AS root_id, substr(post_id, 6, 5)::BIGINT % 97 + d AS daily_rank FROM lp, (VALUES (0), (1)) AS v(d) WHERE post_type <> 'retweet' AND (d = 0 OR post_id[9] < '5')),
evid AS (SELECT post_id, CASE WHEN n % 10 = 0 THEN 'other' ELSE post_id END AS owner_id, 'https://t.co/a' AS observed_url, CASE WHEN n % 11 = 0 THEN 'https://x.com/i/article/' || n ELSE 'https://h.example/p' || (n % 50) END AS expanded_url FROM lp WHERE n % 2 = 0),
prim AS (SELECT DISTINCT root_id, root_id AS post_id FROM items UNION SELECT DISTINCT i.root_id, q.post_id FROM items i JOIN lp r ON r.post_id = i.root_id AND r.author_id <> '' JOIN lp q ON q.author_id = r.author_id AND q.post_type = 'reply' AND q.conversation_id = coalesce(nullif(r.conversation_id, ''), r.post_id)),
src AS (SELECT event_id, p.post_id, min(struct_pack(d := i.day, r := daily_rank)) AS f FROM items i JOIN prim p USING (root_id) JOIN lp ON lp.post_id = p.post_id
  WHERE NOT EXISTS (SELECT 1 FROM lp r LEFT JOIN lp c ON c.post_id = r.conversation_id WHERE r.post_id = i.root_id AND r.post_type = 'reply' AND (c.author_id IS NULL OR c.author_id = '' OR c.author_id <> r.author_id)) GROUP BY ALL)"""


def primary_posts(spark, sf_dir):
    return lin.primary_posts(_posts(spark, sf_dir), _items(spark, sf_dir))


def lineage_candidates(spark, sf_dir):
    c = lin.artifact_candidates(_items(spark, sf_dir), _posts(spark, sf_dir), _evidence(spark, sf_dir))
    return c.select("event_id", "post_id", F.col("day").cast("string").alias("day"), "daily_rank", "day_candidates", "decision", "reason", "relation", F.coalesce("canonical_url", F.lit("")).alias("canonical_url"))


def lineage_audit(spark, sf_dir):
    """A catalogue made from the posts, with every kind of fault put in."""
    p = _posts(spark, sf_dir).withColumn("feed_run", F.lit("f1"))
    n = F.substring("post_id", 4, 7).cast("long")
    runs = spark.createDataFrame([("r1", "f1", "own"), ("r0", "f1", "old")], "run_id string, feed_run string, policy string")
    e = _evidence(spark, sf_dir).join(p, "post_id").withColumn("n", n)
    k = F.col("n")
    acc = e.select(
        F.concat(F.lit("c"), "post_id").alias("candidate_id"), F.concat(F.lit("e"), "post_id").alias("event_id"), F.when(k % 14 != 0, F.concat(F.lit("a"), k % 50)).alias("artifact_id"), F.lit("x_post").alias("source_kind"), F.when(k % 18 == 0, "else").otherwise("twitterapi_io").alias("source_provider"),
        F.when(k % 26 == 0, F.concat(F.lit("lost"), "post_id")).otherwise(F.col("post_id")).alias("source_id"), F.when(k % 22 == 0, "old").otherwise(F.col("raw_sha256")).alias("source_sha256"), "observed_url", F.when(k % 34 == 0, "https://u.example/").otherwise(F.col("expanded_url")).alias("expanded_url"), F.lit("r1").alias("run_id"),
    )
    ev_ = _evidence(spark, sf_dir).select(F.lit("f1").alias("feed_run"), "post_id", "expanded_url")
    obs = acc.select(F.concat(F.lit("o"), "candidate_id").alias("observation_id"), "artifact_id", "source_id", "source_sha256", "observed_url").where("artifact_id is not null")
    stray = spark.createDataFrame([("oz", "az", "s", "h", "u")], "observation_id string, artifact_id string, source_id string, source_sha256 string, observed_url string")
    obs = obs.union(stray)
    disclosed = obs.where("observation_id not like '%8'").select("observation_id")
    arts = obs.select("artifact_id").distinct().union(spark.createDataFrame([("bare",), ("kept",)], "artifact_id string"))
    kept = spark.createDataFrame([("kept",)], "artifact_id string")
    return lin.lineage_faults(runs, acc, p, ev_, obs, disclosed, arts, kept, "own")


def listed_artifacts(spark, sf_dir):
    p = ad.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("artifact_id"), F.concat(F.lit("e"), F.col("p_partkey") % 60).alias("source_event"), F.col("p_size").cast("long").alias("best_source_rank"), F.col("p_brand").alias("source_published_at"))
    d = ad.table(spark, sf_dir, "supplier").where("s_suppkey < 40").select(F.concat(F.lit("e"), "s_suppkey").alias("event_id"), F.col("s_name").alias("development_id"), (F.col("s_suppkey") * 7 % 41).alias("daily_rank"))
    ordered = lin.reader_order(p, d)
    return ordered.select("artifact_id", F.coalesce("development_id", F.lit("")).alias("development_id"), "best_source_rank")


def first_listed(spark, sf_dir):
    p = ad.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("artifact_id"), F.lit("e").alias("source_event"), F.col("p_size").cast("long").alias("best_source_rank"), F.col("p_brand").alias("source_published_at"))
    none = spark.createDataFrame([], "event_id string, development_id string, daily_rank long")
    return lin.shown_first(lin.reader_order(p, none), 25, 10).select("artifact_id")


def _packet_posts(spark, sf_dir):
    c = ad.table(spark, sf_dir, "conversations")
    day = F.date_add(F.lit("2024-01-10").cast("date"), (F.col("turn") * 5 % 13 - 11).cast("int"))
    return c.select(
        (F.col("conv_id") % 40).alias("packet"), F.concat(F.lit("e"), "conv_id").alias("event_id"), (F.col("conv_id") < 40).alias("is_primary"), F.col("conv_id").alias("daily_rank"), (F.col("turn") == 0).alias("is_root"), F.lit("u").alias("root_author"),
        F.concat(F.lit("p"), F.when(F.col("turn") == 1, F.col("conv_id") % 40).otherwise(F.col("conv_id") * 100 + F.col("turn"))).alias("post_id"), F.when(F.col("turn") % 4 == 3, "V").otherwise("U").alias("author"), "text", day.alias("published"), F.when(F.col("turn") % 6 == 5, "retweet").otherwise("reply").alias("relationship"), F.col("turn").alias("place"),
    )


PACK = """pp AS (SELECT conv_id % 40 AS packet, conv_id, turn, 'p' || CASE WHEN turn = 1 THEN conv_id % 40 ELSE conv_id * 100 + turn END AS post_id, CASE WHEN turn % 4 = 3 THEN 'V' ELSE 'U' END AS author, text, DATE '2024-01-10' + (turn * 5 % 13 - 11)::INTEGER AS published FROM conversations WHERE turn = 0 OR turn % 6 <> 5 AND turn % 4 <> 3),
ok AS (SELECT *, struct_pack(o := conv_id >= 40, k := conv_id, e := 'e' || conv_id, r := turn <> 0, t := turn) AS place FROM pp WHERE DATE '2024-01-10' - published BETWEEN 0 AND 7),
one AS (SELECT packet, post_id, min(place) AS place, arg_min(CASE WHEN turn <> 0 THEN 'same_author_continuation' WHEN conv_id < 40 THEN 'root' ELSE 'independent_original' END, place) AS relation, arg_min(text, place) AS text, arg_min(author, place) AS author FROM ok GROUP BY 1, 2),
pk AS (SELECT *, CASE WHEN NOT bool_or(relation = 'root') OVER (PARTITION BY packet) AND place = min(place) OVER (PARTITION BY packet) THEN 'root' ELSE relation END AS rel FROM one)"""


def assembled_packets(spark, sf_dir):
    s = packets.post_sources(_packet_posts(spark, sf_dir), F.lit("2024-01-10"))
    return s.select("packet", "post_id", "relation", F.col("place.event_id").alias("event_id"), F.md5("text").alias("text"))


def packet_artifacts(spark, sf_dir):
    s = packets.post_sources(_packet_posts(spark, sf_dir), F.lit("2024-01-10"))
    c = s.select("packet", F.concat(F.lit("a"), F.length("post_id")).alias("artifact_id"), F.col("post_id").alias("source_id"), F.when(F.col("post_id").like("%2"), "self_publishes").otherwise("links_to").alias("relation"), F.col("post_id").alias("title"))
    f = ad.table(spark, sf_dir, "events").select(F.concat(F.lit("a"), F.col("event_id") % 7).alias("artifact_id"), F.when(F.col("event_type") == "view", "success").otherwise("failed").alias("status"), F.col("ts").alias("finished_at"), F.col("event_id").alias("attempt_id"), F.when(F.col("event_id") % 3 != 0, F.col("props")).alias("text"))
    return packets.artifact_sources(s, c, f).select("packet", "artifact_id", F.coalesce("author", F.lit("")).alias("author"), "title", "text", "relation")


def evidence_addresses(spark, sf_dir):
    """Addresses of packets twice: of the sources as they come, and turned round and with other times; equal addresses are told."""
    s = packets.post_sources(_packet_posts(spark, sf_dir), F.lit("2024-01-10")).withColumns({"digest": packets.source_digest(F.col("text"), F.col("relation")), "at": F.to_json("place")})
    a = packets.evidence_address(s, "digest", "at")
    b = packets.evidence_address(s.orderBy(F.desc("post_id")).withColumn("published", F.lit(None)), "digest", "at").withColumnRenamed("evidence_address", "again")
    other = packets.evidence_address(s.withColumn("digest", F.concat("digest", F.lit("x"))), "digest", "at").withColumnRenamed("evidence_address", "other")
    return a.join(b, "packet").join(other, "packet").select("packet", (F.col("evidence_address") == F.col("again")).alias("same"), (F.col("evidence_address") == F.col("other")).alias("other_same"), F.length("evidence_address").cast("long").alias("size"))


def rendered_packets(spark, sf_dir):
    c = ad.table(spark, sf_dir, "conversations")
    kind = F.when(F.col("turn") == 2, "artifact").otherwise("x_post")
    rel = F.when(F.col("turn") == 0, "root").when(F.col("turn") == 1, "independent_original").otherwise("same_author_continuation")
    said = F.when(F.col("turn") == 1, "https://h.example/only").otherwise(F.concat(F.lit("m"), "conv_id", F.lit("\n\nt"), "turn"))
    s = c.select(F.col("conv_id").alias("packet"), F.lit("2024-01-10").alias("day"), F.col("turn").alias("place"), kind.alias("source_type"), rel.alias("relation"), F.when(F.col("turn") != 3, F.concat(F.lit("A "), "role")).alias("author"), F.when(F.col("conv_id") % 2 == 0, F.lit("T  x")).alias("title"), said.alias("text"))
    return packets.render(s)


def cut_packets(spark, sf_dir):
    d = ad.table(spark, sf_dir, "documents")
    cut = packets.truncated(F.col("text"), str.split, " ".join, most=60, marker=" [cut here]")
    return d.select("doc_id", cut.alias("text"))


def semantic_snapshots(spark, sf_dir):
    """How an event's address answers changes: of its own evidence it does, of other people's it does not."""
    p = _written(spark, sf_dir)
    links = _links(spark, sf_dir, p)
    m = _members(spark, sf_dir, links, p).where("captured").join(p, "post_id").join(p.select(F.col("post_id").alias("root"), F.col("author").alias("root_author")), "root")
    m = m.select(F.col("root").alias("event_id"), "post_id", F.col("root").alias("root_id"), "author", "root_author", "post_type", F.md5("post_id").alias("raw_sha256"), F.col("discovered_at").alias("published"), F.col("discovered_at").alias("discovered"), F.lit(True).alias("direct"))
    m = Scratch(spark).write(m, "snapshot_members")
    links = Scratch(spark).write(links.join(m.select(F.col("post_id").alias("source_id"), "event_id"), "source_id"), "snapshot_links")
    own = (F.col("author") == F.col("root_author")) & (F.col("post_type") != "retweet")
    a = packets.semantic_snapshots(m, links)
    b = packets.semantic_snapshots(m.withColumn("raw_sha256", F.when(own | (F.col("post_id") == F.col("root_id")), F.col("raw_sha256")).otherwise("x")), links).withColumnRenamed("snapshot", "foreign")
    c = packets.semantic_snapshots(m.withColumn("raw_sha256", F.when(own & (F.col("post_id") != F.col("root_id")), "x").otherwise(F.col("raw_sha256"))), links).withColumnRenamed("snapshot", "changed")
    return a.join(b, "event_id").join(c, "event_id").select("event_id", (F.col("snapshot") == F.col("foreign")).alias("foreign_same"), (F.col("snapshot") == F.col("changed")).alias("own_same"))


def forest_order(spark, sf_dir):
    rows = _forest(spark, sf_dir)
    o = ev.forest_order(spark, rows)
    return o.select("root", "post_id", "sort_path", "shown_depth", "parent_missing")


def _forest(spark, sf_dir):
    p = _written(spark, sf_dir)
    links = _links(spark, sf_dir, p)
    f = ev.forest_rows(_members(spark, sf_dir, links, p), links, p).join(p.select("post_id", F.col("discovered_at").alias("published")), "post_id")
    return f.select("root", "post_id", F.when(F.col("relation") != "retweet", F.col("parent_id")).alias("parent_id"), "relation", "published")


def feed_lanes(spark, sf_dir):
    p = posts(spark, sf_dir)
    amps = relations(spark, sf_dir).groupBy(F.col("target_id").alias("post_id")).agg(F.collect_set("source_id").alias("amplifiers"))
    items = p.join(amps, "post_id", "left").select("post_id", F.coalesce("amplifiers", F.array().cast("array<string>")).alias("amplifiers"), (F.col("post_type") != "retweet").alias("observed_directly"))
    out = [feed.lane(items, x).select(F.lit(x).alias("lane"), "post_id") for x in ("all", "network", "firsthand")]
    return out[0].union(out[1]).union(out[2]).groupBy("lane").agg(F.count("*").alias("n"), F.min("post_id").alias("first"), F.max("post_id").alias("last"))


def canonical_posts(spark, sf_dir):
    e = base(spark, sf_dir)
    log = e.select((F.col("event_id") % 800).alias("post_id"), (F.col("event_type") == "view").alias("direct"), F.to_date("ts").alias("discovered_at"), F.format_string("%08d", F.col("event_id")).alias("priority"))
    return upserts.canonical_posts(log).select("post_id", "direct", F.col("discovered_at").cast("string").alias("discovered_at"), "priority")


def canonical_relations(spark, sf_dir):
    e = base(spark, sf_dir)
    log = e.select((F.col("event_id") % 90).alias("source_id"), F.col("t").alias("relation_type"), (F.col("k") % 9).alias("target_id"), F.to_date("ts").alias("discovered_at"), F.col("event_id").alias("disclosure_id"))
    return upserts.canonical_relations(log).select("source_id", "relation_type", "target_id", "disclosure_id")


def recovered_replies(spark, sf_dir):
    p = posts(spark, sf_dir)
    return feed.recovered(p, p.where("in_reply_to is null"), "2024-01-10").select("post_id", "conversation_id")


def supported_rows(spark, sf_dir):
    o = ad.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return upserts.supported_only(o, ad.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


def latest_values(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), F.col("event_type").alias("bio"), F.col("ts").alias("at"), F.col("event_id").alias("fact_id"))
    ents = spark.range(0, 200).select(F.col("id").alias("entity_id"))
    return registry.latest_of(ents, e, "bio", "at", "fact_id").select("entity_id", F.coalesce("bio", F.lit("")).alias("bio"))


def follower_sums(spark, sf_dir):
    c = ad.table(spark, sf_dir, "customer")
    owners = c.select(F.col("c_nationkey").alias("entity_id"), (F.col("c_custkey") % 400).alias("channel_id"))
    return registry.total_followers(owners, spark.range(0, 400, 2).select(F.col("id").alias("channel_id"), (F.col("id") * 3).alias("followers")))


def company_names(spark, sf_dir):
    n = ad.table(spark, sf_dir, "customer")
    names = n.select(F.col("c_nationkey").alias("company"), F.concat(F.lit("Seg"), F.when(F.col("c_custkey") % 30 == 0, F.col("c_custkey")).otherwise(F.col("c_custkey") % 90)).alias("name"))
    wanted = spark.range(0, 3000).select(F.concat(F.lit("SEG"), "id").alias("name"))
    return registry.ambiguous_names(names, wanted).select("name", F.coalesce("company", F.lit(-1)).cast("long").alias("company"), "matches")


def portfolio(spark, sf_dir):
    p = ad.table(spark, sf_dir, "part")
    return insights.merge_portfolio(p.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("company"), F.col("p_retailprice").alias("weight")), p.select(F.col("p_partkey").alias("company"), (F.col("p_partkey") * 37 % 1001).cast("double").alias("weight")), 10)


def telemetry_change(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events")
    part = lambda rows: rows.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.col("event_id")).alias("ids"))
    other = e.withColumn("user_id", F.when(F.col("user_id") % 9 == 0, F.col("user_id") + 10_000).otherwise(F.col("user_id")))
    return insights.telemetry_delta(part(e.where("ts < '2024-01-16'")), part(other), ["user_id"], ["n", "ids"])


def relation_counts(spark, sf_dir):
    c = ad.table(spark, sf_dir, "conversations")
    rel = F.when(F.col("turn") % 4 == 0, "quote").when(F.col("turn") % 4 == 1, "reply").when(F.col("turn") % 4 == 2, "retweet").otherwise("related")
    items = c.groupBy("conv_id").agg(F.collect_list(F.struct(rel.alias("relation"), (F.col("role") == "assistant").alias("own"))).alias("items"))
    return items.select("conv_id", insights.relationship_counts(F.col("items")).alias("n")).select("conv_id", "n.*")


def observed_days(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events").select((F.col("event_id") % 211).alias("artifact_id"), F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 17).alias("rank"), F.col("ts").alias("observed_at"), F.col("event_id").alias("obs_id"))
    o = art.day_observations(e)
    return o.select("artifact_id", "obs_id", "observations", F.date_format("first_at", "yyyy-MM-dd HH:mm:ss").alias("first_at"), F.date_format("last_at", "yyyy-MM-dd HH:mm:ss").alias("last_at"))


def explicit_selection(spark, sf_dir):
    wanted = spark.range(0, 4000, 3).select(F.col("id").alias("artifact_id"))
    p = ad.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("artifact_id"))
    return art.explicit_selection(wanted, p, p.where("artifact_id % 2 = 0"))


def quota_cohort(spark, sf_dir):
    p = ad.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("artifact_id"), F.substring("p_brand", 1, 7).alias("stratum"), (F.col("p_partkey") % 37).cast("string").alias("host"), (F.col("p_partkey") % 91).cast("string").alias("event"), (F.col("p_partkey") * 7919 % 1009).cast("double").alias("score"))
    return art.quota_cohort(p, {"Brand#1": 10, "Brand#2": 10, "Brand#3": 10}, 30)


def converged_rows(spark, sf_dir):
    aliases = spark.range(0, 3000).where("id % 3 = 0 and id % 10 <> 7").select(F.col("id").alias("a"), (F.col("id") + 3).alias("b"))
    p = ad.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("artifact_id"), "p_size")
    return art.converge(spark, aliases, p).groupBy("artifact_id").agg(F.count("*").alias("n"), F.sum("p_size").cast("long").alias("size"))


def claimed_channels(spark, sf_dir):
    c = ad.table(spark, sf_dir, "customer")
    owners = c.select(F.col("c_custkey").alias("channel_id"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_custkey")).otherwise(F.col("c_nationkey").cast("long")).alias("entity_id"))
    ents = owners.select("entity_id").distinct().select("entity_id", F.when(F.col("entity_id") % 8 == 0, "unknown").otherwise("person").alias("kind"))
    claims = spark.range(0, 2000, 2).select(F.col("id").alias("channel_id"), (F.col("id") + 100000).alias("entity_id"))
    return registry.claim(owners, ents, claims)


def _kinds(spark, sf_dir):
    s = ad.table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 == 0, "unknown").otherwise("person").alias("kind"), F.md5("s_name").alias("input_sha256"))


def manifest_changes(spark, sf_dir):
    m = spark.range(1, 10).select(F.col("id").alias("entity_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("New "), "id")).alias("name"), F.when(F.col("id") % 3 == 0, "org").alias("kind"))
    return registry.apply_manifest(_kinds(spark, sf_dir), m).select("entity_id", "name", "kind")


def promoted_kinds(spark, sf_dir):
    k = _kinds(spark, sf_dir)
    r = k.select("entity_id", "input_sha256", F.lit("v1").alias("contract"), F.explode(F.array(F.lit(1), F.lit(2))).alias("finished_at")).withColumns({"kind": F.concat(F.lit("k"), "finished_at"), "run_id": F.col("finished_at")})
    old = r.withColumns({"contract": F.lit("v0"), "finished_at": F.lit(9), "kind": F.lit("no")})
    return registry.promote(k, r.union(old), "v1").select("entity_id", "kind")


def grouped_entities(spark, sf_dir):
    m = ad.table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select((F.col("s_suppkey") % 5).alias("group_id"), F.concat(F.lit("g"), F.col("s_suppkey") % 5).alias("name"), F.col("s_suppkey").alias("member"))
    return registry.apply_groups(_kinds(spark, sf_dir), m).select("entity_id", F.coalesce("group_name", F.lit("")).alias("group_name"))


def group_faults(spark, sf_dir):
    s = ad.table(spark, sf_dir, "supplier")
    m = s.select((F.col("s_suppkey") % 7).alias("group_id"), F.when(F.col("s_suppkey") % 7 == 1, " ").when(F.col("s_suppkey") % 7 == 2, F.col("s_name")).otherwise("g").alias("name"), F.when(F.col("s_suppkey") % 7 == 3, F.col("s_suppkey") + 10**9).when(F.col("s_suppkey") % 7 == 4, F.lit(4)).otherwise(F.col("s_suppkey")).alias("member"))
    return registry.group_faults(m, _kinds(spark, sf_dir))


def unique_slugs(spark, sf_dir):
    c = ad.table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "x").otherwise("blog").alias("kind"), F.concat(F.lit("Seg "), "c_mktsegment", F.repeat(F.lit("!z"), 40)).alias("key"))
    taken = c.where("kind = 'blog' and key like 'Seg BUILDING%'")
    return registry.unique_slugs(c, "c_custkey", "kind", "key", taken.select(text.slug(F.col("kind"), F.col("key")).alias("slug"))).select("c_custkey", "slug")


def admissions(spark, sf_dir):
    c = ad.table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.floor("c_acctbal")).alias("followers"), (F.col("c_custkey") % 3 == 0).alias("isPrivate"))
    return registry.admission(c, 1000).select("c_custkey", "outcome", F.coalesce("reason", F.lit("")).alias("reason"))


def ordered_roles(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list("event_type").alias("roles"))
    return e.select("user_id", F.array_join(dev.ordered_roles(F.col("roles"), ("view", "error")), ",").alias("roles"))


def shown_artifacts(spark, sf_dir):
    d = ad.table(spark, sf_dir, "documents")
    a = F.struct(F.md5("text").alias("artifact_id"), F.col("lang").alias("title"), F.lit(1).alias("source_rank"), (F.md5("text") < "8").alias("merge_anchor"), F.lit("d").alias("first_event_day"))
    out = dev.shown_artifacts(d.select(F.col("source").alias("development_id"), F.col("doc_id").alias("event_id"), a.alias("artifact")))
    return out.select("development_id", "artifact_id", F.concat_ws("|", F.map_keys(F.from_json(F.to_json("artifact"), "map<string,string>"))).alias("fields"), "is_merge_basis", "n_events")


def parsed_results(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events")
    final = F.expr("""CASE WHEN event_id % 7 = 0 THEN 'broken' ELSE concat('{"headline":"h', event_id, '","connections":["a","b"]}') END""")
    trace = F.expr("""concat('{"memo_packets":{"T', event_id % 5, '":{"company":{"name":"', CASE WHEN event_id % 2 = 0 THEN 'Co' ELSE '' END, '"}},"A":{}}}')""")
    runs = e.select(F.col("event_id").alias("run_id"), F.col("event_type").alias("decision"), final.alias("final_json"), trace.alias("trace_json"), F.lit('["x"]').alias("calls_json"))
    return insights.parsed_results(runs).select("run_id", F.coalesce("headline", F.lit("")).alias("headline"), "decision", F.col("n_connections").cast("long").alias("n_connections"), F.array_join("companies", ",").alias("companies"), F.col("n_memo_calls").cast("long").alias("n_memo_calls"))


def row_fingerprints(spark, sf_dir):
    """Fingerprints of customers by nation, of the rows as they come and of the rows sorted the other way."""
    c = ad.table(spark, sf_dir, "customer")
    one = lambda d, name: d.groupBy("c_nationkey").agg(hashing.fingerprint(d, "c_custkey", "c_name").alias(name))
    less = c.where("c_custkey % 500 <> 1")
    j = one(c, "a").join(one(c.orderBy(F.desc("c_custkey")).repartition(5), "b"), "c_nationkey").join(one(less, "c"), "c_nationkey", "left")
    return j.select("c_nationkey", (F.col("a") == F.col("b")).alias("same"), F.coalesce(F.col("a") == F.col("c"), F.lit(False)).alias("same_with_less"))


def newest_posts(spark, sf_dir):
    p = posts(spark, sf_dir).select("post_id", F.to_date("discovered_at").alias("published_at"))
    return feed.newest(p, 50, 20).select("post_id")


def _stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)


def _drained(spark, stream, name, mode="complete"):
    """All that a stream has to say about what is there now; every batch replaces the last (complete) or is added."""
    scratch = Scratch(spark)
    out = scratch.path(name)
    put = lambda batch, _: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)
    stream.writeStream.outputMode(mode).option("checkpointLocation", scratch.path(f"{name}-state")).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def streamed_days(spark, sf_dir):
    d = _drained(spark, streams.day_counts(_stream(spark, sf_dir)), "days")
    return d.select(F.to_date("window_start").cast("string").alias("day"), "event_type", "n")


def streamed_weeks(spark, sf_dir):
    d = _drained(spark, streams.day_counts(_stream(spark, sf_dir), keys=(), days="7 days", slide="1 day"), "weeks")
    return d.select(F.to_date("window_start").cast("string").alias("first_day"), "n")


def streamed_sessions(spark, sf_dir):
    d = _drained(spark, streams.sessions(_stream(spark, sf_dir), gap="12 hours"), "sessions")
    return d.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


def streamed_firsts(spark, sf_dir):
    d = _drained(spark, streams.first_within(_stream(spark, sf_dir), ["user_id", "event_type"], late="60 days").select("user_id", "event_type"), "firsts", "append")
    return d


def streamed_once(spark, sf_dir):
    """A batch that is delivered twice is kept once."""
    root = Scratch(spark).path("once")
    put = streams.once_sink(root, ["event_id"])
    e = ad.table(spark, sf_dir, "events").select("event_id", "event_type")
    put(e, 0)
    put(e, 1)
    put(e.where("event_type = 'error'"), 2)
    return spark.read.parquet(root).groupBy("event_type").agg(F.count("*").alias("n"))


def _leased(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events")
    what = F.when(F.col("event_type").isin("view", "click"), "claim").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "fail").otherwise("reject")
    return e.select((F.col("event_id") % 1000).alias("item"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), what.alias("event"))


def work_leases(spark, sf_dir):
    return streams.leases(_leased(spark, sf_dir))


def completed_runs(spark, sf_dir):
    items = _leased(spark, sf_dir).select((F.col("item") % 20).alias("run_id"), "item")
    return streams.completed_runs(items, streams.leases(_leased(spark, sf_dir)))


#: A machine over each item's events in order, ten minutes a lease, three attempts.
LEASES = """n AS (SELECT event_id % 1000 AS item, ts, CASE WHEN event_type IN ('view', 'click') THEN 'claim' WHEN event_type = 'purchase' THEN 'success' WHEN event_type = 'error' THEN 'failed_retryable' ELSE 'failed_terminal' END AS x, row_number() OVER (PARTITION BY event_id % 1000 ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT DISTINCT item, 0::BIGINT AS k, 'pending' AS status, 0 AS attempts, NULL::TIMESTAMP AS until, '' AS reason FROM n
  UNION ALL SELECT item, k,
    CASE WHEN x <> 'claim' THEN CASE WHEN s = 'in_progress' OR r = 'lease_expired' THEN x ELSE s END WHEN takes THEN 'in_progress' WHEN late THEN 'failed_retryable' ELSE s END,
    CASE WHEN takes THEN attempts + 1 ELSE attempts END, CASE WHEN takes THEN ts + INTERVAL 10 MINUTE WHEN x = 'claim' AND NOT late THEN until END,
    CASE WHEN x <> 'claim' THEN CASE WHEN s = 'in_progress' OR r = 'lease_expired' THEN '' ELSE r END WHEN takes THEN '' WHEN late THEN 'lease_expired' ELSE r END
  FROM (SELECT w.item, n.k, n.x, n.ts, w.status AS s, w.attempts, w.until, w.reason AS r, n.x = 'claim' AND w.status = 'in_progress' AND n.ts > w.until AS late,
    n.x = 'claim' AND w.attempts < 3 AND (w.status IN ('pending', 'failed_retryable') OR w.status = 'in_progress' AND n.ts > w.until) AS takes FROM w JOIN n ON n.item = w.item AND n.k = w.k + 1)),
leased AS (SELECT item, status, attempts::BIGINT AS attempts, reason FROM w QUALIFY row_number() OVER (PARTITION BY item ORDER BY k DESC) = 1)"""

_SLUG = "trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-')"
_FOREST = f"""{ROOTS}, fr AS (SELECT m.root, m.post_id, l.target_id AS parent, CASE WHEN l.link_type IN ('reply_parent', 'primary_thread') THEN 'reply' WHEN l.link_type IN ('quote', 'retweet') THEN l.link_type WHEN m.depth = 0 THEN 'root' ELSE 'related' END AS relation,
  strftime(p.discovered_at, '%Y%m%d%H%M%S%f') || ':' || lpad(m.post_id, 20, '0') AS key FROM mem m JOIN posts p USING (post_id) LEFT JOIN links l ON l.source_id = m.post_id),
nr AS (SELECT * FROM fr WHERE relation <> 'retweet' AND post_id <> root),
tree(root, post_id, path, depth) AS (SELECT root, post_id, CASE WHEN parent = root THEN '0/' ELSE '1/' END || key, 1 FROM nr WHERE parent IS NULL OR parent = root OR NOT EXISTS (SELECT 1 FROM nr q WHERE q.root = nr.root AND q.post_id = nr.parent)
  UNION ALL SELECT nr.root, nr.post_id, tree.path || '/' || nr.key, tree.depth + 1 FROM nr JOIN tree ON tree.root = nr.root AND tree.post_id = nr.parent WHERE nr.parent <> nr.root)"""

QUERIES = [
    ("primary_posts", primary_posts, f"WITH {LIN} SELECT * FROM prim"),
    (
        "lineage_candidates",
        lineage_candidates,
        f"""WITH {LIN}, sz AS (SELECT day, count(DISTINCT event_id) AS c FROM items GROUP BY 1)
        SELECT event_id, post_id, f.d::VARCHAR AS day, f.r AS daily_rank, c AS day_candidates, 'accepted' AS decision, CASE WHEN expanded_url LIKE '%/i/article/%' THEN 'x_longform_article' ELSE 'external_http_url' END AS reason, CASE WHEN expanded_url LIKE '%/i/article/%' THEN 'self_publishes' ELSE 'links_to' END AS relation, expanded_url AS canonical_url
        FROM src JOIN evid USING (post_id) JOIN sz ON sz.day = f.d WHERE owner_id = post_id""",
    ),
    (
        "lineage_audit",
        lineage_audit,
        f"""WITH {LIN}, c AS (SELECT lp.*, 'c' || post_id AS cid, expanded_url AS url, CASE WHEN n % 26 = 0 THEN 'lost' || post_id ELSE post_id END AS sid FROM lp JOIN evid USING (post_id)),
        j AS (SELECT c.*, s.post_id AS sp, s.author_id AS sa, s.post_type AS st, s.raw_sha256 AS sh, coalesce(nullif(s.conversation_id, ''), s.post_id) AS rid, r.post_id AS rp, r.author_id AS ra, coalesce(nullif(r.conversation_id, ''), r.post_id) AS rc FROM c LEFT JOIN lp s ON s.post_id = sid LEFT JOIN lp r ON r.post_id = coalesce(nullif(s.conversation_id, ''), s.post_id)),
        o AS (SELECT 'o' || cid AS oid, sid, n FROM c WHERE n % 14 <> 0 UNION ALL SELECT 'oz', 's', 1)
        SELECT reason, cid AS candidate_id, 'e' || post_id AS event_id, coalesce(rid, '') AS root_id, sid AS source_id FROM j, (VALUES ('unexpected_source_provider'), ('accepted_candidate_missing_artifact'), ('missing_source_post'), ('stale_source_snapshot'), ('foreign_author'), ('non_reply_continuation'), ('wrong_conversation'), ('unbound_source_url')) AS v(reason)
        WHERE CASE reason WHEN 'unexpected_source_provider' THEN n % 18 = 0 WHEN 'accepted_candidate_missing_artifact' THEN n % 14 = 0 WHEN 'missing_source_post' THEN sp IS NULL WHEN 'stale_source_snapshot' THEN sp IS NOT NULL AND n % 22 = 0
          WHEN 'foreign_author' THEN sp <> rid AND rp IS NOT NULL AND (ra = '' OR sa <> ra) WHEN 'non_reply_continuation' THEN sp <> rid AND rp IS NOT NULL AND st <> 'reply' WHEN 'wrong_conversation' THEN sp <> rid AND rp IS NOT NULL AND rid <> rc ELSE sp IS NOT NULL AND n % 34 = 0 END
        UNION ALL SELECT 'orphan_observation', '', '', '', sid FROM o WHERE sid = 's' OR sid LIKE 'lost%'
        UNION ALL SELECT 'artifact_without_lineage', 'bare', '', '', '' UNION ALL SELECT 'observation_without_disclosure', oid, '', '', sid FROM o WHERE oid LIKE '%8' UNION ALL SELECT 'unexpected_selection_policy', '', '', '', ''""",
    ),
    (
        "listed_artifacts",
        listed_artifacts,
        "SELECT p_partkey AS artifact_id, coalesce(s_name, '') AS development_id, coalesce(s_suppkey * 7 % 41, p_size) AS best_source_rank FROM part LEFT JOIN supplier ON s_suppkey < 40 AND s_suppkey = p_partkey % 60",
    ),
    ("first_listed", first_listed, "SELECT p_partkey AS artifact_id FROM part ORDER BY p_size, p_brand, p_partkey LIMIT 25 OFFSET 10"),
    ("assembled_packets", assembled_packets, f"WITH {PACK} SELECT packet, post_id, rel AS relation, place.e AS event_id, md5(text) AS text FROM pk"),
    (
        "packet_artifacts",
        packet_artifacts,
        f"""WITH {PACK}, c AS (SELECT packet, 'a' || length(post_id) AS artifact_id, post_id, post_id NOT LIKE '%2' AS o, author FROM pk), b AS (SELECT packet, artifact_id, min(struct_pack(o := o, p := post_id)) AS m FROM c GROUP BY 1, 2),
        f AS (SELECT 'a' || (event_id % 7) AS artifact_id, arg_max(props, struct_pack(t := ts, e := event_id)) AS text FROM events WHERE event_type = 'view' AND event_id % 3 <> 0 GROUP BY 1)
        SELECT b.packet, b.artifact_id, CASE WHEN m.o THEN '' ELSE 'U' END AS author, m.p AS title, text, CASE WHEN m.o THEN 'linked_artifact' ELSE 'self_published_artifact' END AS relation FROM b JOIN f USING (artifact_id)""",
    ),
    ("evidence_addresses", evidence_addresses, f"WITH {PACK} SELECT DISTINCT packet, true AS same, false AS other_same, 64 AS size FROM pk"),
    (
        "rendered_packets",
        rendered_packets,
        """WITH s AS (SELECT conv_id, turn, role, '> m' || conv_id || chr(10) || '>' || chr(10) || '> t' || turn AS q FROM conversations),
        g AS (SELECT conv_id, count(*) FILTER (turn < 2) AS np, string_agg(CASE WHEN turn < 2 THEN chr(10) || chr(10) || '### ' || (turn + 1) || '. A ' || role || chr(10) || chr(10) || CASE turn WHEN 0 THEN q ELSE '> No substantive post text ' || CASE WHEN n > 2 THEN 'beyond the supporting artifact link.' ELSE 'was available.' END END END, '' ORDER BY turn) AS p,
          count(*) FILTER (turn > 2) AS nu, string_agg(CASE WHEN turn > 2 THEN chr(10) || chr(10) || '### ' || (turn - 2) || '. ' || CASE turn WHEN 3 THEN 'Unknown author' ELSE 'A ' || role END || chr(10) || chr(10) || q END, '' ORDER BY turn) AS u, max(CASE WHEN turn = 2 THEN q END) AS a FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM s) GROUP BY 1)
        SELECT conv_id AS packet, '# Evidence about one development' || chr(10) || chr(10) || 'Date: 2024-01-10' || chr(10) || chr(10) || '## Source posts (' || np || ')' || p || CASE WHEN nu > 0 THEN chr(10) || chr(10) || '## Author updates (' || nu || ')' || u ELSE '' END
          || chr(10) || chr(10) || CASE WHEN a IS NULL THEN '## Supporting artifacts (0)' || chr(10) || chr(10) || 'No supporting artifact text was included in this packet.' ELSE '## Supporting artifacts (1)' || chr(10) || chr(10) || '### 1. ' || CASE WHEN conv_id % 2 = 0 THEN 'T x' ELSE 'Artifact 1' END || chr(10) || chr(10) || a END AS input FROM g""",
    ),
    ("cut_packets", cut_packets, r"""WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM documents) SELECT doc_id, CASE WHEN len(ws) <= 60 THEN text ELSE array_to_string(ws[1:58], ' ') || ' [cut here]' END AS text FROM w"""),
    (
        "semantic_snapshots",
        semantic_snapshots,
        f"""{W}{ROOTS} SELECT m.root AS event_id, true AS foreign_same, NOT bool_or(p.author = r.author AND p.post_type <> 'retweet' AND p.post_id <> m.root) AS own_same FROM mem m JOIN posts p USING (post_id) JOIN posts r ON r.post_id = m.root GROUP BY 1""",
    ),
    (
        "forest_order",
        forest_order,
        f"""{W}{_FOREST} SELECT fr.root, fr.post_id, CASE WHEN relation = 'retweet' THEN '2/' || key ELSE coalesce(path, '') END AS sort_path, CASE WHEN relation = 'retweet' THEN 0 ELSE coalesce(tree.depth, 0) END AS shown_depth,
        relation = 'reply' AND fr.post_id <> fr.root AND parent IS DISTINCT FROM fr.root AND NOT EXISTS (SELECT 1 FROM nr q WHERE q.root = fr.root AND q.post_id = fr.parent) AS parent_missing FROM fr LEFT JOIN tree USING (root, post_id)""",
    ),
    (
        "feed_lanes",
        feed_lanes,
        f"""WITH {POSTS}, i AS (SELECT post_id, post_id IN (SELECT target_id FROM relations) AS a, post_type <> 'retweet' AS d FROM posts)
        SELECT lane, count(*) AS n, min(post_id) AS first, max(post_id) AS last FROM i, (VALUES ('all'), ('network'), ('firsthand')) AS v(lane) WHERE lane = 'all' OR lane = 'network' AND a OR lane = 'firsthand' AND d GROUP BY 1""",
    ),
    (
        "canonical_posts",
        canonical_posts,
        "SELECT event_id % 800 AS post_id, event_type = 'view' AS direct, ts::DATE::VARCHAR AS discovered_at, printf('%08d', event_id) AS priority FROM events QUALIFY row_number() OVER (PARTITION BY event_id % 800 ORDER BY event_type = 'view' DESC, ts::DATE, event_id DESC) = 1",
    ),
    (
        "canonical_relations",
        canonical_relations,
        f"WITH {POSTS} SELECT event_id % 90 AS source_id, t AS relation_type, k % 9 AS target_id, event_id AS disclosure_id FROM e QUALIFY row_number() OVER (PARTITION BY event_id % 90, t, k % 9 ORDER BY ts::DATE, event_id) = 1",
    ),
    (
        "recovered_replies",
        recovered_replies,
        f"""WITH {POSTS} SELECT post_id, conversation_id FROM posts p WHERE in_reply_to IS NOT NULL AND day < '2024-01-10' AND EXISTS (SELECT 1 FROM posts q WHERE q.post_id = p.conversation_id AND q.in_reply_to IS NULL)""",
    ),
    ("supported_rows", supported_rows, "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"),
    ("latest_values", latest_values, "SELECT i AS entity_id, coalesce(arg_max(event_type, struct_pack(t := ts, e := event_id)), '') AS bio FROM range(200) AS r(i) LEFT JOIN events ON user_id = i GROUP BY 1"),
    ("follower_sums", follower_sums, "SELECT e AS entity_id, sum(ch * 3)::BIGINT AS followers FROM (SELECT DISTINCT c_nationkey AS e, c_custkey % 400 AS ch FROM customer) WHERE ch % 2 = 0 GROUP BY 1"),
    (
        "company_names",
        company_names,
        "WITH n AS (SELECT DISTINCT c_nationkey AS c, CASE WHEN c_custkey % 30 = 0 THEN c_custkey ELSE c_custkey % 90 END AS k FROM customer) SELECT 'SEG' || i AS name, CASE WHEN count(DISTINCT c) = 1 THEN max(c) ELSE -1 END::BIGINT AS company, count(DISTINCT c) AS matches FROM range(3000) AS r(i) LEFT JOIN n ON k = i GROUP BY i",
    ),
    (
        "portfolio",
        portfolio,
        "WITH a AS (SELECT p_partkey AS company, p_retailprice AS a FROM part WHERE p_partkey % 50 = 0), c AS (SELECT p_partkey AS company, (p_partkey * 37 % 1001)::DOUBLE AS c FROM part ORDER BY c DESC, company LIMIT 10) SELECT company, coalesce(c, a) AS weight, a IS NOT NULL AS audited, c IS NOT NULL AS in_top FROM a FULL JOIN c USING (company)",
    ),
    (
        "telemetry_change",
        telemetry_change,
        "WITH b AS (SELECT user_id, count(*) AS n, sum(event_id)::BIGINT AS s FROM events WHERE ts < '2024-01-16' GROUP BY 1), a AS (SELECT CASE WHEN user_id % 9 = 0 THEN user_id + 10000 ELSE user_id END AS user_id, count(*) AS n, sum(event_id)::BIGINT AS s FROM events GROUP BY 1) SELECT user_id, coalesce(a.n, 0) - coalesce(b.n, 0) AS n, coalesce(a.s, 0) - coalesce(b.s, 0) AS ids FROM a FULL JOIN b USING (user_id)",
    ),
    (
        "relation_counts",
        relation_counts,
        "SELECT conv_id, count(*) FILTER (turn % 4 = 1 AND role = 'assistant') AS author_updates, count(*) FILTER (turn % 4 = 0) AS quotes, count(*) FILTER (turn % 4 = 2) AS retweets, count(*) FILTER (turn % 4 = 3) AS related FROM conversations GROUP BY 1",
    ),
    (
        "observed_days",
        observed_days,
        "WITH o AS (SELECT event_id % 211 AS artifact_id, CASE WHEN event_id % 5 <> 0 THEN event_id % 17 END AS rank, ts, event_id FROM events) SELECT artifact_id, event_id AS obs_id, count(*) OVER p AS observations, strftime(min(ts) OVER p, '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(ts) OVER p, '%Y-%m-%d %H:%M:%S') AS last_at FROM o WINDOW p AS (PARTITION BY artifact_id) QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY rank NULLS LAST, ts, event_id) = 1",
    ),
    ("explicit_selection", explicit_selection, "SELECT i AS artifact_id, CASE WHEN p_partkey IS NULL THEN 'missing' WHEN i % 2 = 0 THEN 'selected' ELSE 'unbound' END AS state FROM range(0, 4000, 3) AS r(i) LEFT JOIN part ON p_partkey = i"),
    ("quota_cohort", quota_cohort, None),
    (
        "converged_rows",
        converged_rows,
        "WITH RECURSIVE al AS (SELECT i AS a, i + 3 AS b FROM range(3000) AS r(i) WHERE i % 3 = 0 AND i % 10 <> 7), low(x, y) AS (SELECT b, a FROM al UNION ALL SELECT x, al.a FROM low JOIN al ON al.b = y), m AS (SELECT x, min(y) AS y FROM low GROUP BY 1) SELECT coalesce(y, p_partkey) AS artifact_id, count(*) AS n, sum(p_size)::BIGINT AS size FROM part LEFT JOIN m ON x = p_partkey GROUP BY 1",
    ),
    (
        "claimed_channels",
        claimed_channels,
        "WITH o AS (SELECT c_custkey AS ch, CASE WHEN c_custkey % 4 = 0 THEN c_custkey ELSE c_nationkey END AS e FROM customer), n AS (SELECT *, count(*) OVER (PARTITION BY e) AS n FROM o), c AS (SELECT i AS ch FROM range(0, 2000, 2) AS r(i)) SELECT ch AS channel_id, CASE WHEN c.ch IS NOT NULL AND (e IS NULL OR e % 8 = 0 AND n = 1) THEN ch + 100000 ELSE e END AS entity_id FROM n FULL JOIN c USING (ch)",
    ),
    ("manifest_changes", manifest_changes, "SELECT s_suppkey AS entity_id, CASE WHEN s_suppkey BETWEEN 1 AND 9 AND s_suppkey % 2 = 0 THEN 'New ' || s_suppkey ELSE s_name END AS name, CASE WHEN s_suppkey BETWEEN 1 AND 9 AND s_suppkey % 3 = 0 THEN 'org' WHEN s_suppkey % 3 = 0 THEN 'unknown' ELSE 'person' END AS kind FROM supplier"),
    ("promoted_kinds", promoted_kinds, "SELECT s_suppkey AS entity_id, CASE WHEN s_suppkey % 3 = 0 THEN 'k2' ELSE 'person' END AS kind FROM supplier"),
    ("grouped_entities", grouped_entities, "SELECT s_suppkey AS entity_id, CASE WHEN s_suppkey % 2 = 0 THEN 'g' || (s_suppkey % 5) ELSE '' END AS group_name FROM supplier"),
    (
        "group_faults",
        group_faults,
        """WITH m AS (SELECT s_suppkey % 7 AS g, CASE s_suppkey % 7 WHEN 1 THEN ' ' WHEN 2 THEN s_name ELSE 'g' END AS name, CASE s_suppkey % 7 WHEN 3 THEN s_suppkey + 1000000000 WHEN 4 THEN 4 ELSE s_suppkey END AS member FROM supplier)
        SELECT DISTINCT g AS group_id, 'empty_name' AS fault FROM m WHERE trim(name) = '' UNION SELECT g, 'several_names' FROM m GROUP BY g HAVING count(DISTINCT name) > 1
        UNION SELECT g, 'unknown_member' FROM m WHERE member NOT IN (SELECT s_suppkey FROM supplier) UNION SELECT min(g), 'repeated_member' FROM m GROUP BY member HAVING count(*) > 1""",
    ),
    (
        "unique_slugs",
        unique_slugs,
        f"""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE 'blog' END AS kind, 'Seg ' || c_mktsegment || repeat('!z', 40) AS name FROM customer), s AS (SELECT *, kind || '-' || substr({_SLUG}, 1, 72) AS slug FROM c)
        SELECT c_custkey, CASE WHEN c_custkey = min(c_custkey) OVER (PARTITION BY slug) AND NOT (kind = 'blog' AND name LIKE 'Seg BUILDING%') THEN slug ELSE substr(slug, 1, 69) || '-' || substr(sha256(kind || ':' || name), 1, 10) END AS slug FROM s""",
    ),
    (
        "admissions",
        admissions,
        "WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'follower_count_missing' WHEN floor(c_acctbal) < 1000 THEN 'below_follower_floor' WHEN c_custkey % 3 = 0 THEN 'protected_account' ELSE '' END AS reason FROM customer) SELECT c_custkey, CASE reason WHEN '' THEN 'admitted' WHEN 'follower_count_missing' THEN 'failed' ELSE 'rejected' END AS outcome, reason FROM c",
    ),
    (
        "ordered_roles",
        ordered_roles,
        "SELECT user_id, string_agg(event_type, ',' ORDER BY CASE event_type WHEN 'view' THEN 1 WHEN 'error' THEN 2 ELSE 3 END, event_type) AS roles FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1",
    ),
    ("shown_artifacts", shown_artifacts, "SELECT source AS development_id, md5(text) AS artifact_id, 'artifact_id|title' AS fields, count(DISTINCT doc_id) > 1 AND md5(text) < '8' AS is_merge_basis, count(DISTINCT doc_id) AS n_events FROM documents GROUP BY source, text"),
    (
        "parsed_results",
        parsed_results,
        "SELECT event_id AS run_id, CASE WHEN event_id % 7 = 0 THEN '' ELSE 'h' || event_id END AS headline, event_type AS decision, CASE WHEN event_id % 7 = 0 THEN 0 ELSE 2 END AS n_connections, 'A,' || CASE WHEN event_id % 2 = 0 THEN 'Co' ELSE 'T' || (event_id % 5) END AS companies, 1 AS n_memo_calls FROM events",
    ),
    ("row_fingerprints", row_fingerprints, "SELECT c_nationkey, true AS same, NOT bool_or(c_custkey % 500 = 1) AS same_with_less FROM customer GROUP BY 1"),
    ("newest_posts", newest_posts, f"WITH {POSTS} SELECT post_id FROM posts ORDER BY day DESC, post_id DESC LIMIT 50 OFFSET 20"),
    ("streamed_days", streamed_days, "SELECT ts::DATE::VARCHAR AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    ("streamed_weeks", streamed_weeks, "SELECT (ts::DATE - i::INTEGER)::VARCHAR AS first_day, count(*) AS n FROM events, range(7) AS r(i) GROUP BY 1"),
    (
        "streamed_sessions",
        streamed_sessions,
        "WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM g GROUP BY user_id, g",
    ),
    ("streamed_firsts", streamed_firsts, "SELECT DISTINCT user_id, event_type FROM events"),
    ("streamed_once", streamed_once, "SELECT event_type, count(*) * CASE event_type WHEN 'error' THEN 2 ELSE 1 END AS n FROM events GROUP BY 1"),
    ("work_leases", work_leases, f"WITH RECURSIVE {LEASES} SELECT * FROM leased"),
    (
        "completed_runs",
        completed_runs,
        f"""WITH RECURSIVE {LEASES} SELECT item % 20 AS run_id, count(*) AS expected, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status NOT IN ('success', 'failed_terminal')) AS failed_retryable, count(*) FILTER (status = 'failed_terminal') AS failed_terminal FROM leased GROUP BY 1""",
    ),
]
