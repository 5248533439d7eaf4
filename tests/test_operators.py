"""Small graphs, logs and packets with known results."""

import datetime as dt
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import artifacts, coverage, developments, events, feed, graph, insights, network, pagerank, publication, rank, registry, routing, upserts

EDGES = [(1, 10), (1, 11), (2, 10), (2, 13), (3, 10), (3, 11), (3, 12), (4, 13), (4, 14), (5, 10), (5, 13), (1, 2), (2, 1), (3, 5), (5, 3), (4, 1), (1, 5)]


def components(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200)]
    got = graph.components(spark, spark.createDataFrame(pairs, "u long, v long"))
    assert {x.node: x.component for x in got.collect()} == components(pairs)


def test_components_of_nothing(spark):
    assert graph.components(spark, spark.createDataFrame([], "u long, v long")).count() == 0


def test_overlap_golden(spark):
    sources = {1, 2, 3, 5}
    edges = spark.createDataFrame([e for e in EDGES if e[0] in sources], "source long, target long")
    nodes = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "charlie"), (4, "private"), (5, "alpha_alt"), (10, "x"), (11, "y"), (12, "w"), (13, "z"), (14, "v")], "node long, label string")
    got = network.overlap(nodes, edges).orderBy("position").collect()
    assert [(r.label, r.support) for r in got] == [("x", 4), ("alpha_alt", 2), ("y", 2), ("z", 2), ("alpha", 1), ("beta", 1), ("charlie", 1), ("w", 1), ("private", 0), ("v", 0)]
    assert [r.dense_rank for r in got] == [1, 2, 2, 2, 3, 3, 3, 3, 4, 4]


def test_entity_union_golden(spark):
    entity = {1: 1, 5: 1, 2: 2, 3: 3, 10: 5, 99: 7}
    edges = spark.createDataFrame([e for e in EDGES if e[0] in {1, 2, 3, 5}], "source long, target long")
    s = spark.createDataFrame([(k, v) for k, v in entity.items()], "source long, source_entity long")
    t = s.select(F.col("source").alias("target"), F.col("source_entity").alias("target_entity"))
    got = {(r.target_entity, r.dense_rank, r.support, r.channels) for r in network.entity_union(edges, s, t).collect()}
    assert got == {(5, 1, 3, 1), (1, 2, 2, 2), (2, 3, 1, 1), (3, 3, 1, 1), (7, 4, 0, 1)}


def test_pagerank_sums_to_one_and_matches_power_iteration(spark):
    own = [e for e in EDGES if e[0] in {1, 2, 3, 5}]
    edges = spark.createDataFrame(own, "source long, target long")
    sources = spark.createDataFrame([(i,) for i in (1, 2, 3, 5)], "node long")
    seeds = spark.createDataFrame([(1, 1.0)], "node long, weight double")
    got = {r.node: r.score for r in pagerank.pagerank(spark, edges, sources, seeds).collect()}
    degree = {s: sum(e[0] == s for e in own) for s in (1, 2, 3, 5)}
    step = lambda v, ok: {n: (n == 1) * (1 - 0.85 * sum(v.get(s, 0) / degree[s] for s, t in own if ok(t))) + 0.85 * sum(v.get(s, 0) / degree[s] for s, t in own if t == n and ok(t)) for n in {1} | {t for _, t in own if ok(t)}}
    v = {1: 1.0}
    for _ in range(200):
        v = step(v, lambda t: t in (1, 2, 3, 5))
    want = step(v, lambda t: True)
    assert abs(sum(got.values()) - 1) < 1e-12
    assert all(abs(got[n] - want[n]) < 1e-9 for n in want)


def test_pagerank_that_does_not_converge_raises(spark):
    e = spark.createDataFrame([(1, 2), (2, 1)], "source long, target long")
    with pytest.raises(pagerank.NotConverged):
        pagerank.pagerank(spark, e, e.select(F.col("source").alias("node")), spark.createDataFrame([(1, 1.0)], "node long, weight double"), tolerance=1e-30, rounds=1)


def posts(spark, rows):
    df = spark.createDataFrame(rows, "post_id string, author string, post_type string, in_reply_to string, conversation_id string, discovered_at timestamp, day date")
    return df.withColumns({"published_at": F.col("discovered_at"), "direct": F.lit(True)})


def test_event_golden(spark):
    d, t = dt.date(2026, 7, 11), lambda h: dt.datetime(2026, 7, 11, h)
    p = posts(spark, [("1", "alice", "original", None, "1", t(8), d), ("2", "bob", "retweet", None, "2", t(9), d), ("3", "carol", "quote", None, "3", t(10), d)])
    rel = spark.createDataFrame([("2", "retweet", "1"), ("3", "quote", "9")], "source_id string, relation_type string, target_id string")
    links = events.all_links(spark, p, rel)
    got = events.clusters(p, events.members(spark, p, links)).collect()
    assert sorted((r.root, r.members, r.links, r.representative) for r in got) == [("1", 2, 1, "1"), ("9", 1, 1, "3")]


def test_third_party_reply_makes_no_event(spark):
    d, t = dt.date(2026, 7, 11), dt.datetime(2026, 7, 11)
    p = posts(spark, [("1", "alice", "original", None, "1", t, d), ("2", "bob", "reply", "1", "1", t, d), ("3", "carol", "quote", None, "3", t, d)])
    rel = spark.createDataFrame([("3", "quote", "2")], "source_id string, relation_type string, target_id string")
    assert events.all_links(spark, p, rel).count() == 0


def test_author_replies_hang_on_parent_or_root(spark):
    d, t = dt.date(2026, 7, 11), dt.datetime(2026, 7, 11)
    p = posts(spark, [("1", "a", "original", None, "1", t, d), ("2", "a", "reply", "1", "1", t, d), ("3", "b", "reply", "2", "1", t, d), ("4", "a", "reply", "3", "1", t, d)])
    rel = spark.createDataFrame([], "source_id string, relation_type string, target_id string")
    assert {tuple(r) for r in events.all_links(spark, p, rel).collect()} == {("2", "1", "reply_parent"), ("4", "1", "primary_thread")}


def test_several_parents_and_cycles_raise(spark):
    d, t = dt.date(2026, 7, 11), dt.datetime(2026, 7, 11)
    p = posts(spark, [("1", "a", "quote", None, "1", t, d)])
    rel = spark.createDataFrame([("1", "quote", "8"), ("1", "quote", "9")], "source_id string, relation_type string, target_id string")
    with pytest.raises(events.BrokenForest):
        events.all_links(spark, p, rel)
    with pytest.raises(events.BrokenForest):
        events.roots(spark, spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "source_id string, target_id string"))


def test_deep_chain_has_one_root(spark):
    links = spark.createDataFrame([(f"{i:04d}", f"{i - 1:04d}") for i in range(1, 300)], "source_id string, target_id string")
    got = events.roots(spark, links)
    assert got.where("root <> '0000'").count() == 0 and got.agg(F.max("depth")).first()[0] == 299 and got.count() == 300


def test_as_of_is_monotone(spark):
    d = [dt.date(2024, 1, i) for i in (1, 2, 3)]
    rows = [(str(i), "a", "original", None, str(i), dt.datetime(2024, 1, i + 1), d[i]) for i in range(3)]
    early = events.as_of(posts(spark, rows[:2]), "2024-01-02").collect()
    assert early == events.as_of(posts(spark, rows), "2024-01-02").collect()


def layers(spark, rows):
    return spark.createDataFrame([("d", *r) for r in rows], "day string, item string, trusted_votes long, mean_voter_position decimal(7,6), author_position decimal(7,6), public_interactions long")


def test_rank_ties_go_by_id_under_any_order(spark):
    from decimal import Decimal as D

    base = [(i, 1, D("0.5"), D("0.1"), 5) for i in "cab"]
    for seed in range(3):
        random.Random(seed).shuffle(base)
        got = rank.daily_rank(layers(spark, base)).orderBy("daily_rank").collect()
        assert [r.item for r in got] == ["a", "b", "c"] and {r.decided_at_layer for r in got} == {5}


def test_deciding_layers(spark):
    from decimal import Decimal as D

    got = rank.daily_rank(layers(spark, [("a", 3, D("0.5"), D("0.1"), 5), ("b", 2, D("0.9"), D("0.1"), 5), ("c", 2, D("0.8"), D("0.7"), 5), ("d", 2, D("0.8"), D("0.7"), 4)])).orderBy("daily_rank").collect()
    assert [(r.item, r.decided_at_layer) for r in got] == [("a", 1), ("b", 2), ("c", 4), ("d", 4)]


def test_recursive_walk_and_media(spark):
    inner = '{"id":"9","created_at":"2026-07-01T00:00:00Z","text":"in","author":{"userName":"Out"},"extendedEntities":{"media":[{"type":"image"}]},"entities":{"urls":[{"url":"https://t.co/a","expanded_url":"https://e.com/x"}]}}'
    raw = '{"id":"3","createdAt":"2026-07-11T10:00:00Z","text":" a  b ","author":{"userName":"@Carol","id":"7"},"likeCount":0,"like_count":4,"quoted_tweet":%s,"retweeted_tweet":{"id":"3"}}' % inner
    df = spark.createDataFrame([(raw, dt.datetime(2026, 7, 12))], "j string, discovered_at timestamp").select(F.parse_json("j").alias("raw"), "discovered_at")
    nodes, rel = feed.walk(df)
    assert [(r.source_id, r.relation_type, r.target_id) for r in rel.collect()] == [("3", "quote", "9")]
    assert nodes.count() == 2
    r = df.select(*[c.alias(k) for k, c in feed.normalised(F.col("raw")).items()], F.lit(1)).first()
    assert (r.post_id, r.author, r.text, r.likes) == ("3", "carol", "a b", 4)
    assert [r.media for r in feed.media_types(df.withColumn("k", F.lit(1)), "k").collect()] == [["photo"]]
    assert [tuple(x) for x in feed.url_evidence(df).collect()] == [("https://t.co/a", "https://e.com/x", "quoted_entity", "9")]


def test_links_and_media_at_any_depth(spark):
    link = '"entities":{"urls":[{"url":" https://t.co/%d ","expanded_url":"https://e.com/%d"},{"url":""},7]}'
    raw = '{"id":"61",%s,"extended_entities":{"media":[{"type":" Animated_GIF "},{"type":"poll"},"x"]}}' % (link % (61, 61))
    for k in range(60, 0, -1):
        raw = '{"id":%s,%s,"%s":%s}' % (f'"{k}"' if k % 2 else k, link % (k, k), "quoted_tweet" if k % 2 else "retweeted_tweet", raw)
    odd = '{"id_str":"s","entities":{"urls":[{"url":"https://t.co/s"}]},"card":[{"extendedEntities":{"media":[{"type":"VIDEO"}]}},"see HTTPS://x.com/I/Spaces/1"],"quoted_tweet":{"quoted_tweet":%s},"extendedEntities":5,"extended_entities":{"media":{}}}' % raw
    df = spark.createDataFrame([(0, raw), (1, odd), (2, "[]"), (3, None)], "k int, j string").select("k", F.parse_json("j").alias("raw"))
    want = [(f"https://t.co/{k}", f"https://e.com/{k}", "entity" if k == 1 else "retweeted_entity" if k % 2 else "quoted_entity", str(k)) for k in range(1, 62)]
    got = [tuple(r) for r in feed.url_evidence(df).collect()]
    assert sorted(got) == sorted([*want, ("https://t.co/s", "https://t.co/s", "entity", "s")])
    media = {r.k: r.media for r in feed.media_types(df, "k").collect()}
    assert media == {0: ["animated_gif"], 1: ["animated_gif", "audio", "video"], 2: [], 3: []}


def _raw(spark, *payloads):
    rows = [(p, dt.datetime(2026, 7, 12 + k)) for k, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "j string, discovered_at timestamp").select(F.parse_json("j").alias("raw"), "discovered_at")


def test_walk_keeps_relations_that_lead_back(spark):
    t = '"createdAt":"2026-07-11T10:00:00Z"'
    df = _raw(spark, '{"id":"A",%s,"quotedTweet":{"tweetId":"B",%s,"quoted_tweet":{"id":"A",%s,"quoted_tweet":{"id":"Z",%s}}}}' % (t, t, t, t), '{"id":"C",%s,"retweetedTweet":{"id":"D"},"quoted_tweet":{"id":"C",%s}}' % (t, t))
    nodes, rel = feed.walk(df)
    assert sorted(tuple(r)[:3] for r in rel.collect()) == [("A", "quote", "B"), ("B", "quote", "A"), ("C", "retweet", "D")]
    assert {r.id for r in nodes.where("opaque").collect()} == {"D"}
    assert {r.disclosure_id for r in rel.where("source_id = 'B'").collect()} == {"A"}


def test_walk_has_no_depth_limit_and_the_first_disclosure_counts(spark):
    t = '"createdAt":"2026-07-11T10:00:00Z"'
    raw = '{"id":"p30",%s}' % t
    for k in range(29, -1, -1):
        raw = '{"id":"p%d",%s,"quoted_tweet":%s}' % (k, t, raw)
    again = '{"id":"p3",%s,"quoted_tweet":{"id":"p4",%s}}' % (t, t)
    rel = {(r.source_id, r.target_id): r.disclosure_id for r in feed.walk(_raw(spark, raw, again))[1].collect()}
    assert rel == {(f"p{k}", f"p{k + 1}"): "p0" for k in range(30)}


def test_priority_follows_the_payload(spark):
    import hashlib
    import json

    post = {"id": "1", "createdAt": "2026-07-11T10:00:00Z", "text": " a  b ", "author": {"id": "5", "name": " "}, "twitterUrl": "u", "likeCount": 3, "bookmarkCount": 0, "view_count": 99, "quotedTweet": {"id": "2"}, "retweeted_tweet": {}}
    want = f"0001:0004:{3:08d}:{3:020d}:" + hashlib.sha256(json.dumps(post, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    r = _raw(spark, json.dumps(post)).select(feed.priority(F.col("raw")).alias("p"), *[c.alias(k) for k, c in feed.normalised(F.col("raw"), "Known").items()]).first()
    assert r.p == want and (r.author, r.author_x_id, r.author_name, r.url, r.post_type, r.views, r.bookmarks) == ("known", "5", None, "u", "quote", 99, None)


def test_representative_is_a_child_of_an_uncaptured_root(spark):
    d, t = dt.date(2026, 7, 11), lambda h: dt.datetime(2026, 7, 11, h)
    p = posts(spark, [("b", "x", "quote", None, "b", t(9), d), ("c", "y", "quote", None, "c", t(9), d), ("a", "z", "quote", None, "a", t(8), d)])
    p = p.withColumns({"published_at": F.when(F.col("post_id") == "b", F.lit(t(7))).otherwise(F.lit(t(6))), "direct": F.col("post_id") == "a"})
    rel = spark.createDataFrame([("b", "quote", "9"), ("c", "quote", "9"), ("a", "quote", "b")], "source_id string, relation_type string, target_id string")
    links = events.all_links(spark, p, rel)
    assert [r.representative for r in events.clusters(p, events.members(spark, p, links)).collect()] == ["c"]


def test_authors_by_id_and_conversations_that_are_replies(spark):
    d, t = dt.date(2026, 7, 11), dt.datetime(2026, 7, 11)
    p = posts(spark, [("1", "old", "original", None, "1", t, d), ("2", "new", "reply", "1", "1", t, d), ("3", "new", "reply", "x", "2", t, d), ("4", "new", "reply", "x", "3", t, d), ("5", "old", "reply", "1", "1", t, d), ("6", "old", "reply", "7", "7", t, d), ("7", "old", "reply", "6", "6", t, d)])
    p = p.withColumn("author_x_id", F.when(F.col("post_id") == "5", "other").otherwise("same"))
    rel = spark.createDataFrame([], "source_id string, relation_type string, target_id string")
    got = {tuple(r) for r in events.all_links(spark, p, rel).collect()}
    assert got == {("2", "1", "reply_parent"), ("3", "1", "primary_thread"), ("4", "1", "primary_thread"), ("6", "7", "reply_parent"), ("7", "6", "reply_parent")}


def test_week_takes_activity_days_and_the_richest_revision(spark):
    d = lambda k: dt.date(2024, 1, k)
    rows = [("e", d(8), 4, 3, [d(1), d(8), d(9)], "s8"), ("e", d(10), 2, 3, None, "s10"), ("e", d(12), 2, 1, [d(12), d(20)], "s12"), ("e", d(7), 1, 99, None, "early")]
    df = spark.createDataFrame(rows, "event string, day date, daily_rank long, member_count long, activity_days array<date>, snapshot string")
    r = events.week(df, "2024-01-14", carried=("snapshot",)).first()
    assert (r.best_rank, r.best_day, r.member_count, r.revision_day, r.snapshot, r.active_days) == (2, d(10), 3, d(10), "s10", [d(8), d(9), d(10), d(12)])


def test_pages_of_posts(spark):
    rows = [('{"data":{"tweets":[{"id":"1"},5]},"has_next_page":false,"next_cursor":"c"}',), ('{"tweets":[{"id":"2"}],"next_cursor":"c"}',), ("broken",), (None,)]
    df = spark.createDataFrame(rows, "body string")
    assert feed.page_posts(df).count() == 2
    assert [r[0] for r in df.select(feed.page_is_valid(F.col("body"))).collect()] == [False, True, False, False]
    assert [tuple(r[0]) for r in df.select(feed.pagination(F.col("body"))).collect()[:2]] == [(False, None), (True, "c")]


def test_bundle_golden(spark):
    ev = spark.createDataFrame([("a", True, 2), ("b", False, 4), ("c", False, 1)], "event_id string, is_organisation boolean, daily_rank long")
    art = lambda day, merge: spark.createDataFrame([(e, "r", "https://e.com/r", 1, merge, day) for e in "ab"], "event_id string, artifact_id string, url string, source_rank long, merge_anchor boolean, first_day date")
    run = lambda *x: sorted((r.primary_event, r.n_events) for r in developments.bundles(spark, ev, art(*x), "2024-01-02").collect())
    assert run(dt.date(2024, 1, 2), True) == [("a", 2), ("c", 1)]
    assert run(dt.date(2024, 1, 1), True) == [("c", 1)]
    assert run(dt.date(2024, 1, 2), False) == [("a", 1), ("b", 1), ("c", 1)]
    assert run(None, True) == [("a", 2), ("c", 1)]


def test_gate(spark):
    schema = "packet long, place long, source_type string, relation string, text string, media_types array<string>"
    rows = [(1, 0, "x_post", "root", "GPT-5.6 admitted that it lied to me.", []), (2, 0, "x_post", "root", "Watch it https://t.co/e", []), (3, 0, "x_post", "root", "hi", ["video"]), (4, 0, "x_post", "root", "hi", []), (4, 1, "artifact", None, "t", []), (5, 0, "x_post", "root", "w " * 31, [])]
    got = {r.packet: r.code for r in routing.gate(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: "short_unsupported_text", 2: "unavailable_linked_or_media_evidence", 3: "unsupported_media", 4: None, 5: None}


def test_quota_cohort_keeps_caps(spark):
    rows = [(f"a{i:02d}", "paper" if i % 3 else "video", f"h{i % 4}", f"e{i % 9}", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "artifact_id string, stratum string, host string, event string, score double")
    got = artifacts.quota_cohort(df, {"paper": 20, "video": 10}, 12).toPandas()
    assert len(got) == 12 and got.host.value_counts().max() <= 4 and got.event.value_counts().max() <= 2 and got.place.tolist() == list(range(1, 13))


def test_converge_and_search(spark):
    rows = spark.createDataFrame([("c", 1), ("z", 2)], "artifact_id string, n long")
    alias = spark.createDataFrame([("c", "b"), ("b", "a")], "a string, b string")
    assert {tuple(r) for r in artifacts.converge(spark, alias, rows).collect()} == {("a", 1), ("z", 2)}
    names = spark.createDataFrame([("50%_off",), ("50xyoff",)], "t string")
    assert [r.t for r in artifacts.like_search(names, "t", "50%_").collect()] == ["50%_off"]


def test_upserts(spark):
    log = spark.createDataFrame([("p", False, 1, "9"), ("p", True, 2, "1"), ("q", False, 1, "1"), ("q", False, 1, "2")], "post_id string, direct boolean, discovered_at long, priority string")
    assert {(r.post_id, r.direct, r.priority) for r in upserts.canonical_posts(log).collect()} == {("p", True, "1"), ("q", False, "2")}


def test_publication(spark, tmp_path):
    df = spark.range(5).selectExpr("id", "id % 2 as k")
    run = publication.run_id(df, ["id", "k"], "v1")
    assert run == publication.run_id(df.repartition(3), ["id", "k"], "v1") != publication.run_id(df, ["id", "k"], "v2")
    root = f"file://{tmp_path}/runs"
    assert [publication.materialise(df, root, run) for _ in range(2)] == [False, True]
    days = spark.createDataFrame([(1, "r1")], "day long, run_id string")
    done = spark.createDataFrame([("r1",)], "run_id string")
    assert publication.publish(spark, days, done, f"file://{tmp_path}/pointer") == 1
    assert [tuple(r) for r in publication.published(spark, f"file://{tmp_path}/pointer").collect()] == [("1", "r1")]
    with pytest.raises(ValueError):
        publication.publish(spark, spark.createDataFrame([(2, "r9")], "day long, run_id string"), done, f"file://{tmp_path}/pointer")


def _cohorts(spark, root, items, days=None, **named):
    runs = spark.createDataFrame([(f"2024-01-0{d}", f"x{k}", k, "p1") for d in range(1, 7) for k in range(1, 7)], "day string, development_id string, daily_rank long, prompt_version string")
    df = spark.createDataFrame(items, publication.ITEM)
    return publication.publish_cohorts(df, runs, root, "p1", "now", "readers", "top", 5, days, **named)


def _shown(spark, root):
    return sorted((r.day, r.development_id, r.daily_rank) for r in publication.published_cohorts(spark, root).collect())


def test_cohorts_that_do_not_hold_change_nothing(spark, tmp_path):
    root, one = f"file://{tmp_path}/cohorts", [("2024-01-01", "x1", 1)]
    assert _shown(spark, root) == [] and _cohorts(spark, root, one) == 1
    for fault, items, days in (
        ("repeated_development", [("2024-01-02", "x2", 2), ("2024-01-02", "x2", 3)], None),
        ("repeated_rank", [("2024-01-02", "x2", 2), ("2024-01-02", "x3", 2)], None),
        ("several_days", [("2024-01-02", "x2", 2), ("2024-01-03", "x2", 2)], None),
        ("other_day", [("2024-01-02", "x1", 1)], None),
        ("no_completed_run", [("2024-01-02", "x2", 3)], None),
        ("no_candidates", [("2024-01-02", "x2", 2)], ["2024-01-02", "2024-01-03"]),
    ):
        with pytest.raises(ValueError, match=fault):
            _cohorts(spark, root, items, days)
        assert _shown(spark, root) == one
    assert _cohorts(spark, root, [("2024-01-01", "x2", 2), ("2024-01-02", "x1", 1)]) == 2
    assert _shown(spark, root) == [("2024-01-01", "x2", 2), ("2024-01-02", "x1", 1)]


def test_a_publication_that_stops_anywhere_leaves_the_last_version(spark, tmp_path, monkeypatch):
    root, one = f"file://{tmp_path}/cohorts", [("2024-01-01", "x1", 1)]
    _cohorts(spark, root, one)
    put, link = publication._put_if_absent, os.link

    def dies(*_):
        raise KeyboardInterrupt

    for step in ((publication, "cohorts"), (publication, "_put_if_absent"), (publication.os, "link")):
        with monkeypatch.context() as m:
            m.setattr(*step, dies)
            with pytest.raises(KeyboardInterrupt):
                _cohorts(spark, root, [("2024-01-01", "x2", 2)])
        assert _shown(spark, root) == one

    def dies_after(*x):
        assert put(*x)
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(publication, "_put_if_absent", dies_after)
        with pytest.raises(KeyboardInterrupt):
            _cohorts(spark, root, [("2024-01-01", "x2", 2)])
    assert os.link is link and _shown(spark, root) == [("2024-01-01", "x2", 2)]


def test_concurrent_publications_all_count_and_readers_never_see_none(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    log = publication.DayLog(spark, f"file://{tmp_path}/log")
    log.commit({"first": {"run_id": "r"}})
    empty = []
    with ThreadPoolExecutor(8) as pool:
        work = [pool.submit(log.commit, {f"d{k}": {"run_id": str(k)}}) for k in range(40)]
        reads = [pool.submit(lambda: empty.append(1) if not log.read()[1] else None) for _ in range(40)]
        versions = sorted(w.result() for w in work)
        [r.result() for r in reads]
    version, days = log.read()
    assert versions == list(range(2, 42)) and version == 41 and len(days) == 41 and not empty
    with pytest.raises(publication.Conflict):
        log.commit({"d3": {"run_id": "z"}}, base=1)
    assert log.commit({"new": {"run_id": "z"}}, base=1) == 42

    def refuses(others):
        raise ValueError(len(others))

    with pytest.raises(ValueError, match="41"):
        log.commit({"new": {}}, refuses)


def test_walks_of_any_length_and_circles(spark):
    from tessera.operators.graph import walked

    steps = [("a", k, k + 1) for k in range(1, 200)] + [("b", 1, 2), ("b", 2, 3), ("b", 3, 2), ("c", 1, 9)]
    df = spark.createDataFrame(steps, "key string, node long, next long")
    starts = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 1)], "key string, node long")
    got = {(r.key, r.node): r.ordinal for r in walked(spark, df, starts, ["key"], 150).collect()}
    assert got == {("a", k): k for k in range(1, 151)} | {("b", 1): 1, ("b", 2): 2, ("b", 3): 3, ("c", 1): 1}


def test_coverage_proofs(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    page = lambda h, c, nxt, oldest=5, **o: (h, c, o.get("at", t(20)), f"{h}{c}{o.get('at')}", o.get("posts", True), o.get("bad", False), t(oldest + 1), t(oldest), o.get("more", True), nxt)
    rows = [page("start", None, "a"), page("start", "a", "b", 1), page("end", None, "a"), page("end", "a", None, more=False), page("stale", None, "a", at=t(10)), page("gone", "", "a"), page("posts", None, "a"), page("posts", "a", "b", posts=False)]
    rows += [page("time", None, "a"), page("time", "a", "b", bad=True), page("none", None, " ".strip()), page("loop", None, "a"), page("loop", "a", "b", 4), page("loop", "b", "a", 3), page("long", None, "1")] + [page("long", str(k), str(k + 1)) for k in range(1, 9)]
    rows += [page("new", None, "z", at=t(19), posts=False), page("new", None, None, more=False)]
    pages = spark.createDataFrame(rows, "handle string, cursor string, fetched_at timestamp, response_id string, has_posts boolean, bad_time boolean, newest timestamp, oldest timestamp, has_next boolean, next_cursor string")
    asked = spark.createDataFrame([(h, dt.date(2024, 1, 2), dt.date(2024, 1, 10)) for h in ("start", "end", "stale", "gone", "posts", "time", "none", "loop", "long", "new", "absent")], "handle string, start_day date, end_day date")
    got = {r.handle: (r.complete, r.reason, r.pages) for r in coverage.proven(spark, pages, asked, 6).collect()}
    assert got == {"start": (True, "boundary", 2), "end": (True, "terminal", 2), "stale": (False, "base_missing", 0), "gone": (False, "cursor_missing", 1), "posts": (False, "no_posts", 1), "time": (False, "bad_time", 1), "none": (False, "no_cursor", 1), "loop": (False, "repeated_cursor", 3), "long": (False, "too_many_pages", 6), "new": (True, "terminal", 1), "absent": (False, "base_missing", 0)}
    assert {r.reason for r in coverage.proven(spark, pages.where("handle = 'loop'"), asked.where("handle = 'loop'"), 3).collect()} == {"repeated_cursor"}


def test_runs_are_chosen_by_their_end(spark):
    d = lambda k: dt.date(2024, 1, k)
    runs = [("k", "short", d(1), d(3)), ("k", "long", d(2), d(5)), ("k", "late", d(6), d(9)), ("k", "tie", d(5), d(9)), ("k", "odd", d(9), d(8)), ("g", "one", d(1), d(2)), ("g", "two", d(4), d(9)), ("w", "all", d(1), d(31))]
    df = spark.createDataFrame(runs, "key string, run_id string, date_from date, date_to date")
    asked = spark.createDataFrame([("k", d(2), d(9)), ("g", d(1), d(9)), ("w", d(3), d(4)), ("n", d(1), d(2)), ("e", d(3), d(2))], "key string, start_day date, end_day date")
    got = {r.key: (r.complete, r.first_uncovered_day, r.run_ids) for r in coverage.chosen_runs(spark, df, asked).collect()}
    assert got == {"k": (True, None, ["long", "tie"]), "g": (False, d(3), ["one"]), "w": (True, None, ["all"]), "n": (False, d(1), []), "e": (True, None, [])}


def test_registry_claims_and_manifest(spark):
    own = spark.createDataFrame([(1, "u"), (2, "k"), (3, "v"), (4, "v")], "channel_id long, entity_id string")
    ent = spark.createDataFrame([("u", "U", "unknown"), ("k", "K", "person"), ("v", "V", "unknown"), ("n", "N", "person")], "entity_id string, name string, kind string")
    want = spark.createDataFrame([(1, "n"), (2, "n"), (3, "n"), (9, "n")], "channel_id long, entity_id string")
    assert {tuple(r) for r in registry.claim(own, ent, want).collect()} == {(1, "n"), (2, "k"), (3, "v"), (4, "v"), (9, "n")}
    good = spark.createDataFrame([("u", "New", None)], "entity_id string, name string, kind string")
    assert registry.apply_manifest(ent, good).where("entity_id = 'u'").first().name == "New"
    with pytest.raises(ValueError):
        registry.apply_manifest(ent, good.union(good))


def test_coverage_gaps(spark):
    runs = spark.createDataFrame([(dt.date(2024, 1, 1), dt.date(2024, 1, 3)), (dt.date(2024, 1, 5), dt.date(2024, 1, 5)), (None, None)], "date_from date, date_to date")
    assert [r.day for r in coverage.missing_days(runs, "2024-01-01", "2024-01-06").orderBy("day").collect()] == [dt.date(2024, 1, 4), dt.date(2024, 1, 6)]


def test_insight_helpers(spark):
    df = spark.createDataFrame([([("reply", True), ("quote", False), ("x", False)],)], "i array<struct<relation:string,own:boolean>>")
    assert tuple(df.select(insights.relationship_counts(F.col("i"))).first()[0]) == (1, 1, 0, 1)
    ranked = spark.createDataFrame([("a", 1), ("a", 3)], "day string, daily_rank long")
    assert insights.contiguous_ranks(ranked).count() == 1


def test_quota_cohort_equals_the_choice_over_all_rows(spark):
    rng = random.Random(3)
    quotas, limit, per_host, per_event = {"a": 10, "b": 6, "c": 4}, 15, 2, 3
    for hosts, events in ((3, 400), (400, 4), (60, 60)):
        rows = [(k, rng.choice("abcd"), f"h{rng.randrange(hosts)}", f"e{rng.randrange(events)}", float(rng.randrange(300))) for k in range(1500)]
        df = spark.createDataFrame(rows, "artifact_id long, stratum string, host string, event string, score double")
        got = [r.artifact_id for r in artifacts.quota_cohort(df, quotas, limit, per_host, per_event).orderBy("place").collect()]
        taken, h, e = [], Counter(), Counter()
        ordered = sorted(rows, key=lambda r: (r[4], r[0]))

        def take(some, most):
            for r in some:
                if len(taken) >= most:
                    return
                if r[0] not in taken and h[r[2]] < per_host and e[r[3]] < per_event:
                    taken.append(r[0])
                    h[r[2]] += 1
                    e[r[3]] += 1

        for stratum, quota in quotas.items():
            take([r for r in ordered if r[1] == stratum], len(taken) + min(max(1, round(quota * limit / 30)), limit - len(taken)))
        take(ordered, limit)
        assert got == taken


def test_ranked_places_all_rows_in_order(spark):
    from tessera.operators.network import ranked

    rng = random.Random(4)
    rows = [(k, rng.randrange(5), rng.choice("xyz")) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, n long, name string")
    got = {r.id: r.place for r in ranked(df, [F.desc("n"), F.asc("name"), F.asc("id")], "place").collect()}
    assert got == {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[2], r[0])), 1)}
    assert ranked(df.limit(0), [F.asc("id")]).count() == 0


def test_page_chains_faults_and_conflicts(spark):
    from tessera.operators import snapshots

    acc = [(1, "a")]
    schema = "source long, cursor string, next_cursor string, has_next boolean, body string, accounts array<struct<x_id:long,handle:string>>"
    good = [(1, "", "p", True, "b1", acc), (1, "p", "", False, "b2", acc), (2, "", "q", True, "b3", acc), (3, "lost", "", False, "b4", acc)]
    pages = spark.createDataFrame(good, schema)
    assert sorted(tuple(r) for r in snapshots.page_order(spark, pages).collect()) == [(1, "", 1, True), (1, "p", 2, True), (2, "", 1, False)]
    assert not snapshots.page_faults(pages).count()
    again = spark.createDataFrame([(1, "p", "", False, "b2", acc), (2, "q", "", False, "b5", acc)], schema)
    assert [r.body for r in snapshots.record_pages(pages, again).collect()] == ["b5"]
    with pytest.raises(snapshots.Conflict):
        snapshots.record_pages(pages, spark.createDataFrame([(1, "p", "", False, "other", acc)], schema))
    with pytest.raises(Exception, match="several pages"):
        snapshots.page_order(spark, spark.createDataFrame([(1, "", "p", True, "x", acc), (1, "p", "q", True, "x", acc), (1, "q", "p", True, "x", acc)], schema))


def test_manifests_are_applied_as_a_whole(spark):
    ents = spark.createDataFrame([(1, "unknown", "h1"), (2, "person", "h2")], "entity_id long, kind string, input_sha256 string")
    res = spark.createDataFrame([(1, "old", "v", "org", 1, 1), (1, "h1", "w", "org", 1, 1)], "entity_id long, input_sha256 string, contract string, kind string, finished_at long, run_id long")
    with pytest.raises(ValueError):
        registry.promote(ents, res, "v")
    assert sorted(tuple(r) for r in registry.promote(ents, res, "w").select("entity_id", "kind").collect()) == [(1, "org"), (2, "person")]
    groups = spark.createDataFrame([(7, "g", 1), (7, "g", 9)], "group_id long, name string, member long")
    with pytest.raises(ValueError):
        registry.apply_groups(ents, groups)
    assert registry.apply_groups(ents, groups.where("member = 1")).where("group_id = 7").count() == 1


def test_messages_are_sent_once(spark, tmp_path):
    from tessera.sources import messages

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "key long, body string").coalesce(1)
    folder = str(tmp_path)

    def send(part):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write("".join(r.body for r in part))

    sent = messages.deliver(rows, spark.createDataFrame([(2,)], "key long"), "key", send)
    assert sorted(r.key for r in sent.collect()) == [1, 3]
    assert "".join(sorted("".join(p.read_text() for p in tmp_path.iterdir()))) == "ac"
    long = spark.createDataFrame([("2024-01-01", 1, "a<b", "x" * 7 + " yy z & w")], "day string, place long, headline string, body string")
    parts = [r.block for r in messages.blocks(long, 8).orderBy("part").collect()]
    assert "".join(parts).replace(" ", "") == "*a&lt;b*" + "x" * 7 + "yyz&amp;w" and all(len(p) <= 8 for p in parts)


def test_leases_equal_a_replay_by_hand(spark):
    import pandas as pd

    from tessera.streaming import streams

    rng = random.Random(6)
    rows = [(rng.randrange(12), pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=rng.randrange(120)), k, rng.choice(["claim", "claim", "done", "fail"])) for k in range(200)]
    got = {r.item: (r.status, r.attempts) for r in streams.leases(spark.createDataFrame(pd.DataFrame(rows, columns=["item", "at", "seq", "event"]))).collect()}
    for item in {r[0] for r in rows}:
        status, attempts, until, lapsed = "pending", 0, None, False
        for _, at, _, what in sorted((r for r in rows if r[0] == item), key=lambda r: (r[1], r[2])):
            if what == "claim":
                if status == "in_progress" and at > until:
                    status, lapsed = "failed_retryable", True
                if status in ("pending", "failed_retryable") and attempts < 3:
                    status, attempts, until, lapsed = "in_progress", attempts + 1, at + pd.Timedelta(minutes=10), False
            elif status == "in_progress" or lapsed:
                status, lapsed = {"done": "success", "fail": "failed_retryable"}[what], False
        assert got[item] == (status, attempts)


def test_swept_tables_go_and_others_stay(spark):
    from tessera import session

    outer = session.Scratch(spark)
    kept = outer.write(spark.range(3), "kept")
    with session.swept():
        inner = session.Scratch(spark)
        again = outer.write(inner.write(spark.range(5), "gone"), "again")
        gone = inner.made[0]
    assert kept.count() == 3 and again.count() == 5 and not inner.made
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(gone).count()


def test_merges_follow_chains_and_refuse_as_a_whole(spark, tmp_path):
    ent = spark.createDataFrame([(k, "person" if k < 8 else "organization", f"s{k}", f"n{k}", "old") for k in range(1, 10)], "entity_id long, kind string, slug string, name string, updated_at string")
    ch = spark.createDataFrame([(10 + k, k) for k in range(1, 10)] + [(99, None)], "channel_id long, entity_id long")
    merge = lambda *rows: spark.createDataFrame([(c, d, *(r or (None,) * 3)) for c, d, *r in ((*x[:2], *x[2:]) for x in rows)], "canonical_id long, duplicate_id long, reason string, source string, evidence_url string")
    out = registry.merge_entities(spark, ent, ch, merge((3, 1), (7, 3, "r", "s", "u"), (3, 2), (5, 6)), "new")
    assert {(r.entity_id, r.updated_at) for r in out["entities"].collect()} == {(4, "old"), (5, "new"), (7, "new"), (8, "old"), (9, "old")}
    assert {r.channel_id: r.entity_id for r in out["channels"].collect()} == {11: 7, 12: 7, 13: 7, 14: 4, 15: 5, 16: 5, 17: 7, 18: 8, 19: 9, 99: None}
    assert [(r.canonical_id, r.duplicate_id, r.removed_slug, r.merged_at) for r in out["audit"].collect()] == [(7, 3, "s3", "new")]
    with pytest.raises(events.BrokenForest):
        registry.merge_entities(spark, ent, ch, merge((1, 2), (2, 3), (3, 1)), "new")
    for fault, rows in (("other_kind", [(9, 1)]), ("unknown_canonical", [(50, 1)]), ("unknown_duplicate", [(1, 50)]), ("same_entity", [(1, 1)]), ("several_canonicals", [(2, 1), (3, 1)]), ("partial_audit", [(2, 1, "r", None, None)])):
        with pytest.raises(ValueError, match=fault):
            registry.merge_entities(spark, ent, ch, merge(*rows), "new")
    root = f"file://{tmp_path}/registry"
    assert publication.publish_tables(root, out) == 1 and publication.published_tables(spark, root)["entities"].count() == 5
    with pytest.raises(publication.Conflict):
        publication.publish_tables(root, {"entities": ent}, base=0)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from tessera import session

    class Conf:
        get = staticmethod(lambda *_: None)

    class Cluster:
        conf = Conf
        sparkContext = type("C", (), {"master": "spark://host:7077", "getConf": staticmethod(lambda: Conf)})

    with pytest.raises(RuntimeError):
        session.shared_root(Cluster)


def test_ordered_fingerprint_knows_the_order_and_not_the_partitions(spark):
    df = spark.createDataFrame([(k, f"r{k % 7}") for k in range(200)], "k long, x string")
    mark = lambda d, order=F.col("k"): network.ordered_fingerprint(d, [order], "x").first()[0]
    assert mark(df) == mark(df.repartition(7)) == mark(df.coalesce(1).orderBy(F.desc("k")))
    swapped = df.withColumn("x", F.when(F.col("k") == 3, "r4").when(F.col("k") == 4, "r3").otherwise(F.col("x")))
    assert len({mark(df), mark(df, F.desc("k")), mark(swapped), mark(df.where("k < 199"))}) == 4


def test_chains_of_pages_are_not_sent_through_the_driver(spark):
    pages = spark.createDataFrame([("h", None, "2024-02-03", 1, True, False, "2024-01-31", "2024-01-30", False, None)], "handle string, cursor string, fetched_at string, response_id long, has_posts boolean, bad_time boolean, newest string, oldest string, has_next boolean, next_cursor string")
    asked = spark.sql("SELECT 'h' AS handle, DATE '2024-01-01' AS start_day, DATE '2024-02-01' AS end_day")
    out = coverage.proven(spark, pages.withColumns({c: F.col(c).cast("timestamp") for c in ("fetched_at", "newest", "oldest")}), asked)
    assert [(r.handle, r.reason, r.pages) for r in out.collect()] == [("h", "terminal", 1)]
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_round_of_pagerank_leaves_edges_where_they_are(spark):
    from tessera.session import Scratch

    edges = spark.range(200).select((F.col("id") % 20).alias("source"), (F.col("id") % 7).alias("target"), F.lit(10).cast("long").alias("degree"))
    placed, count = pagerank._edges_in_place(Scratch(spark), edges, "edges_in_place")
    ranks = spark.range(20).select(F.col("id").alias("source"), F.lit(0.05).alias("rank"))
    flow = pagerank._flow(ranks.repartition(count, "source").hint("shuffle_hash"), placed)
    plan = flow._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "BroadcastHashJoin" not in plan
    assert {r.node: round(r.got, 6) for r in flow.collect()} == {k: round(len(range(k, 200, 7)) * 0.005, 6) for k in range(7)}
    spark.sql("DROP TABLE edges_in_place")


def test_rows_are_dealt_to_tasks_of_one_size(spark):
    from tessera import session

    out = session.dealt(spark.range(1000).withColumnRenamed("id", "k"), ["k"], 100)
    assert len(set(out.select(F.spark_partition_id()).collect())) == 10 and out.count() == 1000
    plan = out.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_a_walk_for_media_opens_only_what_names_media(spark, monkeypatch):
    seen, whole = [], feed._levels
    monkeypatch.setattr(feed, "_levels", lambda start, step: seen.extend(whole(start, step)) or seen)
    raw = '{"a":"x","b":{"c":"y"},"extendedEntities":{"media":[{"type":"image"}]},"q":{"note":"https://x.com/i/Spaces/1","n":1}}'
    posts = spark.sql(f"SELECT 1 AS k, parse_json('{raw}') AS raw UNION ALL SELECT 2, parse_json('[\"/i/broadcasts/\"]') UNION ALL SELECT 3, parse_json('{{}}')")
    assert {r.k: r.media for r in feed.media_types(posts, "k").collect()} == {1: ["audio", "photo"], 2: ["audio"], 3: []}
    assert [level.count() for level in seen] == [2, 2, 1]


def test_article_bodies_bound_their_arrow_batches(spark):
    from tessera import session
    from tessera.plans import captures
    from tests.conftest import DATA

    before = spark.conf.get(session.ARROW_KEY, None)
    spark.conf.unset(session.ARROW_KEY)
    captures.article_bodies(spark, DATA)
    assert spark.conf.get(session.ARROW_KEY) == str(session.ARROW_BYTES)
    if before is not None:
        spark.conf.set(session.ARROW_KEY, before)


def test_roots_and_paths_leave_leaves_out_of_the_rounds(spark, monkeypatch):
    """Only nodes that something points to are in the tables that rounds write again."""
    from tessera.operators import events
    from tessera.session import Scratch

    written, write = [], Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(Scratch, "write", counted)
    links = [(f"leaf{k}", "n1") for k in range(50)] + [("n1", "n2"), ("n2", "n3")]
    got = {(r.node, r.root, r.depth) for r in events.roots(spark, spark.createDataFrame(links, "source_id string, target_id string")).collect()}
    assert got == {(f"leaf{k}", "n3", 3) for k in range(50)} | {("n1", "n3", 2), ("n2", "n3", 1), ("n3", "n3", 0)}
    assert max(n for _, n in written[1:-1]) == 2
    written.clear()
    at = dt.datetime(2024, 1, 1)
    rows = [(1, 1, None, "root", at), (1, 2, 1, "reply", at), (1, 3, 2, "reply", at)] + [(1, 10 + k, 3, "reply", at) for k in range(50)]
    o = events.forest_order(spark, spark.createDataFrame(rows, "root long, post_id long, parent_id long, relation string, published timestamp"))
    assert {r.post_id: r.shown_depth for r in o.collect()} == {1: 0, 2: 1, 3: 2} | {10 + k: 3 for k in range(50)}
    assert max(n for name, n in written if name == "paths") == 2


def test_main_texts_are_judged_by_the_size_that_the_caller_gives(spark, tmp_path):
    """At the least size, texts of which cleaning takes a character, or to which it adds one: the query counts as its SQL does, the operator by itself what is left."""
    import duckdb

    from tessera.operators import extraction
    from tessera.plans import catalog

    taken = [x + "x" * (80 - len(x)) for x in ("e\u0301", "a \n", "a\r\n", "a\t\n", "\f")]
    texts = ["x" * 79, "x" * 80, " \n" + "x" * 79 + "\r\n\t", *taken, "\u0958" + "x" * 78]
    rows = [(12 * k + i, t, "en", "s", len(t)) for k, t in enumerate(texts) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns = ["doc_id", "error", "title", "canonical", "charset", "has_text"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()['extracted_bodies']}) ORDER BY doc_id").fetchall()
    got = catalog.queries()["extracted_bodies"](spark, str(tmp_path)).orderBy("doc_id").select(columns)
    assert [tuple(r) for r in got.collect()] == want
    pages = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "k long, main string").withColumns({"body": F.lit("<html>"), "content_type": F.lit("text/html"), "kind": F.lit("other"), "url": F.lit("https://h.example/")})
    short = lambda **size: {r.k for r in extraction.extract(pages, F.col("main"), **size).where("error = 'extraction_empty_or_client_rendered' and text is null").collect()}
    assert short() == {0, 2, 3, 4, 5, 6, 7, 9}
    assert short(main_size=F.length("main")) == {0, 8, 9}
