"""Queries over dimensions: customers and suppliers for entities and accounts, nations for kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import hashing, numbers, text
from tessera.operators import insights, network, publication, registry, upserts
from tessera.operators.pagerank import pagerank
from tessera.plans import adapters as ad
from tessera.plans.network import EDGES
from tessera.session import Scratch, dealt, shuffled


def _entities(spark, sf_dir):
    s = ad.table(spark, sf_dir, "supplier").join(F.broadcast(ad.table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    followers = F.when(F.col("s_suppkey") % 7 != 0, F.floor(F.abs("s_acctbal")).cast("long"))
    return s.select(F.col("s_suppkey").alias("entity_id"), F.lower("s_name").alias("name"), F.lower("n_name").alias("kind"), (F.col("s_acctbal") < 0).alias("rejected"), followers.alias("followers"))


ENT = "ent AS (SELECT s_suppkey AS entity_id, lower(s_name) AS name, lower(n_name) AS kind, s_acctbal < 0 AS rejected, CASE WHEN s_suppkey % 7 <> 0 THEN floor(abs(s_acctbal))::BIGINT END AS followers FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def registry_identities(spark, sf_dir):
    c = ad.table(spark, sf_dir, "customer")
    accounts = c.select(F.col("c_custkey").alias("x_id"), F.concat(F.lit("H"), F.col("c_custkey") % 300).alias("handle"))
    channels = spark.range(0, 200).select("id", F.concat(F.lit("h"), "id").alias("channel_key")).withColumnRenamed("id", "channel_id")
    owners = spark.range(0, 200, 2).select(F.col("id").alias("channel_id"), (F.col("id") % 12 + 1).alias("entity_id"))
    e = _entities(spark, sf_dir)
    return registry.identities(accounts, channels, owners, e.select("entity_id", "name", "kind"), e.where("rejected").select("entity_id")).select("x_id", F.coalesce("entity_id", F.lit(-1).cast("long")).alias("entity_id"), "state")


def reach_ranks(spark, sf_dir):
    return registry.reach_rank(_entities(spark, sf_dir).select("entity_id", "name", "followers")).select("entity_id", F.coalesce("reach_rank", F.lit(-1).cast("long")).alias("reach_rank"), "total")


def kind_counts(spark, sf_dir):
    return registry.kind_counts(_entities(spark, sf_dir), ["france", "germany", "japan", "atlantis"]).select("kind", "n")


def representative_channels(spark, sf_dir):
    c = ad.table(spark, sf_dir, "customer")
    n = F.col("c_custkey")
    label = F.when(n % 13 == 0, F.concat(F.lit("SEG "), "c_mktsegment", F.lit(" inc")))
    key = F.when(n % 11 == 0, F.concat(F.lit("kEY"), F.col("c_nationkey"))).otherwise(F.concat(F.lit("k"), n))
    ch = c.select(F.col("c_nationkey").cast("long").alias("entity_id"), F.concat(F.lit("Key"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey").cast("string")).otherwise("x")).alias("slug"), F.concat(F.lit("Seg "), "c_mktsegment", F.lit(" Inc")).alias("name"), key.alias("channel_key"), F.when(n % 26 == 0, F.lit("shown")).alias("display_name"), label.alias("label"), F.when(n % 7 != 0, F.floor("c_acctbal")).alias("followers"))
    return registry.representative_channel(ch).select("entity_id", "channel_key")


def latest_facts(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("entity_id"), F.col("event_type").alias("fact"), F.col("ts").alias("observed_at"), F.col("event_id").alias("fact_id"))
    kept, deleted = registry.newest_facts(e)
    gone = deleted.groupBy("entity_id").agg(F.count("*").alias("deleted"))
    return kept.groupBy("entity_id").agg(F.count("*").alias("kept"), F.max("fact_id").alias("newest")).join(gone, "entity_id")


def entity_search(spark, sf_dir):
    return registry.search(_entities(spark, sf_dir), "supplier#%7").select("entity_id", "name", "kind")


def entity_page(spark, sf_dir):
    e = _entities(spark, sf_dir).where("not rejected").select("entity_id", "kind", "followers")
    return registry.page(e, [F.desc_nulls_last("followers"), F.asc("entity_id")], 2, 5).select("entity_id", "total")


def customer_facts(spark, sf_dir):
    c = ad.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("x_id"), F.lower("c_name").alias("handle"), F.col("c_mktsegment").alias("segment"), F.when(F.col("c_nationkey") > 5, F.col("c_nationkey")).alias("nation"))
    return registry.to_facts(c, ["handle", "segment", "nation"])


def account_lookup(spark, sf_dir):
    c = ad.table(spark, sf_dir, "customer")
    acc = c.select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).otherwise(-F.col("c_custkey")).alias("x_id"), F.concat(F.lit("h"), F.col("c_custkey") % 50).alias("handle"), F.col("c_nationkey").cast("long").alias("entity_id"))
    rows = c.select(F.col("c_custkey").alias("x_id"), F.concat(F.lit("H"), F.col("c_custkey") % 60).alias("handle"))
    return registry.lookup(rows, acc).select("x_id", F.coalesce("entity_id", F.lit(-1).cast("long")).alias("entity_id"))


def entity_union_support(spark, sf_dir):
    o = ad.support_edges(spark, sf_dir)
    cust = ad.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source"), F.col("c_nationkey").alias("source_entity"))
    sup = ad.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("target"), F.col("s_nationkey").alias("target_entity"))
    return network.entity_union(o, cust, sup)


def support_shares(spark, sf_dir):
    return network.overlap(ad.supplier_nodes(spark, sf_dir), ad.support_edges(spark, sf_dir)).select("node", "support", "position", "dense_rank", "share")


def followers_of(spark, sf_dir):
    e = ad.support_edges(spark, sf_dir)
    accounts = ad.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("x_id"), F.lower("c_name").alias("handle"), F.col("c_nationkey").alias("entity"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("position"))
    return network.followers_of(e, accounts, 7).select("entity", "x_id")


def rank_comparison(spark, sf_dir):
    s = network.overlap(ad.supplier_nodes(spark, sf_dir), ad.support_edges(spark, sf_dir)).select("node", F.col("position").alias("rank"))
    other = network.ranked(ad.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), "s_acctbal"), [F.desc("s_acctbal"), F.asc("node")], "rank")
    return network.compare(s, other)


def support_pagerank(spark, sf_dir):
    """All returned lines, customers folded onto suppliers; rounded, since sums of parts have no fixed order."""
    suppliers = ad.table(spark, sf_dir, "supplier")
    n = suppliers.count()
    edges = ad.support_edges(spark, sf_dir).select((F.col("source") % n).alias("source"), "target").where("source <> target").distinct()
    nodes = suppliers.select(F.col("s_suppkey").alias("node"))
    seeds = suppliers.where("s_suppkey between 1 and 5").select(F.col("s_suppkey").alias("node"), F.col("s_suppkey").cast("double").alias("weight"))
    return pagerank(spark, edges, nodes, seeds).select("node", F.round("score", 6).alias("score"))


def insight_days(spark, sf_dir):
    return insights.day_summary(_runs(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


def _runs(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events")
    return e.select(F.to_date("ts").alias("day"), (F.col("event_id") % 23).alias("development"), (F.col("event_id") % 5).alias("rank"), F.col("event_id").alias("run_id"), F.col("ts").alias("finished_at"), F.when(F.col("event_type") == "purchase", "surface").when(F.col("event_type") != "error", "hold").alias("decision"))


def canonical_runs(spark, sf_dir):
    r = _runs(spark, sf_dir)
    return insights.latest_runs(r, r.where("decision = 'surface'").select("day", "development", "rank")).select("development", "rank", "run_id")


def result_faults(spark, sf_dir):
    d = ad.table(spark, sf_dir, "documents")
    head = F.concat_ws("  ", "source", "lang", F.array_repeat(F.lit("word"), (F.col("doc_id") % 25).cast("int")))
    r = d.select(F.col("doc_id").alias("result_id"), head.alias("headline"), F.when(F.col("doc_id") % 3 == 0, "surface").otherwise("hold").alias("decision"), F.slice(F.array(F.col("source"), F.col("lang"), F.col("source")), 1, (F.col("doc_id") % 4).cast("int")).alias("connections"))
    return insights.result_faults(r).select("result_id", F.array_join("faults", ",").alias("faults"))


def final_faults(spark, sf_dir):
    """Orders as final results, their lines as the companies cited, by return flag."""
    l = ad.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("b"))
    company = F.struct(F.concat(F.lit("s"), "s").alias("ticker"), F.concat(F.lit("b"), "b").alias("bet_id"))
    per = l.groupBy("l_orderkey", "l_returnflag").agg(F.collect_list(company).alias("companies")).groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("title"), "companies")).alias("connections"))
    k = F.col("o_orderkey")
    head = F.concat(F.when(k % 37 != 0, F.lit(" Order")).otherwise(""), F.when(k % 31 == 0, "\nof").otherwise(""), F.repeat(F.lit(" word"), F.when(k % 37 != 0, (k % 25).cast("int")).otherwise(0)), F.when(k % 41 == 0, " [x](y)").otherwise(" "))
    reason = F.when(k % 4 == 0, "nothing fits").when(k % 4 == 1, " ").when(k % 43 == 0, "see HTTPS://e.example")
    o = ad.table(spark, sf_dir, "orders").join(per, F.col("l_orderkey") == k, "left")
    results = o.select(k.alias("result_id"), head.alias("headline"), F.when(k % 3 == 0, "surface").otherwise("suppress").alias("decision"), reason.alias("no_match_reason"), F.when(k % 5 != 0, F.col("connections")).alias("connections"))
    opened = l.where("s % 29 <> 0 and s % 10 <> 7").select(F.col("l_orderkey").alias("result_id"), F.concat(F.lit("s"), "s").alias("ticker"))
    bets = l.where("(s + b) % 13 <> 0").select(F.concat(F.lit("s"), "s").alias("ticker"), F.concat(F.lit("b"), "b").alias("bet_id"))
    return insights.final_faults(results, opened, bets).select("result_id", F.array_join("faults", ",").alias("faults"))


def audit_violations(spark, sf_dir):
    """Lines are dealt to tasks of one size by their order, once for all checks."""
    line = dealt(ad.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"])
    orders = ad.table(spark, sf_dir, "orders").select("o_orderkey")
    repeated = line.groupBy("l_orderkey", "l_linenumber").count().where("count > 1")
    empty = orders.join(shuffled(line), orders.o_orderkey == line.l_orderkey, "left_anti")
    lost = line.join(shuffled(orders), line.l_orderkey == orders.o_orderkey, "left_anti")
    v = insights.violations(("repeated_line", repeated, "l_orderkey"), ("order_without_lines", empty, "o_orderkey"), ("line_without_order", lost, "l_orderkey"), most=3)
    return v.select("code", "n", F.array_join("examples", ",").alias("examples"))


def page_credits(spark, sf_dir):
    c = ad.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = c.select("o_custkey", (F.col("n") * 17 % 260).alias("n"))
    return c.select("o_custkey", numbers.page_credits(F.col("n")).alias("credits"), numbers.projected_credits(F.col("n") * 3).alias("projected"))


def content_ids(spark, sf_dir):
    d = ad.table(spark, sf_dir, "documents")
    return d.select("doc_id", hashing.content_id(F.lit("x"), F.col("source"), F.col("lang")).alias("content_id"), text.slug(F.lit("doc"), F.concat_ws(" & ", "source", "lang")).alias("slug"))


def _customers(spark, sf_dir):
    c = ad.table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("entity_id"), (F.col("c_custkey") % 5).cast("string").alias("kind"), F.concat(F.lit("s"), "c_custkey").alias("slug"), F.col("c_name").alias("name"), F.lit("old").alias("updated_at"))


def merged_entities(spark, sf_dir):
    """Customers of a block of forty and of equal remainder are merged along a chain, each into the next; orders are their channels."""
    entities = _customers(spark, sf_dir)
    channels = ad.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("channel_id"), F.col("o_custkey").alias("entity_id"))
    told = lambda c: F.when(F.col("duplicate_id") % 2 == 0, c)
    merges = entities.where("entity_id % 40 < 35").select((F.col("entity_id") + 5).alias("canonical_id"), F.col("entity_id").alias("duplicate_id")).join(entities.select(F.col("entity_id").alias("canonical_id")), "canonical_id")
    merges = merges.select("*", told("same person").alias("reason"), told("review").alias("source"), told("https://e.example").alias("evidence_url"))
    root = Scratch(spark).path("registry")
    publication.publish_tables(root, registry.merge_entities(spark, entities, channels, merges, "new"))
    now = publication.published_tables(spark, root)
    owned = now["channels"].groupBy("entity_id").agg(F.count("*").alias("channels"))
    removed = now["audit"].groupBy(F.col("canonical_id").alias("entity_id")).agg(F.max("removed_slug").alias("removed_slug"))
    out = now["entities"].join(owned, "entity_id", "left").join(removed, "entity_id", "left")
    return out.select("entity_id", "updated_at", F.coalesce("channels", F.lit(0).cast("long")).alias("channels"), F.coalesce("removed_slug", F.lit("")).alias("removed_slug"))


def merge_faults(spark, sf_dir):
    n = F.col("s_suppkey")
    s = ad.table(spark, sf_dir, "supplier")
    merges = s.select(F.when(n % 6 == 0, n).when(n % 6 == 1, -n).otherwise(n + 1).alias("canonical_id"), F.when(n % 6 == 2, n + 10**6).otherwise(n).alias("duplicate_id"), F.when(n % 6 == 3, "r").alias("reason"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("evidence_url"))
    more = merges.where("duplicate_id % 6 = 4").withColumn("canonical_id", F.col("canonical_id") + 1)
    kinds = s.select(n.alias("entity_id"), F.floor(n / 5).cast("string").alias("kind"))
    return registry.merge_faults(kinds, merges.union(more)).groupBy("fault").agg(F.count("*").alias("n"), F.min("duplicate_id").alias("first"))


QUERIES = [
    (
        "registry_identities",
        registry_identities,
        f"""WITH {ENT}, ch AS (SELECT 'h' || id AS h, id % 12 + 1 AS entity_id FROM (SELECT unnest(range(0, 200, 2)) AS id)),
        a AS (SELECT c_custkey AS x_id, 'h' || (c_custkey % 300) AS h FROM customer)
        SELECT x_id, coalesce(ch.entity_id, -1) AS entity_id, CASE WHEN ch.entity_id IS NULL THEN 'unknown' WHEN rejected THEN 'rejected' ELSE 'active' END AS state FROM a LEFT JOIN ch USING (h) LEFT JOIN ent ON ent.entity_id = ch.entity_id""",
    ),
    (
        "reach_ranks",
        reach_ranks,
        f"WITH {ENT} SELECT entity_id, CASE WHEN followers IS NULL THEN -1 ELSE row_number() OVER (ORDER BY followers DESC NULLS LAST, name, entity_id) END AS reach_rank, count(*) OVER () AS total FROM ent",
    ),
    (
        "kind_counts",
        kind_counts,
        f"WITH {ENT}, k AS (SELECT unnest(['france', 'germany', 'japan', 'atlantis', 'rejected']) AS kind) SELECT k.kind, count(entity_id) AS n FROM k LEFT JOIN ent ON k.kind = CASE WHEN rejected THEN 'rejected' ELSE ent.kind END GROUP BY 1",
    ),
    (
        "representative_channels",
        representative_channels,
        """WITH c AS (SELECT c_nationkey::BIGINT AS entity_id, 'key' || CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey::VARCHAR ELSE 'x' END AS slug, CASE WHEN c_custkey % 11 = 0 THEN 'kEY' || c_nationkey ELSE 'k' || c_custkey END AS channel_key,
        c_custkey % 13 = 0 AND c_custkey % 26 <> 0 AS named, CASE WHEN c_custkey % 7 <> 0 THEN floor(c_acctbal) ELSE 0 END AS followers FROM customer)
        SELECT entity_id, channel_key FROM c QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY lower(channel_key) = slug DESC, named DESC, followers DESC, channel_key) = 1""",
    ),
    (
        "latest_facts",
        latest_facts,
        """WITH f AS (SELECT user_id % 20 AS entity_id, event_type, event_id, row_number() OVER (PARTITION BY user_id % 20, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events)
        SELECT entity_id, count(*) FILTER (k = 1) AS kept, max(event_id) FILTER (k = 1) AS newest, count(*) FILTER (k > 1) AS deleted FROM f GROUP BY 1 HAVING count(*) FILTER (k > 1) > 0""",
    ),
    ("entity_search", entity_search, f"WITH {ENT} SELECT entity_id, name, kind FROM ent WHERE name LIKE '%supplier#%7%' AND NOT rejected"),
    ("entity_page", entity_page, f"WITH {ENT} SELECT entity_id, count(*) OVER () AS total FROM ent WHERE NOT rejected ORDER BY followers DESC NULLS LAST, entity_id LIMIT 5 OFFSET 2"),
    (
        "customer_facts",
        customer_facts,
        """SELECT c_custkey AS x_id, 'handle' AS fact, lower(c_name) AS value FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer UNION ALL SELECT c_custkey, 'nation', c_nationkey::VARCHAR FROM customer WHERE c_nationkey > 5""",
    ),
    (
        "account_lookup",
        account_lookup,
        """WITH a AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE -c_custkey END AS x, 'h' || (c_custkey % 50) AS h, c_nationkey::BIGINT AS e FROM customer), b AS (SELECT h, arg_max(e, x) AS e FROM a GROUP BY 1)
        SELECT c_custkey AS x_id, coalesce(a.e, b.e, -1) AS entity_id FROM customer LEFT JOIN a ON a.x = c_custkey LEFT JOIN b ON b.h = 'h' || (c_custkey % 60)""",
    ),
    (
        "entity_union_support",
        entity_union_support,
        f"""WITH {EDGES}, x AS (SELECT DISTINCT s_nationkey AS target_entity, c_nationkey AS source_entity, target FROM edges JOIN customer ON c_custkey = source JOIN supplier ON s_suppkey = target WHERE s_nationkey <> c_nationkey),
        n AS (SELECT s_nationkey AS target_entity, count(*) AS channels FROM supplier GROUP BY 1),
        g AS (SELECT target_entity, count(DISTINCT source_entity) AS support FROM x GROUP BY 1)
        SELECT n.target_entity, coalesce(support, 0)::BIGINT AS support, channels, dense_rank() OVER (ORDER BY coalesce(support, 0) DESC)::BIGINT AS dense_rank FROM n LEFT JOIN g USING (target_entity)""",
    ),
    (
        "support_shares",
        support_shares,
        f"""WITH {EDGES}, t AS (SELECT count(DISTINCT source) AS n FROM edges) SELECT node, support, row_number() OVER (ORDER BY support DESC, lower(s_name), node)::BIGINT AS position, dense_rank() OVER (ORDER BY support DESC)::BIGINT AS dense_rank, support / t.n AS share FROM s JOIN supplier ON s_suppkey = node, t""",
    ),
    (
        "followers_of",
        followers_of,
        f"""WITH {EDGES} SELECT c_nationkey AS entity, c_custkey AS x_id FROM edges JOIN customer ON c_custkey = source WHERE target = 7
        QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END NULLS LAST, lower(c_name), c_custkey) = 1""",
    ),
    (
        "rank_comparison",
        rank_comparison,
        f"""WITH {EDGES}, a AS (SELECT node, row_number() OVER (ORDER BY support DESC, lower(s_name), node) AS rank FROM s JOIN supplier ON s_suppkey = node), b AS (SELECT s_suppkey AS node, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier)
        SELECT node, a.rank AS rank_a, b.rank AS rank_b, a.rank - b.rank AS gain FROM a JOIN b USING (node)""",
    ),
    (
        "support_pagerank",
        support_pagerank,
        f"""WITH RECURSIVE {EDGES}, g AS (SELECT DISTINCT source % (SELECT count(*) FROM supplier) AS a, target AS b FROM edges WHERE source % (SELECT count(*) FROM supplier) <> target), d AS (SELECT a, count(*) AS n FROM g GROUP BY 1),
        f AS (SELECT g.a, g.b, 1.0::DOUBLE / n AS x FROM g JOIN d USING (a) WHERE a IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_suppkey, 0.0 FROM supplier), w AS (SELECT s_suppkey AS node, s_suppkey / 15.0::DOUBLE AS w FROM supplier WHERE s_suppkey BETWEEN 1 AND 5),
        r(it, node, rank) AS (SELECT 0, node, w FROM w UNION ALL SELECT it + 1, node, 0.85::DOUBLE * got + coalesce(w, 0) * (1 - 0.85::DOUBLE * sum(got) OVER ()) FROM (SELECT it, b AS node, sum(rank * x) AS got FROM r JOIN f ON f.a = r.node WHERE it < 60 GROUP BY 1, 2) LEFT JOIN w USING (node))
        SELECT node, round(rank, 6) AS score FROM r WHERE it = 60""",
    ),
    (
        "insight_days",
        insight_days,
        """WITH r AS (SELECT ts::DATE::VARCHAR AS day, CASE event_type WHEN 'purchase' THEN 'surface' WHEN 'error' THEN NULL ELSE 'hold' END AS decision FROM events QUALIFY row_number() OVER (PARTITION BY ts::DATE, event_id % 23 ORDER BY ts DESC, event_id DESC) = 1)
        SELECT day, count(*) AS items, count(decision) AS decided, count(*) FILTER (decision = 'surface') AS surfaced FROM r GROUP BY 1""",
    ),
    (
        "canonical_runs",
        canonical_runs,
        """WITH r AS (SELECT ts::DATE AS day, event_id % 23 AS development, event_id % 5 AS rank, event_id AS run_id, ts, event_type FROM events),
        l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY day, development ORDER BY ts DESC, run_id DESC) = 1),
        c AS (SELECT day, development, rank FROM r WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY development ORDER BY day, rank) = 1)
        SELECT development, rank, run_id FROM l JOIN c USING (day, development, rank)""",
    ),
    (
        "result_faults",
        result_faults,
        r"""WITH r AS (SELECT doc_id AS result_id, 2 + doc_id % 25 AS n, doc_id % 3 = 0 AS s, doc_id % 4 AS c FROM documents),
        f AS (SELECT result_id, list_filter([CASE WHEN n > 18 THEN 'long_headline' END, CASE WHEN c = 3 THEN 'repeated_connection' END, CASE WHEN s AND c = 0 THEN 'surface_without_connection' END, CASE WHEN NOT s AND c > 0 THEN 'connection_without_surface' END], lambda x: x IS NOT NULL) AS f FROM r)
        SELECT result_id, array_to_string(f, ',') AS faults FROM f WHERE len(f) > 0""",
    ),
    (
        "final_faults",
        final_faults,
        """WITH c AS (SELECT l_orderkey AS k, l_suppkey AS s, l_linenumber AS b, count(*) AS n FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY ALL),
        p AS (SELECT k, bool_or(n > 1) AS twice, bool_or(s % 29 = 0 OR s % 10 = 7) AS unread, bool_or((s + b) % 13 = 0) AS unknown FROM c GROUP BY 1),
        r AS (SELECT o_orderkey AS id, o_orderkey % 3 = 0 AS up, o_orderkey % 37 = 0 AND o_orderkey % 31 <> 0 AND o_orderkey % 41 <> 0 OR o_orderkey % 31 = 0 AND o_orderkey % 37 <> 0 OR CASE WHEN o_orderkey % 37 <> 0 THEN 1 + o_orderkey % 25 ELSE 0 END + CASE WHEN o_orderkey % 31 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 41 = 0 THEN 1 ELSE 0 END > 18 AS head,
          o_orderkey % 4 = 0 AS told, o_orderkey % 4 IN (0, 1) OR o_orderkey % 43 = 0 AS given, o_orderkey % 4 > 1 AND o_orderkey % 43 = 0 AS link, o_orderkey % 41 = 0 AS cite FROM orders),
        f AS (SELECT id, list_filter([CASE WHEN head THEN 'bad_headline' END, CASE WHEN twice THEN 'repeated_bet' END, CASE WHEN unread THEN 'memo_not_opened' END, CASE WHEN unknown THEN 'unknown_bet' END, CASE WHEN up AND (twice IS NULL OR given) THEN 'surface_incomplete' END,
          CASE WHEN NOT up AND (twice IS NOT NULL OR NOT (told OR link)) THEN 'suppressed_incomplete' END, CASE WHEN link OR cite THEN 'link_in_prose' END], lambda x: x IS NOT NULL) AS f FROM r LEFT JOIN p ON k = id)
        SELECT id AS result_id, array_to_string(f, ',') AS faults FROM f WHERE len(f) > 0""",
    ),
    (
        "audit_violations",
        audit_violations,
        """WITH v AS (SELECT 'repeated_line' AS code, l_orderkey::VARCHAR AS key FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
        UNION ALL SELECT 'order_without_lines', o_orderkey::VARCHAR FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
        UNION ALL SELECT 'line_without_order', l_orderkey::VARCHAR FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
        SELECT code, max(n) AS n, string_agg(key, ',' ORDER BY key) FILTER (k <= 3) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY key) AS k, count(*) OVER (PARTITION BY code) AS n FROM v) GROUP BY 1""",
    ),
    (
        "page_credits",
        page_credits,
        """WITH c AS (SELECT o_custkey, count(*) * 17 % 260 AS n FROM orders GROUP BY 1), m AS (SELECT o_custkey, n, n * 3 AS p, (n * 3) % 200 AS q FROM c)
        SELECT o_custkey, (CASE WHEN n <= 0 THEN 0 WHEN n >= 200 THEN n WHEN n >= 100 THEN 2 * n ELSE greatest(60, 3 * n) END)::BIGINT AS credits, (p // 200 * 200 + CASE WHEN q <= 0 THEN 0 WHEN q >= 100 THEN 2 * q ELSE greatest(60, 3 * q) END)::BIGINT AS projected FROM m""",
    ),
    (
        "content_ids",
        content_ids,
        """SELECT doc_id, sha256('["x","' || source || '","' || lang || '"]') AS content_id, 'doc-' || trim(regexp_replace(lower(source || ' & ' || lang), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents""",
    ),
    (
        "merged_entities",
        merged_entities,
        """WITH c AS (SELECT c_custkey AS k, max(c_custkey) OVER (PARTITION BY c_custkey // 40, c_custkey % 5) AS top, count(*) OVER (PARTITION BY c_custkey // 40, c_custkey % 5) AS n FROM customer),
        o AS (SELECT top, count(*) AS channels FROM orders JOIN c ON k = o_custkey GROUP BY 1)
        SELECT k AS entity_id, CASE WHEN n > 1 THEN 'new' ELSE 'old' END AS updated_at, coalesce(channels, 0) AS channels, CASE WHEN n > 1 AND (k - 5) % 2 = 0 THEN 's' || (k - 5) ELSE '' END AS removed_slug FROM c LEFT JOIN o USING (top) WHERE k = c.top""",
    ),
    (
        "merge_faults",
        merge_faults,
        """WITH s AS (SELECT s_suppkey AS n FROM supplier), m AS (SELECT CASE n % 6 WHEN 0 THEN n WHEN 1 THEN -n ELSE n + 1 END AS c, CASE WHEN n % 6 = 2 THEN n + 1000000 ELSE n END AS d, n % 6 = 3 AS part FROM s),
        a AS (SELECT * FROM m UNION ALL SELECT c + 1, d, part FROM m WHERE d % 6 = 4),
        f AS (SELECT d, 'same_entity' AS fault FROM a WHERE c = d UNION SELECT d, 'unknown_canonical' FROM a WHERE c NOT IN (SELECT n FROM s) UNION SELECT d, 'unknown_duplicate' FROM a WHERE d NOT IN (SELECT n FROM s)
          UNION SELECT d, 'other_kind' FROM a WHERE c IN (SELECT n FROM s) AND d IN (SELECT n FROM s) AND c // 5 <> d // 5 UNION SELECT d, 'several_canonicals' FROM a GROUP BY d HAVING count(DISTINCT c) > 1 UNION SELECT d, 'partial_audit' FROM a WHERE part)
        SELECT fault, count(*) AS n, min(d) AS first FROM f GROUP BY 1""",
    ),
]
