"""Queries over upkeep: paged responses, cascades, consolidation, convergence of tables, views kept by day, reads held to a list."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import urls
from tessera.operators import convergence, pruning, views
from tessera.plans import adapters as ad
from tessera.plans.captures import ORDER_PAGES, _order_pages
from tessera.session import Scratch, shuffled
from tessera.sources import allowed, pager


def paged_responses(spark, sf_dir):
    """Orders of a customer as recorded responses: some are asked for twice, some fail for good, and each third chain points to what was not recorded."""
    p = _order_pages(spark, sf_dir)
    key = F.substring("body", 2, 20).cast("long")
    text = F.concat(F.lit('{"tweets":[{"id":"'), "body", F.lit('"},{}],"has_next_page":'), F.col("has_next").cast("string"), F.lit(',"next_cursor":"'), "next_cursor", F.lit('"}'))
    p = p.select("source", "cursor", key.alias("k"), text.alias("body"))
    first = F.when(F.col("k") % 13 == 0, 404).when(F.col("k") % 5 == 0, 429).otherwise(200)
    tries = p.withColumn("attempt", F.explode(F.when(first == 429, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    tries = tries.withColumn("status", F.when(F.col("attempt") == 1, first).otherwise(200))
    tries = tries.select("source", "cursor", "attempt", "status", F.when((F.col("status") == 429) & (F.col("k") % 2 == 0), "7.5").alias("retry_after"), F.when(F.col("status") == 200, F.col("body")).alias("body"))
    path = Scratch(spark).path("recorded")
    pager.record(tries, path, "2024-01-01")
    spark.dataSource.register(pager.RecordedPages)
    read = spark.read.format("recorded_pages").option("path", path).load()
    return read.select(F.col("source").cast("long").alias("source"), "place", "cursor", F.coalesce("items", F.lit(0).cast("long")).alias("items"), F.col("attempts").cast("long").alias("attempts"), "waited", F.coalesce("fault", F.lit("")).alias("fault"))


PAGED = f"""WITH {ORDER_PAGES}, p AS (SELECT source, k, n, substr(body, 2)::BIGINT AS o FROM pg), m AS (SELECT *, coalesce(min(CASE WHEN o % 13 = 0 THEN k END) OVER (PARTITION BY source), n + 1) AS stop FROM p)
SELECT source, k AS place, CASE WHEN k = 1 THEN '' ELSE 'c' || k END AS cursor, (CASE WHEN o % 13 = 0 THEN 0 ELSE 2 END)::BIGINT AS items, (CASE WHEN o % 13 <> 0 AND o % 5 = 0 THEN 2 ELSE 1 END)::BIGINT AS attempts,
  (CASE WHEN o % 13 = 0 OR o % 5 <> 0 THEN 0.0 WHEN o % 2 = 0 THEN 7.5 ELSE 1.0 END)::DOUBLE AS waited, CASE WHEN o % 13 = 0 THEN 'provider_http' ELSE '' END AS fault FROM m WHERE k <= stop
UNION ALL SELECT source, n + 1, 'c' || (n + 1), 0, 0, 0.0::DOUBLE, 'not_recorded' FROM m WHERE k = n AND source % 3 = 0 AND stop > n"""


def cascaded_nodes(spark, sf_dir):
    """Customers go, with them their orders, the parts that only those ordered, and the kinds of which no part is left."""
    named = lambda x, c: F.concat(F.lit(x), F.col(c).cast("string"))
    o = ad.table(spark, sf_dir, "orders").select(named("c", "o_custkey").alias("holder"), named("o", "o_orderkey").alias("node"))
    l = ad.table(spark, sf_dir, "lineitem").select(named("o", "l_orderkey").alias("holder"), named("p", "l_partkey").alias("node"))
    p = ad.table(spark, sf_dir, "part").select(named("p", "p_partkey").alias("holder"), F.concat_ws("/", F.lit("k"), "p_brand", "p_size").alias("node"))
    holds = o.union(l).union(p)
    gone = ad.table(spark, sf_dir, "customer").where("c_acctbal < 9000").select(named("c", "c_custkey").alias("node"))
    return pruning.cascade(spark, holds, gone, holds.select("node"))


# What stays is what something that stays holds, so it is found from what nobody holds; all holders here form layers.
CASCADED = """WITH RECURSIVE h AS (SELECT DISTINCT * FROM (SELECT 'c' || o_custkey AS holder, 'o' || o_orderkey AS node, 1 AS round FROM orders UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, 2 FROM lineitem UNION ALL SELECT 'p' || p_partkey, concat_ws('/', 'k', p_brand, p_size), 3 FROM part)),
gone AS (SELECT 'c' || c_custkey AS node FROM customer WHERE c_acctbal < 9000),
stay(node) AS (SELECT DISTINCT holder FROM h WHERE holder NOT IN (SELECT node FROM h) AND holder NOT IN (SELECT node FROM gone) UNION SELECT h.node FROM stay JOIN h ON h.holder = stay.node)
SELECT node, 0 AS round FROM gone UNION ALL SELECT DISTINCT node, round FROM h WHERE node NOT IN (SELECT node FROM stay)"""

ORG = 10**9


def consolidated_claims(spark, sf_dir):
    """Suppliers as companies, customers as speakers: what goes, and what is left of each table."""
    s = ad.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("n"))
    o = ad.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderdate").alias("observed_at"))
    org = F.lit(ORG) + 1 + F.col("k") % 97
    company = s.select((F.col("n") + ORG).alias("fact_id"), (F.col("n") + ORG).alias("entity_id"), F.lit("conference_company").alias("fact"), F.when(F.col("n") % 7 != 3, "aie-2024").otherwise("web").alias("source"), F.lit("2024-01-01").cast("timestamp_ntz").alias("observed_at"))
    roles = o.select(F.col("k").alias("fact_id"), F.col("c").alias("entity_id"), F.when(F.col("k") % 6 == 0, "company_x_candidate").when(F.col("k") % 6 == 1, "bio").otherwise("role").alias("fact"), F.when(F.col("k") % 11 == 0, "web").otherwise("aie-2023").alias("source"), "observed_at")
    affiliations = o.select(F.col("k").alias("affiliation_id"), F.col("c").alias("person_id"), org.alias("organisation_id"), F.when((F.col("k") % 97) % 3 == 0, "web").otherwise("aie-2023").alias("source"), "observed_at")
    links = s.where("n % 5 <> 0").select((F.col("n") + ORG).alias("entity_id"), F.floor(F.col("n") / 2).alias("channel_id"), F.when(F.col("n") % 4 != 0, "https://www.ai.engineer/e").otherwise("https://e.example").alias("evidence_url"), F.when(F.col("n") % 8 == 0, "Official company link in AI Engineer 2024").alias("notes"))
    channels = s.select(F.floor(F.col("n") / 2).alias("channel_id")).distinct().withColumn("kind", F.when(F.col("channel_id") % 4 == 0, "x").otherwise("website"))
    entities = s.select((F.col("n") + ORG).alias("entity_id"), F.when(F.col("n") % 9 == 0, "person").otherwise("organization").alias("kind")).union(ad.table(spark, sf_dir, "customer").select("c_custkey", F.lit("person")))
    others = s.where("n % 10 = 0").select((F.col("n") + ORG).alias("entity_id"))
    out = pruning.consolidate({"facts": company.union(roles), "affiliations": affiliations, "links": links, "channels": channels, "entities": entities}, others)
    rows = out["removed"]
    for name, key in (("facts", "fact_id"), ("affiliations", "affiliation_id"), ("links", "entity_id"), ("channels", "channel_id"), ("entities", "entity_id")):
        rows = rows.unionByName(out[name].agg(F.coalesce(F.sum(key), F.lit(0)).cast("long").alias("n")).select(F.lit(f"left in {name}").alias("what"), "n"))
    return rows


CONSOLIDATED = f"""WITH s AS (SELECT s_suppkey AS n, {ORG} + s_suppkey AS e FROM supplier), o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS t FROM orders),
f0 AS (SELECT e AS id, e, 'conference_company' AS fact, n % 7 <> 3 AS own, TIMESTAMP '2024-01-01' AS t FROM s UNION ALL SELECT k, c, CASE k % 6 WHEN 0 THEN 'company_x_candidate' WHEN 1 THEN 'bio' ELSE 'role' END, k % 11 <> 0, t FROM o),
f1 AS (SELECT * FROM f0 WHERE NOT (own AND fact = 'company_x_candidate') QUALIFY NOT own OR row_number() OVER (PARTITION BY e, fact, own ORDER BY t DESC, id DESC) = 1),
a0 AS (SELECT k AS id, c AS p, {ORG} + 1 + k % 97 AS g, (k % 97) % 3 <> 0 AS own, t FROM o),
a1 AS (SELECT * FROM a0 QUALIFY NOT own OR row_number() OVER (PARTITION BY p, own ORDER BY t DESC, id DESC) = 1),
l0 AS (SELECT e, n // 2 AS ch, n % 4 <> 0 OR n % 8 = 0 AS said FROM s WHERE n % 5 <> 0), ch AS (SELECT DISTINCT n // 2 AS ch FROM s),
bare AS (SELECT DISTINCT e FROM f1 WHERE own AND fact = 'conference_company' AND e NOT IN (SELECT e FROM l0)),
a2 AS (SELECT * FROM a1 WHERE NOT (own AND g IN (SELECT e FROM bare))), f2 AS (SELECT * FROM f1 WHERE NOT (own AND fact = 'conference_company' AND e IN (SELECT e FROM bare))),
orphan AS (SELECT DISTINCT e FROM f2 WHERE own AND fact = 'conference_company' AND e NOT IN (SELECT g FROM a2 WHERE own)),
f3 AS (SELECT * FROM f2 WHERE NOT (own AND fact = 'conference_company' AND e IN (SELECT e FROM orphan))),
cut AS (SELECT * FROM l0 WHERE said AND ch % 4 <> 0 AND e IN (SELECT e FROM orphan)), l1 AS (SELECT * FROM l0 WHERE NOT (said AND ch % 4 <> 0 AND e IN (SELECT e FROM orphan))),
loose AS (SELECT DISTINCT ch FROM cut WHERE ch NOT IN (SELECT ch FROM l1)),
held AS (SELECT e FROM f3 UNION SELECT g FROM a2 UNION SELECT p FROM a2 UNION SELECT e FROM l1 UNION SELECT e FROM s WHERE n % 10 = 0),
spare AS (SELECT e FROM s WHERE n % 9 <> 0 AND (e IN (SELECT e FROM bare) OR e IN (SELECT e FROM orphan)) AND e NOT IN (SELECT e FROM held)),
ent AS (SELECT e FROM s UNION ALL SELECT c_custkey FROM customer)
SELECT 'facts' AS what, (SELECT count(*) FROM f0) - (SELECT count(*) FROM f3) AS n UNION ALL SELECT 'affiliations', (SELECT count(*) FROM a0) - (SELECT count(*) FROM a2) UNION ALL SELECT 'unresolved_affiliations', (SELECT count(*) FROM a1) - (SELECT count(*) FROM a2)
UNION ALL SELECT 'unresolved_organisations', count(*) FROM spare WHERE e IN (SELECT e FROM bare) UNION ALL SELECT 'orphan_organisations', count(*) FROM spare WHERE e IN (SELECT e FROM orphan)
UNION ALL SELECT 'website_links', count(*) FROM cut UNION ALL SELECT 'channels', count(*) FROM loose
UNION ALL SELECT 'left in facts', coalesce(sum(id), 0)::BIGINT FROM f3 UNION ALL SELECT 'left in affiliations', coalesce(sum(id), 0)::BIGINT FROM a2 UNION ALL SELECT 'left in links', coalesce(sum(e), 0)::BIGINT FROM l1
UNION ALL SELECT 'left in channels', coalesce(sum(ch), 0)::BIGINT FROM ch WHERE ch NOT IN (SELECT ch FROM loose) UNION ALL SELECT 'left in entities', coalesce(sum(e), 0)::BIGINT FROM ent WHERE e NOT IN (SELECT e FROM spare)"""


def converged_tables(spark, sf_dir):
    """Parts as artifacts: of twelve, the third leads to the sixth and that to the ninth, the first to a new address of a block of 24, and the tenth to another name of itself."""
    k = F.col("p_partkey")
    at = lambda n: F.concat(F.lit("https://h.example/p/"), n.cast("string"))
    p = ad.table(spark, sf_dir, "part")
    art = p.select(urls.artifact_id(at(k)).alias("artifact_id"), at(k).alias("canonical_url"), F.lit("h.example").alias("host"), F.col("p_type").alias("title"), F.lpad(k.cast("string"), 8, "0").alias("first_seen_at"), F.lit("5").alias("last_seen_at"), F.lit("5").alias("updated_at"))
    alias = p.select(F.concat(F.lit("http://t.example/"), k.cast("string")).alias("alias_url"), urls.artifact_id(at(k)).alias("artifact_id"), F.lit("seen").alias("alias_kind"), F.lit("1").alias("first_seen_at"), F.lit("1").alias("last_seen_at"))
    final = F.when((k % 12).isin(3, 6), at(k + 3)).when(k % 12 == 1, F.concat(F.lit("https://new.example/b/"), F.floor(k / 24).cast("string"))).when(k % 12 == 10, F.concat(at(k), F.lit("#top")))
    redirects = p.select(urls.artifact_id(at(k)).alias("source_id"), final.alias("final_url"), F.when(k % 24 < 12, "6").otherwise("7").alias("seen_at")).where("final_url is not null")
    l = ad.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    item = l.distinct().select(F.col("l_suppkey").alias("fetch_run_id"), urls.artifact_id(at(F.col("l_partkey"))).alias("artifact_id"))
    seen = l.select(urls.artifact_id(at(F.col("l_partkey"))).alias("artifact_id"))
    out = convergence.converge_tables({"artifact": art, "alias": alias, "item": item, "observation": seen}, redirects)
    rows = out["artifact"].select("artifact_id", "canonical_url", "host", "first_seen_at", "last_seen_at")
    for name in ("alias", "item", "observation"):
        rows = rows.join(shuffled(out[name].groupBy("artifact_id").agg(F.count("*").alias(name))), "artifact_id", "left")
    return rows.drop("artifact_id").fillna(0, ["alias", "item", "observation"])


CONVERGED = """WITH p AS (SELECT p_partkey AS k, (SELECT max(p_partkey) FROM part) AS top FROM part),
m AS (SELECT k, CASE WHEN k % 12 IN (3, 6) THEN 'https://h.example/p/' || CASE WHEN k % 12 = 3 AND k + 3 > top THEN k + 3 ELSE k + 9 - k % 12 END WHEN k % 12 = 1 THEN 'https://new.example/b/' || (k // 24) ELSE 'https://h.example/p/' || k END AS url FROM p),
b AS (SELECT url, CASE WHEN url LIKE '%new%' THEN min(k) ELSE max(k) END AS k FROM m GROUP BY 1),
a AS (SELECT url AS canonical_url, split_part(url, '/', 3) AS host, lpad(k::VARCHAR, 8, '0') AS first_seen_at, CASE WHEN url LIKE '%/p/' || k THEN '5' WHEN k % 24 < 12 THEN '6' ELSE '7' END AS last_seen_at FROM b),
al AS (SELECT url, 'http://t.example/' || k AS x FROM m UNION SELECT url, 'https://h.example/p/' || k FROM m WHERE k % 12 IN (1, 3, 6) UNION SELECT url, url FROM m WHERE k % 12 IN (1, 6) UNION SELECT url, 'https://h.example/p/' || (k + 3) FROM m WHERE k % 12 = 3 UNION SELECT url, url || '#top' FROM m WHERE k % 12 = 10),
i AS (SELECT url, count(DISTINCT l_suppkey) AS n, count(*) AS o FROM lineitem JOIN m ON k = l_partkey GROUP BY 1)
SELECT a.*, (SELECT count(*) FROM al WHERE al.url = a.canonical_url) AS alias, coalesce(i.n, 0) AS item, coalesce(i.o, 0) AS observation FROM a LEFT JOIN i ON i.url = a.canonical_url"""


def _two_days(events):
    """Events of a day and of the one before."""
    day = events.select(F.col("day"), "event_id").union(events.select(F.date_add("day", 1), "event_id"))
    return day.groupBy("day").agg(F.count("*").alias("n"), F.sum("event_id").cast("long").alias("total"))


def kept_days(spark, sf_dir):
    """A view that is kept, then refreshed after a day of events changed and the last day came: which days were computed again."""
    e = ad.table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_id")
    last = e.agg(F.max("day")).first()[0]
    root, code = Scratch(spark).path("view"), views.code_digest(_two_days, "1")
    before = e.where(F.col("day") < F.lit(last)).withColumn("event_id", F.when(F.col("day") == "2024-01-05", F.col("event_id") + 1).otherwise(F.col("event_id")))
    views.refreshed(root, {"events": before}, _two_days, code, back=1)
    view, again = views.refreshed(root, {"events": e}, _two_days, code, back=1)
    return view.select(F.col("day").cast("string").alias("day"), "n", "total", F.col("day").cast("string").isin(again).alias("computed"))


KEPT = """WITH d AS (SELECT ts::DATE AS day, event_id FROM events), u AS (SELECT day, event_id FROM d UNION ALL SELECT day + 1, event_id FROM d)
SELECT day::VARCHAR AS day, count(*) AS n, sum(event_id)::BIGINT AS total, day IN (DATE '2024-01-05', DATE '2024-01-06', (SELECT max(day) FROM d)) AS computed FROM u WHERE day IN (SELECT day FROM d) GROUP BY u.day"""


def allowed_reads(spark, sf_dir):
    """Suppliers by nation from a session that knows two tables, and how many of some statements it refuses."""
    known = allowed.Allowed(spark, {t: f"{sf_dir}/{t}.parquet" for t in ("supplier", "nation", "customer")}, ["supplier", "nation"])
    refused = 0
    for s in (
        "SELECT * FROM customer",
        "SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)",
        f"SELECT * FROM parquet.`{sf_dir}/customer.parquet`",
        "CREATE OR REPLACE TEMP VIEW customer AS SELECT * FROM nation",
        "SHOW TABLES",
    ):
        try:
            known.sql(s)
        except allowed.ReadRefused:
            refused += 1
    rows = known.sql("WITH s AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) SELECT n_name, n FROM nation JOIN s ON n_nationkey = s_nationkey WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)")
    return rows.select("n_name", "n", F.lit(refused).cast("long").alias("refused"))


QUERIES = [
    ("paged_responses", paged_responses, PAGED),
    ("cascaded_nodes", cascaded_nodes, CASCADED),
    ("consolidated_claims", consolidated_claims, CONSOLIDATED),
    ("converged_tables", converged_tables, CONVERGED),
    ("kept_days", kept_days, KEPT),
    ("allowed_reads", allowed_reads, "SELECT n_name, count(*) AS n, 5::BIGINT AS refused FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1"),
]
