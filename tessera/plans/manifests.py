"""Queries over reviewed manifests: suppliers as parent organisations, each with a website and fifteen customers as its accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import manifests
from tessera.plans import adapters as ad

ORG = 10**9


def _tables(spark, sf_dir):
    s = ad.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("n"), F.col("s_name").alias("own_name"))
    c = ad.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), "c_name", F.floor("c_acctbal").alias("followers"), F.col("c_mktsegment").alias("segment"), F.floor((F.col("c_custkey") + 14) / 15).alias("n"))
    return s, c


def _registry(s, c, faulty):
    """Every fifth customer has no channel yet and every third supplier no entity."""
    text = lambda x, k: F.concat(F.lit(x), F.col(k).cast("string"))
    odd = lambda k, col: (F.col(col) % 31 == k) if faulty else F.lit(False)
    none, old = F.lit(None).cast("string"), F.lit("old")
    person = lambda k, col: F.when(odd(k, col), "person").otherwise("organization")
    known, had = s.where("n % 3 <> 0"), c.where("c % 5 <> 0")
    entities = c.select(F.col("c").alias("entity_id"), person(13, "c").alias("kind"), text("c", "c").alias("slug"), F.col("c_name").alias("name"), odd(14, "c").alias("rejected"), none.alias("notes"), old.alias("updated_at"))
    entities = entities.unionByName(known.select((F.col("n") + ORG).alias("entity_id"), person(8, "n").alias("kind"), text("s", "n").alias("slug"), F.col("own_name").alias("name"), odd(10, "n").alias("rejected"), none.alias("notes"), old.alias("updated_at")))
    site = known.select((F.col("n") + ORG).alias("id"), F.lit("website").alias("kind"), text("https://w.example/", "n").alias("key"))
    own = had.select(F.col("c").alias("id"), F.lit("x").alias("kind"), text("h", "c").alias("key")).unionByName(site)
    channels = own.select(F.col("id").alias("channel_id"), "kind", "key", none.alias("label"), F.lit("1").alias("last_seen_at"))
    owners = own.select(F.col("id").alias("entity_id"), F.col("id").alias("channel_id"), F.lit("identity").alias("relationship"), F.lit(0.5).alias("confidence"), none.alias("evidence_url"), none.alias("notes"))
    accounts = had.select(text("h", "c").alias("handle"), F.when(odd(9, "c"), "q").otherwise(F.col("c").cast("string")).alias("x_id"), none.alias("display_name"), none.alias("bio"), F.lit(None).cast("long").alias("followers"), F.lit("1").alias("first_seen_at"), F.lit("1").alias("last_seen_at"))
    if faulty:
        accounts = accounts.unionByName(had.where("c % 31 = 10").select(text("z", "c").alias("handle"), F.col("c").cast("string").alias("x_id")), allowMissingColumns=True)
    spark = s.sparkSession
    return {
        "entities": entities,
        "channels": channels,
        "owners": owners,
        "accounts": accounts,
        "facts": spark.createDataFrame([], "handle string, source string, fact string, value string, observed_at string, evidence_url string"),
        "observations": spark.createDataFrame([], "channel_id long, source string, metric string, value string, observed_at string, evidence_url string"),
        "labs": s.where("n % 7 = 0" if not faulty else "n % 14 = 0").select(text("l", "n").alias("slug"), F.lit("lab").alias("name"), none.alias("notes")),
    }


def _snapshot(c, faulty):
    name = F.concat(F.lit("H"), F.col("c").cast("string"))
    a = c.select(F.col("c").alias("x_id"), name.alias("handle"), F.col("c_name").alias("display_name"), F.when(F.col("c") % 4 != 0, F.col("segment")).alias("bio"), "followers", F.lit("0").alias("first_observed_at"), F.lit("2").alias("last_observed_at"))
    return a.where("x_id % 31 <> 7") if faulty else a


def _manifest(s, c, faulty):
    """Sound, or with a fault of each kind in some of each 31 rows."""
    text = lambda x, k: F.concat(F.lit(x), k.cast("string"))
    odd = lambda k, col, other, sound: F.when(F.col(col) % 31 == k, other).otherwise(sound) if faulty else sound
    n, k = F.col("n"), F.col("c")
    none, https = F.lit(None).cast("string"), F.lit("https://e.example")
    slug = odd(1, "n", text("S bad", n), odd(7, "n", F.lit("dup"), text("s", n)))
    lab = F.when(n % 7 == 0, text("l", n))
    orgs = s.select(n.alias("pos"), slug.alias("slug"), odd(2, "n", F.lit(" \t"), odd(9, "n", F.lit("Other"), F.col("own_name"))).alias("name"), odd(3, "n", none, F.lit("owned")).alias("reason"), odd(4, "n", F.lit("http://e.example"), https).alias("evidence_url"), odd(6, "n", slug, lab).alias("lab_slug"))
    held = c.join(orgs.select(F.col("pos").alias("n"), "slug"), "n")
    listed = held.select(n.alias("pos"), k.alias("place"), "slug", odd(1, "c", F.lit("irc"), F.lit("x")).alias("kind"), odd(2, "c", F.lit(" "), odd(6, "c", text("@H", k + 1), text("@H", k))).alias("key"), odd(3, "c", F.lit("fan"), F.lit("official")).alias("relationship"), odd(4, "c", none, https).alias("evidence_url"), odd(5, "c", F.lit(""), odd(8, "c", F.lit("no"), k.cast("string"))).alias("expected_x_id"), none.alias("label"))
    other = lambda kind, key, rows=orgs: rows.select("pos", F.lit(0).alias("place"), "slug", F.lit(kind).alias("kind"), key.alias("key"), F.lit("identity").alias("relationship"), https.alias("evidence_url"), none.alias("expected_x_id"), F.lit("L").alias("label"))
    site = F.concat(F.when(F.col("pos") % 31 == 3, "http").otherwise("https") if faulty else F.lit("https"), text("://w.example/", F.col("pos")))
    listed = listed.unionByName(other("website", site)).unionByName(other("github", text("@Gh", F.col("pos")), orgs.where("pos % 2 = 0")))
    merges = held.where("c % 5 <> 0").select(n.alias("pos"), k.alias("place"), "slug", text("@H", k).alias("handle"), odd(11, "c", none, F.col("c_name")).alias("expected_name"))
    if faulty:
        listed = listed.unionByName(other("website", text("https://w.example/", F.col("pos") + 1), orgs.where("pos % 31 = 9")))
        merges = merges.where("place % 31 <> 15").unionByName(merges.where("place % 31 = 12"))
        listed, merges = listed.where("pos % 31 <> 5"), merges.where("pos % 31 <> 5")
    head = s.sparkSession.createDataFrame([(manifests.COVERAGE_VERSION, "s1", "c", "d")], "schema_version string, snapshot_id string, cohort_sha256 string, database_sha256 string")
    return {"head": head, "organisations": orgs, "listed": listed, "merges": merges}


def coverage_faults(spark, sf_dir):
    """What is wrong with a manifest that has some of all faults."""
    s, c = _tables(spark, sf_dir)
    m = _manifest(s, c, True)
    return manifests.form_faults(m).unionByName(manifests.registry_faults(m, _registry(s, c, True), _snapshot(c, True))).distinct()


COVERAGE_FAULTS = f"""WITH s AS (SELECT s_suppkey AS n, s_suppkey % 31 AS r, s_name AS name FROM supplier), c AS (SELECT c_custkey AS c, c_custkey % 31 AS r, c_name AS name, (c_custkey + 14) // 15 AS n FROM customer),
o AS (SELECT n AS pos, r, CASE r WHEN 1 THEN 'S bad' || n WHEN 7 THEN 'dup' ELSE 's' || n END AS slug, CASE r WHEN 2 THEN ' ' WHEN 9 THEN 'Other' ELSE name END AS name, r = 6 AS self, n % 7 = 0 AND r <> 6 AS lab FROM s),
l AS (SELECT o.pos, o.slug, CASE c.r WHEN 1 THEN 'irc' ELSE 'x' END AS kind, CASE c.r WHEN 2 THEN '' WHEN 6 THEN 'h' || (c + 1) WHEN 1 THEN '@H' || c ELSE 'h' || c END AS key, c.r = 3 AS fan, c.r = 4 AS bare, CASE c.r WHEN 5 THEN '' WHEN 8 THEN 'no' ELSE c::VARCHAR END AS x FROM c JOIN o ON o.pos = c.n WHERE o.r <> 5
  UNION ALL SELECT pos, slug, 'website', CASE r WHEN 3 THEN 'http' ELSE 'https' END || '://w.example/' || pos, false, false, NULL FROM o WHERE r <> 5 UNION ALL SELECT pos, slug, 'website', 'https://w.example/' || (pos + 1), false, false, NULL FROM o WHERE r = 9 UNION ALL SELECT pos, slug, 'github', 'gh' || pos, false, false, NULL FROM o WHERE pos % 2 = 0 AND r <> 5),
m AS (SELECT o.pos, o.slug, c, 'h' || c AS handle, CASE c.r WHEN 11 THEN NULL ELSE c.name END AS name, c.name AS is_name, c.r FROM c JOIN o ON o.pos = c.n WHERE c % 5 <> 0 AND c.r <> 15 AND o.r <> 5),
e AS (SELECT {ORG} + n AS id, 's' || n AS slug, name, r = 8 AS person, r = 10 AS rejected FROM s WHERE n % 3 <> 0),
own AS (SELECT 'x' AS kind, 'h' || c AS key, c AS id, r = 14 AS rejected FROM c WHERE c % 5 <> 0 UNION ALL SELECT 'website', 'https://w.example/' || n, {ORG} + n, r = 10 FROM s WHERE n % 3 <> 0),
snap AS (SELECT 'h' || c AS key, c::VARCHAR AS x FROM c WHERE r <> 7), acc AS (SELECT 'h' || c AS key, CASE r WHEN 9 THEN 'q' ELSE c::VARCHAR END AS x FROM c WHERE c % 5 <> 0 UNION ALL SELECT 'z' || c, c::VARCHAR FROM c WHERE c % 5 <> 0 AND r = 10)
SELECT slug, '' AS item, 'bad_slug' AS fault FROM o WHERE r = 1 UNION SELECT slug, '', 'repeated_slug' FROM o GROUP BY 1 HAVING count(*) > 1 UNION SELECT slug, '', 'no_name' FROM o WHERE r = 2 UNION SELECT slug, '', 'no_reason' FROM o WHERE r = 3 UNION SELECT slug, '', 'no_https_evidence' FROM o WHERE r = 4
UNION SELECT slug, '', 'no_channels' FROM o WHERE r = 5 UNION SELECT slug, '', 'bad_lab_slug' FROM o WHERE self
UNION SELECT slug, kind || ':' || key, 'bad_kind' FROM l WHERE kind = 'irc' UNION SELECT slug, kind || ':' || key, 'no_key' FROM l WHERE key = '' UNION SELECT slug, kind || ':' || key, 'bad_relationship' FROM l WHERE fan UNION SELECT slug, kind || ':' || key, 'no_https_evidence' FROM l WHERE bare
UNION SELECT slug, kind || ':' || key, 'no_x_id' FROM l WHERE kind = 'x' AND x = '' UNION SELECT slug, kind || ':' || key, 'repeated_handle' FROM l WHERE kind = 'x' AND key IN (SELECT key FROM l WHERE kind = 'x' GROUP BY 1 HAVING count(*) > 1)
UNION SELECT slug, kind || ':' || key, 'key_not_https' FROM l WHERE kind = 'website' AND key LIKE 'http:%' UNION SELECT slug, kind || ':' || key, 'claimed_twice' FROM l WHERE kind = 'website' AND key IN (SELECT key FROM l GROUP BY 1 HAVING count(DISTINCT pos) > 1)
UNION SELECT slug, '@' || handle, 'not_a_channel' FROM m WHERE (pos, handle) NOT IN (SELECT pos, key FROM l WHERE kind = 'x') UNION SELECT slug, '@' || handle, 'repeated_merge' FROM m WHERE r = 12 UNION SELECT slug, '@' || handle, 'no_expected_name' FROM m WHERE r = 11
UNION SELECT o.slug, '', 'canonical_kind' FROM o JOIN e USING (slug) WHERE person UNION SELECT o.slug, '', 'canonical_name' FROM o JOIN e USING (slug) WHERE o.name <> e.name UNION SELECT o.slug, '', 'canonical_rejected' FROM o JOIN e USING (slug) WHERE rejected
UNION SELECT slug, '@' || handle, 'member_kind' FROM m WHERE r = 13 UNION SELECT slug, '@' || handle, 'member_name' FROM m WHERE r = 11 UNION SELECT slug, '@' || handle, 'member_rejected' FROM m WHERE r = 14
UNION SELECT slug, 'x:' || key, 'not_in_snapshot' FROM l WHERE kind = 'x' AND key NOT IN (SELECT key FROM snap) UNION SELECT slug, 'x:' || key, 'other_x_id' FROM l JOIN snap USING (key) WHERE kind = 'x' AND l.x <> snap.x
UNION SELECT slug, 'x:' || key, 'registry_x_id' FROM l JOIN snap USING (key) JOIN acc USING (key) WHERE kind = 'x' AND acc.x <> snap.x UNION SELECT slug, 'x:' || l.key, 'taken_x_id' FROM l JOIN snap USING (key) JOIN acc ON acc.x = snap.x AND acc.key <> l.key WHERE kind = 'x'
UNION SELECT slug, kind || ':' || key, 'owner_rejected' FROM l JOIN own USING (kind, key) WHERE rejected
UNION SELECT l.slug, kind || ':' || key, 'other_owner' FROM l JOIN own USING (kind, key) LEFT JOIN e ON e.slug = l.slug WHERE NOT own.rejected AND own.id IS DISTINCT FROM e.id AND (l.pos, own.id) NOT IN (SELECT pos, c FROM m)
UNION SELECT slug, '', 'lab_missing' FROM o WHERE lab AND pos % 14 <> 0 UNION SELECT slug, '', 'lab_missing' FROM o WHERE self"""


def covered_organisations(spark, sf_dir):
    """A sound manifest applied: each entity left with what it owns, rows about accounts, facts, labs, and the counts."""
    s, c = _tables(spark, sf_dir)
    out = manifests.apply_coverage(spark, _manifest(s, c, False), _registry(s, c, False), _snapshot(c, False), "new")
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    own = out["owners"].join(out["channels"], "channel_id").groupBy("entity_id").agg(F.count("*").alias("n"), F.count_if(F.col("relationship") == "official").alias("official"), F.count_if(F.col("last_seen_at") != "1").alias("seen"))
    rows = out["entities"].join(own, "entity_id", "left").select("slug", F.col("entity_id").cast("long").alias("key"), "updated_at", zero(F.col("n")).alias("n"), zero(F.col("official")).alias("official"), zero(F.col("seen")).alias("seen"))
    say = lambda df, what, n, updated=None: df.select(what.alias("slug"), F.lit(0).cast("long").alias("key"), F.lit("") if updated is None else updated, n.alias("n"), F.lit(0).cast("long").alias("official"), F.lit(0).cast("long").alias("seen")).toDF(*rows.columns)
    rows = rows.unionByName(say(out["counts"], F.concat(F.lit("count "), "what"), F.col("n")))
    about = out["accounts"].groupBy("first_seen_at", "last_seen_at").agg(zero(F.sum("followers")).alias("n"))
    rows = rows.unionByName(say(about, F.concat(F.lit("account "), "first_seen_at", "last_seen_at"), F.col("n")))
    rows = rows.unionByName(say(out["observations"].groupBy("metric").agg(F.count("*").alias("n")), F.concat(F.lit("observed "), "metric"), F.col("n")))
    rows = rows.unionByName(say(out["facts"].groupBy("value").agg(F.count("*").alias("n")), F.concat(F.lit("fact "), "value"), F.col("n")))
    rows = rows.unionByName(say(out["audit"].groupBy("canonical_id").agg(F.count("*").alias("n")), F.concat(F.lit("merged "), F.col("canonical_id").cast("string")), F.col("n")))
    return rows.unionByName(say(out["labs"], F.concat(F.lit("lab "), "slug"), F.lit(1).cast("long"), F.col("name")))


COVERED = f"""WITH s AS (SELECT s_suppkey AS n, s_name AS name, 's' || s_suppkey AS slug FROM supplier), c AS (SELECT c_custkey AS c, floor(c_acctbal)::BIGINT AS f, (c_custkey + 14) // 15 AS n FROM customer), h AS (SELECT * FROM c WHERE n IN (SELECT n FROM s)),
top AS (SELECT coalesce(max(CASE WHEN n % 3 <> 0 THEN {ORG} + n END), (SELECT max(c) FROM c)) AS t FROM s),
o AS (SELECT n, slug, name, n % 3 = 0 AS made, CASE WHEN n % 3 = 0 THEN (SELECT t FROM top) + row_number() OVER (PARTITION BY n % 3 = 0 ORDER BY slug) ELSE {ORG} + n END AS id FROM s),
k AS (SELECT n, count(*) AS n_x, count_if(c % 5 <> 0) AS merged FROM h GROUP BY 1)
SELECT slug, key, updated_at, n::BIGINT AS n, official, seen FROM (SELECT slug, id::BIGINT AS key, CASE WHEN made OR merged > 0 THEN 'new' ELSE 'old' END AS updated_at, coalesce(n_x, 0) + 1 + CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END AS n, coalesce(n_x, 0) AS official, coalesce(n_x, 0) + 1 + CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END AS seen FROM o LEFT JOIN k USING (n)
UNION ALL SELECT 'c' || c, c, 'old', CASE WHEN c % 5 <> 0 THEN 1 ELSE 0 END, 0, 0 FROM c WHERE c % 5 = 0 OR n NOT IN (SELECT n FROM s)
UNION ALL SELECT 'count organizations', 0, '', count(*), 0, 0 FROM s UNION ALL SELECT 'count created_entities', 0, '', count(*), 0, 0 FROM s WHERE n % 3 = 0 UNION ALL SELECT 'count merged_entities', 0, '', count(*), 0, 0 FROM h WHERE c % 5 <> 0
UNION ALL SELECT 'count imported_accounts', 0, '', count(*), 0, 0 FROM h WHERE c % 5 = 0 UNION ALL SELECT 'count linked_channels', 0, '', (SELECT count(*) FROM h) + count_if(n % 3 = 0) + count_if(n % 2 = 0), 0, 0 FROM s UNION ALL SELECT 'count already_grouped', 0, '', 0, 0, 0
UNION ALL SELECT 'account ' || t, 0, '', coalesce(sum(f), 0)::BIGINT, 0, 0 FROM (SELECT CASE WHEN n IN (SELECT n FROM s) THEN '02' ELSE '11' END AS t, CASE WHEN n IN (SELECT n FROM s) THEN f END AS f FROM c WHERE c % 5 <> 0 OR n IN (SELECT n FROM s)) GROUP BY t
UNION ALL SELECT 'observed followers_count', 0, '', count(f), 0, 0 FROM h HAVING count(f) > 0 UNION ALL SELECT 'observed bio', 0, '', count(*), 0, 0 FROM h WHERE c % 4 <> 0 HAVING count(*) > 0
UNION ALL SELECT 'fact s' || n, 0, '', n_x, 0, 0 FROM k UNION ALL SELECT 'merged ' || id, 0, '', merged, 0, 0 FROM o JOIN k USING (n) WHERE merged > 0 UNION ALL SELECT 'lab s' || n, 0, name, 1, 0, 0 FROM s WHERE n % 7 = 0)"""


def _removals(s, c, faulty):
    """Every customer that is divisible by 7; some have a fault, and some were removed before."""
    k = F.col("c")
    odd = lambda r, other, sound: F.when(k % 23 == r, other).otherwise(sound) if faulty else sound
    none = F.lit(None).cast("string")
    known = c if faulty else c.where("c % 7 = 0 and c % 5 <> 0 and c % 11 <> 0")
    r = known.select(k.alias("entity_id"), odd(1, F.lit("Other"), odd(2, F.lit(" "), F.col("c_name"))).alias("name"), odd(3, F.lit("firm"), odd(4, F.lit("unknown"), F.lit("organization"))).alias("kind"), odd(5, F.lit("keep"), odd(6, F.lit("review"), F.lit("remove"))).alias("model_decision"), odd(6, F.lit("manual_add_from_review"), F.lit("model_remove")).alias("review_basis"), odd(7, none, F.lit("off topic")).alias("reason"))
    return r.unionByName(r.withColumn("entity_id", F.col("entity_id") + 2 * ORG).where("entity_id % 2 = 0")).unionByName(r.where("entity_id % 23 = 8") if faulty else r.limit(0))


def _around(spark, sf_dir, c):
    """Merges, follow edges and labs that name some customers: edges are orders of a dear kind between customers."""
    name = lambda k: F.concat(F.lit("H"), k.cast("string"))
    o = ad.table(spark, sf_dir, "orders").where("o_custkey % 11 = 0").select(name(F.col("o_custkey")).alias("source"), F.lit("out").alias("target"))
    return c.where("c % 23 = 9").select(F.col("c").alias("canonical_id")), o, c.where("c % 23 = 10").select(name(F.col("c")).alias("handle"))


def removal_faults(spark, sf_dir):
    s, c = _tables(spark, sf_dir)
    merged, edges, labs = _around(spark, sf_dir, c)
    return manifests.removal_faults(_removals(s, c, True), _registry(s, c, True), merged, edges, labs)


REMOVAL_FAULTS = f"""WITH c AS (SELECT c_custkey AS c, c_custkey % 23 AS r, c_custkey % 5 <> 0 AS had, (c_custkey % 11 = 0 AND c_custkey IN (SELECT o_custkey FROM orders)) AS edge FROM customer),
f AS (SELECT c, r, true AS known, had, edge FROM c UNION ALL SELECT c + 2 * {ORG}, r, false, had, edge FROM c WHERE c % 2 = 0)
SELECT c AS entity_id, 'repeated_entity' AS fault FROM c WHERE r = 8
UNION SELECT c, 'bad_kind' FROM f WHERE r = 3 UNION SELECT c, 'bad_review' FROM f WHERE r = 5 UNION SELECT c, 'no_name_or_reason' FROM f WHERE r IN (2, 7)
UNION SELECT c, 'other_identity' FROM f WHERE known AND (r IN (1, 2, 3) OR (r = 4 OR c % 31 = 13)) UNION SELECT c, 'rejected' FROM f WHERE known AND c % 31 = 14 UNION SELECT c, 'merge_canonical' FROM f WHERE known AND r = 9
UNION SELECT c, 'not_one_handle' FROM f WHERE known AND NOT had UNION SELECT c, 'in_graph' FROM f WHERE known AND had AND edge UNION SELECT c, 'seeded_lab' FROM f WHERE known AND had AND r = 10"""


def removed_entities(spark, sf_dir):
    """What is left of each table after sound removals, and the counts."""
    s, c = _tables(spark, sf_dir)
    registry = _registry(s, c, False)
    registry["facts"] = registry["accounts"].select("handle", F.lit("s").alias("source"), F.lit("bio").alias("fact"), F.lit("v").alias("value"))
    merged, edges, _ = _around(spark, sf_dir, c)
    out = manifests.apply_removals(_removals(s, c, False), registry, merged.where("canonical_id % 7 <> 0"), edges)
    rows = out["counts"].select("what", "n", F.lit(0).cast("long").alias("total"))
    ids = {"entities": F.col("entity_id"), "channels": F.col("channel_id"), "owners": F.col("entity_id"), "accounts": F.expr("substr(handle, 2)").cast("long"), "facts": F.expr("substr(handle, 2)").cast("long")}
    for name, key in ids.items():
        rows = rows.unionByName(out[name].agg(F.count("*").alias("n"), F.coalesce(F.sum(key), F.lit(0)).cast("long").alias("total")).select(F.lit(f"left in {name}").alias("what"), "n", "total"))
    return rows


REMOVED = f"""WITH c AS (SELECT c_custkey AS c, c_custkey % 7 = 0 AND c_custkey % 5 <> 0 AND c_custkey % 11 <> 0 AS gone FROM customer), s AS (SELECT {ORG} + s_suppkey AS c, false AS gone FROM supplier WHERE s_suppkey % 3 <> 0),
e AS (SELECT * FROM c UNION ALL SELECT * FROM s), h AS (SELECT * FROM c WHERE c % 5 <> 0), t AS (SELECT * FROM h UNION ALL SELECT * FROM s)
SELECT what, n::BIGINT AS n, total FROM (SELECT 'requested' AS what, count_if(gone) + count_if(gone AND c % 2 = 0) AS n, 0::BIGINT AS total FROM c UNION ALL SELECT 'already_removed', count_if(gone AND c % 2 = 0), 0 FROM c
UNION ALL SELECT unnest(['removed_entities', 'removed_channels', 'removed_accounts']), count_if(gone), 0 FROM c
UNION ALL SELECT 'left in entities', count(*), coalesce(sum(c), 0)::BIGINT FROM e WHERE NOT gone UNION ALL SELECT unnest(['left in channels', 'left in owners']), count(*), coalesce(sum(c), 0)::BIGINT FROM t WHERE NOT gone
UNION ALL SELECT unnest(['left in accounts', 'left in facts']), count(*), coalesce(sum(c), 0)::BIGINT FROM h WHERE NOT gone)"""


def _seeds(c, faulty):
    k = F.col("c")
    odd = lambda r, other, sound: F.when(k % 19 == r, other).otherwise(sound) if faulty else sound
    rows = c.where("c % 3 = 0") if faulty else c.where("c % 6 = 0")
    s = rows.select(odd(1, F.lit(" "), k.cast("string")).alias("x_id"), F.concat(F.lit(" @H"), k.cast("string")).alias("handle"), F.col("segment").alias("category"), odd(2, F.lit(None).cast("string"), F.lit("reviewed")).alias("reason"), odd(3, F.lit("much"), odd(4, F.lit("-1"), odd(5, F.lit("NaN"), (1 + k % 7).cast("string")))).alias("weight"))
    got = rows.select(k.alias("x_id"), odd(6, F.lit("other"), F.concat(F.lit("h"), k.cast("string"))).alias("handle"), odd(7, F.lit("partial"), F.lit("complete")).alias("status"))
    who = rows.select(k.alias("x_id"), odd(8, F.lit(-1).cast("long"), k).alias("entity_id"), odd(9, F.lit("rejected"), F.lit("active")).alias("state"))
    return s, got, who, rows.where("c % 19 <> 10" if faulty else "true").select(k.alias("x_id"))


def seed_faults(spark, sf_dir):
    return manifests.seed_faults(*_seeds(_tables(spark, sf_dir)[1], True))


SEED_FAULTS = """WITH c AS (SELECT c_custkey AS c, 'h' || c_custkey AS handle, c_custkey % 19 AS r FROM customer WHERE c_custkey % 3 = 0), many AS (SELECT r FROM c GROUP BY 1 HAVING count(*) > 1)
SELECT handle, 'bad_weight' AS fault FROM c WHERE r IN (3, 5) UNION ALL SELECT handle, 'incomplete' FROM c WHERE r IN (1, 2, 4) UNION ALL SELECT handle, 'repeated_source' FROM c WHERE r = 1 AND r IN (FROM many)
UNION ALL SELECT handle, 'other_identity' FROM c WHERE r IN (1, 6) UNION ALL SELECT handle, 'not_complete_and_active' FROM c WHERE r IN (7, 9, 10) UNION ALL SELECT handle, 'shared_entity' FROM c WHERE r = 8 AND r IN (FROM many)"""


def seed_shares(spark, sf_dir):
    return manifests.seeds(*_seeds(_tables(spark, sf_dir)[1], False)).select("x_id", "handle", "entity_id", "category", "weight")


SEED_SHARES = """SELECT c_custkey::VARCHAR AS x_id, 'h' || c_custkey AS handle, c_custkey AS entity_id, c_mktsegment AS category, (1 + c_custkey % 7)::DOUBLE / sum(1 + c_custkey % 7) OVER () AS weight FROM customer WHERE c_custkey % 6 = 0"""

QUERIES = [
    ("coverage_faults", coverage_faults, COVERAGE_FAULTS),
    ("covered_organisations", covered_organisations, COVERED),
    ("removal_faults", removal_faults, REMOVAL_FAULTS),
    ("removed_entities", removed_entities, REMOVED),
    ("seed_faults", seed_faults, SEED_FAULTS),
    ("seed_shares", seed_shares, SEED_SHARES),
]
