"""Paged responses, cascades, consolidation, convergence over tables, views kept by day, reads held to a list: small cases with known results."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tessera.functions import urls
from tessera.operators import convergence, events, insights, publication, pruning, views
from tessera.sources import allowed, pager

RESPONSE = "source string, cursor string, attempt int, status int, retry_after string, body string"


def page(cursor=None, more=None, n=1, **other):
    return json.dumps({"tweets": [{}] * n, "has_next_page": cursor is not None if more is None else more, "next_cursor": cursor} | other)


CASES = [
    ("whole", "", 1, 200, None, page("a")), ("whole", "a", 1, 200, None, page(n=3)), ("whole", "b", 1, 200, None, page()),
    ("again", None, 1, 429, "99", None), ("again", None, 2, 429, "soon", None), ("again", None, 3, 200, None, page()),
    ("busy", "", 1, 429, None, None), ("busy", "", 2, 429, "-3", None), ("busy", "", 3, 429, None, None), ("busy", "", 4, 429, None, None), ("busy", "", 5, 200, None, page()),
    ("gone", "", 1, 404, None, None), ("down", "", 1, 503, None, None), ("cut", "", 1, None, None, None),
    ("text", "", 1, 200, None, "<html>"), ("null", "", 1, 200, None, None), ("list", "", 1, 200, None, "[1]"), ("shape", "", 1, 200, None, '{"tweets": 5}'),
    ("error", "", 1, 200, None, page("a", status="error")),
    ("end", "", 1, 200, None, page(None, True)),
    ("ring", "", 1, 200, None, page("a")), ("ring", "a", 1, 200, None, page("b")), ("ring", "b", 1, 200, None, page("a")),
    ("lost", "", 1, 200, None, page("é")),
]


def test_pages_are_read_along_their_cursors(spark, tmp_path):
    path = f"file://{tmp_path}/pages"
    pager.record(spark.createDataFrame(CASES, RESPONSE).repartition(3), path, "1")
    spark.dataSource.register(pager.RecordedPages)
    read = lambda **o: spark.read.format("recorded_pages").options(path=path, **o).load()
    found = {}
    for r in read().collect():
        found.setdefault(r.source, {})[r.place] = r
    last = {s: (len(p), p[len(p)].fault, p[len(p)].retryable) for s, p in found.items()}
    assert last == {
        "whole": (2, None, False), "again": (1, None, False), "busy": (1, "provider_http", True), "gone": (1, "provider_http", False), "down": (1, "provider_http", True), "cut": (1, "network", True),
        "text": (1, "provider_json", True), "null": (1, "provider_json", True), "list": (1, "provider_shape", True), "shape": (1, "provider_shape", True), "error": (1, "provider_error", False),
        "end": (1, "cursor_missing", True), "ring": (3, "cursor_repeat", True), "lost": (2, "not_recorded", True),
    }
    assert [found["whole"][k].items for k in (1, 2)] == [1, 3]
    assert (found["again"][1].attempts, found["again"][1].waited) == (3, 62.0)
    assert (found["busy"][1].attempts, found["busy"][1].waited) == (4, 5.0)
    assert found["lost"][2].cursor == "é" and found["ring"][3].items == 1
    more = {r.source: r for r in read(attempts="5").where("source = 'busy'").collect()}
    assert more["busy"].fault is None and more["busy"].attempts == 5
    with pytest.raises(Exception, match="PagerFault"):
        read(mode="fail").collect()


def test_a_stream_of_recordings_resumes_behind_the_last(spark, tmp_path):
    path, out = f"file://{tmp_path}/pages", f"{tmp_path}/out"
    rows = lambda s: spark.createDataFrame([(s, "", 1, 200, None, page("a")), (s, "a", 1, 200, None, page())], RESPONSE)
    spark.dataSource.register(pager.RecordedPages)

    def drain():
        q = spark.readStream.format("recorded_pages").option("path", path).load().writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").start(out)
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted((r.source, r.place) for r in spark.read.parquet(out).collect())

    pager.record(rows("x"), path, "2024-01-01")
    assert drain() == [("x", 1), ("x", 2)]
    assert drain() == [("x", 1), ("x", 2)]
    pager.record(rows("y"), path, "2024-01-02")
    (tmp_path / "pages" / "2024-01-03").mkdir()  # not whole yet
    assert drain() == [("x", 1), ("x", 2), ("y", 1), ("y", 2)]


def cascaded(holds, gone, able):
    holds, out = {h for h in holds if None not in h}, set(gone)
    while True:
        more = {n for n in able - out if (own := {h for h, m in holds if m == n}) and own <= out}
        if not more:
            return out
        out |= more


@pytest.mark.parametrize("seed", range(3))
def test_a_cascade_equals_counting(spark, seed):
    r = random.Random(seed)
    holds = [(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(60)] + [("n1", None), ("a", "b"), ("b", "c"), ("c", "d"), ("a", "b")]
    gone, able = {f"n{k}" for k in range(0, 40, 4)} | {"a"}, {f"n{k}" for k in range(40) if k % 5} | {"b", "c", "d"}
    one = lambda s: spark.createDataFrame([(x,) for x in s], "node string")
    found = {x.node: x.round for x in pruning.cascade(spark, spark.createDataFrame(holds, "holder string, node string"), one(gone), one(able)).collect()}
    assert set(found) == cascaded(holds, gone, able)
    assert [found[x] for x in "abcd"] == [0, 1, 2, 3]


def test_a_cascade_of_nothing_and_of_a_ring(spark):
    one = lambda *s: spark.createDataFrame([(x,) for x in s], "node long")
    holds = lambda *s: spark.createDataFrame(list(s), "holder long, node long")
    assert pruning.cascade(spark, holds(), one(), one()).count() == 0
    ring = holds((1, 2), (2, 3), (3, 2), (1, 4), (1, 4), (5, 6))
    assert {(r.node, r.round) for r in pruning.cascade(spark, ring, one(1), one(2, 3, 4, 6)).collect()} == {(1, 0), (4, 1)}


FACTS, AFFILIATIONS = "fact_id long, entity_id long, fact string, source string, observed_at string, extra int", "affiliation_id long, person_id long, organisation_id long, source string, observed_at string"
LINKS, CHANNELS, ENTITIES = "entity_id long, channel_id long, evidence_url string, notes string", "channel_id long, kind string", "entity_id long, kind string"


def test_a_conference_keeps_one_claim_and_its_own_companies_go(spark):
    c, e = "conference_company", "https://www.ai.engineer/x"
    facts = [(k, k, c, "aie-1", "t", 1) for k in (10, 11, 12, 13, 14, 15)] + [(20, 1, "role", "aie-1", "a", 1), (21, 1, "role", "aie-2", "b", 1), (22, 1, "role", "web", "a", 1), (23, 1, "company_x_candidate", "aie-1", "z", 1), (24, 1, None, None, "z", 1)]
    affiliations = [(1, 1, 10, "aie-1", "a"), (2, 1, 12, "aie-2", "b"), (3, 2, 11, "aie-1", "a"), (4, 3, 11, "web", "a")]
    links = [(12, 100, e, None), (13, 101, e, None), (13, 102, None, "Official company link in AI Engineer 1"), (13, 103, "https://o.example", None), (14, 102, e, None), (15, 104, e, None), (15, 105, e, None), (1, 105, None, None)]
    channels = [(k, "x" if k == 103 else "website") for k in range(100, 107)]
    entities = [(k, "organization") for k in range(10, 16)] + [(k, "person") for k in (1, 2, 3)]
    make = spark.createDataFrame
    tables = {"facts": make(facts, FACTS), "affiliations": make(affiliations, AFFILIATIONS), "links": make(links, LINKS), "channels": make(channels, CHANNELS), "entities": make(entities, ENTITIES)}
    out = pruning.consolidate(tables, make([(14,), (None,)], "entity_id long"))
    ids = lambda t, c: {r[c] for r in out[t].collect()}
    # 10 and 11 have no channel: 10 goes, 11 has an affiliation of another source. 12 is held by a speaker. 13 keeps a link of its own, 14 is held
    # elsewhere, 15 goes; 105 has a link of someone else, and 106 was never touched.
    assert ids("entities", "entity_id") == {1, 2, 3, 11, 12, 13, 14}
    assert ids("facts", "fact_id") == {12, 21, 22, 24} and out["facts"].columns == tables["facts"].columns
    assert ids("affiliations", "affiliation_id") == {2, 4}
    assert {(r.entity_id, r.channel_id) for r in out["links"].collect()} == {(12, 100), (13, 103), (1, 105)}
    assert ids("channels", "channel_id") == {100, 103, 105, 106}
    assert {r.what: r.n for r in out["removed"].collect()} == {"facts": 7, "affiliations": 2, "unresolved_affiliations": 1, "unresolved_organisations": 1, "orphan_organisations": 1, "website_links": 5, "channels": 3}
    none = pruning.consolidate({n: df.limit(0) for n, df in tables.items()})
    assert {n: df.count() for n, df in none.items()} == {"facts": 0, "affiliations": 0, "links": 0, "channels": 0, "entities": 0, "removed": 7}
    assert {r.n for r in none["removed"].collect()} == {0}


def aid(spark, url):
    return spark.range(1).select(urls.artifact_id(F.lit(url))).first()[0]


def test_tables_converge_together(spark):
    at = lambda x: f"https://h.example/{x}"
    ids = {x: aid(spark, at(x)) for x in "abcdefg"}
    names = {v: k for k, v in ids.items()}
    art = spark.createDataFrame([(ids[x], at(x), "h.example", f"title {x}", "1", "2", "2") for x in "abcdg"], "artifact_id string, canonical_url string, host string, title string, first_seen_at string, last_seen_at string, updated_at string")
    alias = spark.createDataFrame([("http://t.example/a", ids["a"], "seen", "1", "1"), (at("d"), ids["d"], "seen", "3", "3")], "alias_url string, artifact_id string, alias_kind string, first_seen_at string, last_seen_at string")
    item = spark.createDataFrame([(1, ids["a"], "from a"), (1, ids["b"], "from b"), (1, ids["d"], "own"), (2, ids["b"], "from b"), (2, ids["a"], "from a"), (3, ids["c"], "from c")], "fetch_run_id long, artifact_id string, state string")
    seen = spark.createDataFrame([(1, ids["a"]), (2, ids["b"]), (3, None)], "n long, artifact_id string")
    tables = {"artifact": art, "alias": alias, "item": item, "observation": seen}
    to = lambda *s: spark.createDataFrame([(ids.get(a, a), b, c) for a, b, c in s], "source_id string, final_url string, seen_at string")
    out = convergence.converge_tables(tables, to(("a", at("b"), "5"), ("b", at("d") + "#x", "4"), ("c", at("e"), "6"), ("e", at("f"), "7"), ("g", at("g"), "8")))
    rows = {names[r.artifact_id]: r for r in out["artifact"].collect()}
    assert set(rows) == {"d", "f", "g"}
    assert (rows["d"].last_seen_at, rows["d"].updated_at, rows["d"].title) == ("2", "2", "title d")
    assert (rows["f"].last_seen_at, rows["f"].canonical_url, rows["f"].title, rows["f"].first_seen_at) == ("7", at("f"), "title c", "1")
    told = {r.alias_url: (names[r.artifact_id], r.alias_kind, r.first_seen_at, r.last_seen_at) for r in out["alias"].collect()}
    assert told["http://t.example/a"] == ("d", "seen", "1", "1") and told[at("d")] == ("d", "seen", "3", "3")
    assert told[at("a")][:2] == told[at("b")][:2] == told[at("d") + "#x"][:2] == ("d", "redirect")
    assert told[at("c")][0] == told[at("e")][0] == told[at("f")][0] == "f" and told[at("g")][0] == "g"
    assert {(r.fetch_run_id, names[r.artifact_id], r.state) for r in out["item"].collect()} == {(1, "d", "own"), (2, "d", "from b"), (3, "f", "from c")}
    assert {(r.n, names.get(r.artifact_id)) for r in out["observation"].collect()} == {(1, "d"), (2, "d"), (3, None)}
    same = convergence.converge_tables(tables, to())
    assert {n: df.count() for n, df in same.items()} == {n: df.count() for n, df in tables.items()}
    for fault, rows in (("bad_final_url", [("a", "ftp://x/y", "1")]), ("several_targets", [("a", at("b"), "1"), ("a", at("c"), "1")]), ("source_artifact_missing", [("zz", at("b"), "1")]), ("alias_conflict", [("b", "http://t.example/a", "1"), ("a", at("d"), "1")])):
        with pytest.raises(ValueError, match=fault):
            convergence.converge_tables(tables, to(*rows))
    with pytest.raises(events.BrokenForest):
        convergence.converge_tables(tables, to(("a", at("b"), "1"), ("b", at("a"), "1")))


def counted(posts):
    return posts.groupBy("day").agg(F.count("*").alias("n"))


def test_a_view_is_computed_again_for_what_changed(spark, tmp_path):
    root = f"file://{tmp_path}/view"
    posts = lambda *s: spark.createDataFrame([(d, k) for d, k in s], "day string, k long")
    rows = [("2024-01-01", 1), ("2024-01-01", 2), ("2024-01-02", 3), ("2024-01-03", 4)]

    def ask(source, code="1", back=0):
        view, again = views.refreshed(root, {"posts": source}, counted, views.code_digest(counted, code), back)
        return {r.day: r.n for r in view.collect()}, [int(d[-2:]) for d in again]

    with pytest.raises(LookupError):
        views.kept(spark, root)
    assert ask(posts(*rows)) == ({"2024-01-01": 2, "2024-01-02": 1, "2024-01-03": 1}, [1, 2, 3])
    version = publication.DayLog(spark, root).read()[0]
    assert ask(posts(*rows).repartition(3))[1] == [] and publication.DayLog(spark, root).read()[0] == version
    rows[2] = ("2024-01-02", 30)
    assert ask(posts(*rows, ("2024-01-04", 5), (None, 6))) == ({"2024-01-01": 2, "2024-01-02": 1, "2024-01-03": 1, "2024-01-04": 1}, [2, 4])
    assert ask(posts(*rows[2:])) == ({"2024-01-02": 1, "2024-01-03": 1}, [])
    assert ask(posts(*rows[2:]), code="2")[1] == [2, 3]
    assert ask(posts(*rows[2:]), code="2", back=1)[1] == [2, 3]
    rows[2] = ("2024-01-02", 31)
    assert ask(posts(*rows[2:]), code="2", back=1)[1] == [2, 3]
    folder = {v["folder"] for v in publication.DayLog(spark, root).read()[1].values() if v["folder"]}.pop()
    (tmp_path / "view" / "data" / folder.split("/")[-1] / "_SUCCESS").unlink()
    assert ask(posts(*rows[2:]), code="2", back=1) == ({"2024-01-02": 1, "2024-01-03": 1}, [2, 3])


def test_reads_are_held_to_a_list(spark, tmp_path):
    known = allowed.Allowed(spark, {t: f"{DATA}/{t}.parquet" for t in ("nation", "region", "supplier")}, ["nation", "region"])
    assert known.table("nation").count() == 25
    assert known.sql("SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey)").count() == 5
    assert known.sql("SELECT 1 AS one UNION ALL SELECT id FROM range(3)").count() == 4
    spark.range(3).createOrReplaceTempView("outside")
    spark.range(3).createOrReplaceGlobalTempView("everywhere")
    out = f"{tmp_path}/out"
    for s in (
        "SELECT * FROM supplier", "SELECT * FROM outside", "SELECT * FROM global_temp.everywhere", f"SELECT * FROM parquet.`{DATA}/supplier.parquet`", "SELECT (SELECT max(s_suppkey) FROM supplier) AS n FROM nation",
        "WITH nation AS (SELECT * FROM supplier) SELECT * FROM nation", f"INSERT OVERWRITE DIRECTORY '{out}' USING parquet SELECT * FROM nation", "CREATE TABLE t AS SELECT 1 AS x", "DROP VIEW nation", "SET spark.sql.runSQLOnFiles=true",
    ):
        with pytest.raises(allowed.ReadRefused):
            known.sql(s)
    with pytest.raises(allowed.ReadRefused):
        known.table("supplier")
    with pytest.raises(ValueError):
        allowed.Allowed(spark, {}, ["nation"])
    assert not (tmp_path / "out").exists() and known.table("nation").count() == 25


def test_final_results_are_held_to_all_rules(spark):
    schema = "result_id long, headline string, decision string, no_match_reason string, connections array<struct<mechanism:string,companies:array<struct<ticker:string,bet_id:string>>>>"
    one = lambda *cs: [("m", list(cs))]
    ok, long = "A headline of few words", " ".join(["w"] * 19)
    rows = [
        (1, ok, "surface", None, one(("A", "b1"), ("A", "b2"))), (2, f"  {' '.join(['w'] * 18)}\n", "suppress", "no fit", []), (3, long, "suppress", "no fit", None), (4, "two\nlines", "suppress", "no fit", []), (5, None, "suppress", "no fit", []),
        (6, ok, "surface", None, one(("A", "b1")) + one(("A", "b1"))), (7, ok, "surface", None, one(("B", "b1"))), (8, ok, "surface", None, one(("A", "b9"))), (9, ok, "surface", None, one((None, None))),
        (10, ok, "surface", None, []), (11, ok, "surface", "", one(("A", "b1"))), (12, ok, "suppress", " ", []), (13, ok, "suppress", "no fit", one(("A", "b1"))), (14, ok, None, None, None),
        (15, ok, "surface", None, [("see [1](x)", [("A", "b1")])]), (16, ok, "suppress", "HTTP://x", []), (17, ok, "surface", None, [("m", None)]),
    ]
    opened = spark.createDataFrame([(k, "A") for k in range(1, 18)] * 2, "result_id long, ticker string")
    bets = spark.createDataFrame([("A", "b1"), ("A", "b2"), ("B", "b1")], "ticker string, bet_id string")
    found = {r.result_id: r.faults for r in insights.final_faults(spark.createDataFrame(rows, schema), opened, bets).collect()}
    assert found == {
        3: ["bad_headline"], 4: ["bad_headline"], 5: ["bad_headline"], 6: ["repeated_bet"], 7: ["memo_not_opened"], 8: ["unknown_bet"], 9: ["memo_not_opened", "unknown_bet"], 10: ["surface_incomplete"], 11: ["surface_incomplete"],
        12: ["suppressed_incomplete"], 13: ["suppressed_incomplete"], 14: ["suppressed_incomplete"], 15: ["link_in_prose"], 16: ["link_in_prose"], 17: ["surface_incomplete"],
    }


def test_tables_converge_without_the_driver(spark):
    a, b = (aid(spark, f"https://h.example/{x}") for x in "ab")
    art = spark.createDataFrame([(a, "https://h.example/a", "h.example", "1", "2", "2"), (b, "https://h.example/b", "h.example", "1", "2", "2")], "artifact_id string, canonical_url string, host string, first_seen_at string, last_seen_at string, updated_at string")
    alias = spark.createDataFrame([("http://t.example/a", a, "seen", "1", "1")], "alias_url string, artifact_id string, alias_kind string, first_seen_at string, last_seen_at string")
    tables = {"artifact": art, "alias": alias, "item": spark.createDataFrame([(1, a), (1, b)], "fetch_run_id long, artifact_id string"), "observation": spark.createDataFrame([(a,)], "artifact_id string")}
    out = convergence.converge_tables(tables, spark.createDataFrame([(a, "https://h.example/b", "5")], "source_id string, final_url string, seen_at string"))
    assert [r.artifact_id for r in out["item"].collect()] == [r.artifact_id for r in out["observation"].collect()] == [b]
    assert not [k for k, df in out.items() if "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()]
