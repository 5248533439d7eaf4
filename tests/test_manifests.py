"""Manifests of organisations, removals and seeds: each fault alone, whole application, application again, nothing on a fault."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import manifests, publication
from tessera.sources import readers

SCHEMAS = {
    "entities": "entity_id long, kind string, slug string, name string, rejected boolean, notes string, updated_at string, extra string",
    "channels": "channel_id long, kind string, key string, label string, last_seen_at string",
    "owners": "entity_id long, channel_id long, relationship string, confidence double, evidence_url string, notes string",
    "accounts": "handle string, x_id string, display_name string, bio string, followers long, first_seen_at string, last_seen_at string",
    "facts": "handle string, source string, fact string, value string, observed_at string, evidence_url string",
    "observations": "channel_id long, source string, metric string, value string, observed_at string, evidence_url string",
    "labs": "slug string, name string, notes string",
}
ROWS = {
    "entities": [(1, "organization", "acme", "Acme", False, None, "0", "kept"), (2, "organization", "acme-ai", "Acme AI", None, None, "0", None), (3, "person", "bo", "Bo", False, None, "0", None), (4, "organization", "gone", "Gone", True, None, "0", None), (5, "organization", "zed", "Zed", False, None, "0", None)],
    "channels": [(10, "x", "acme", "old label", "3"), (11, "x", "acmeai", None, "1"), (12, "x", "bo", None, "1"), (13, "x", "gone", None, "1"), (14, "blog", "https://Acme.example/Blog", "B", "1"), (15, "x", "zed", None, "1"), (16, "x", "zed2", None, "1")],
    "owners": [(1, 10, "identity", 0.5, None, None), (2, 11, "identity", 0.5, "https://old.example", "n"), (2, 14, "official", 0.7, None, None), (3, 12, "identity", 1.0, None, None), (4, 13, "identity", 1.0, None, None), (5, 15, "identity", 1.0, None, None), (5, 16, "official", 1.0, None, None)],
    "accounts": [("acme", "100", "was", "was", 1, "2", "2"), ("acmeai", "101", None, None, None, "1", "9"), ("bo", "102", None, None, None, None, None), ("zed", "105", None, None, None, None, None), ("zed2", "106", None, None, None, None, None)],
    "facts": [("acme", "following-snapshot:s1", "organization_coverage", "other", "0", None), ("bo", "web", "bio", "v", "0", None)],
    "observations": [(10, "following-snapshot:s1", "bio", "old", "5", "https://was.example")],
    "labs": [("acme-lab", "L", None), ("bo", "Bo's", None)],
}
SNAPSHOT = [(100, "Acme", "Acme Inc", "bio", 7, "1", "5"), (101, "AcmeAI", "Acme AI", None, 8, None, "4"), (103, "NewCo", "New", "nb", None, "3", "3"), (105, "zed", None, None, None, None, None), (106, "zed2", None, None, None, None, None), (107, "acme", "later id", None, 1, "0", "9")]


def registry(spark, **changed):
    return {k: spark.createDataFrame(changed.get(k, ROWS[k]), SCHEMAS[k]) for k in SCHEMAS}


def snapshot(spark, rows=SNAPSHOT):
    return spark.createDataFrame(rows, "x_id long, handle string, display_name string, bio string, followers long, first_observed_at string, last_observed_at string")


def channel(kind, key, x=None, **other):
    return {"kind": kind, "key": key, "relationship": "official", "evidence_url": "https://e.example", "expected_x_id": x} | other


def organisation(slug="acme", name="Acme", **other):
    listed = [channel("x", "@Acme", "100", relationship="identity"), channel("x", "acmeai", "101"), channel("blog", "https://Acme.example/Blog"), channel("github", "https://github.com/Acme", label="code")]
    return {"slug": slug, "name": name, "reason": "one firm", "evidence_url": "https://e.example", "channels": listed, "merge_handles": [{"handle": "@AcmeAI", "expected_entity_name": "Acme AI"}], "legacy_lab_slug": "acme-lab"} | other


NEW = organisation("new-co", "New Co", channels=[channel("x", "newco", "103"), channel("website", "https://new.example"), channel("website", "https://new.example", relationship="identity")], merge_handles=[], legacy_lab_slug=None)


def read(spark, tmp_path, *orgs, **head):
    path = tmp_path / "coverage.json"
    path.write_text(json.dumps({"schema_version": manifests.COVERAGE_VERSION, "snapshot": {"snapshot_id": "s1", "cohort_sha256": "c", "database_sha256": "d"}, "organizations": list(orgs)} | head))
    return manifests.read_coverage(spark, f"file://{path}")


def as_set(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_a_sound_manifest_is_applied_whole_and_again_changes_nothing(spark, tmp_path):
    m, reg, seen = read(spark, tmp_path, organisation(), NEW), registry(spark), snapshot(spark)
    out = manifests.apply_coverage(spark, m, reg, seen, "8")
    assert dict(as_set(out["counts"])) == {"organizations": 2, "created_entities": 1, "merged_entities": 1, "imported_accounts": 1, "linked_channels": 2 + 3, "already_grouped": 0}
    ent = {r.slug: r for r in out["entities"].collect()}
    assert sorted(ent) == ["acme", "bo", "gone", "new-co", "zed"]
    assert (ent["acme"].updated_at, ent["acme"].extra, ent["zed"].updated_at) == ("8", "kept", "0")
    assert (ent["new-co"].entity_id, ent["new-co"].kind, ent["new-co"].name, ent["new-co"].notes, ent["new-co"].updated_at) == (6, "organization", "New Co", "one firm", "8")
    ch = {(r.kind, r.key): r for r in out["channels"].collect()}
    assert (ch["x", "acme"].label, ch["x", "acme"].last_seen_at) == ("Acme Inc", "5") and (ch["x", "newco"].label, ch["x", "newco"].last_seen_at) == ("New", "3")
    assert (ch["blog", "https://Acme.example/Blog"].label, ch["blog", "https://Acme.example/Blog"].last_seen_at) == ("B", "8") and ch["github", "acme"].label == "code"
    assert len(ch) == 10 and sorted(c.channel_id for c in ch.values())[-3:] == [17, 18, 19]
    own = {r.channel_id: r for r in out["owners"].collect()}
    assert len(own) == out["owners"].count() == 10
    assert [own[k].entity_id for k in (10, 11, 14, 12)] == [1, 1, 1, 3] and own[12].confidence == 1.0
    assert tuple(own[10])[2:] == ("identity", 1.0, "https://e.example", "one firm") and own[11].relationship == "official"
    assert own[ch["website", "https://new.example"].channel_id].relationship == "identity"
    acc = {r.handle: tuple(r)[1:] for r in out["accounts"].collect()}
    assert acc["acme"] == ("100", "Acme Inc", "bio", 7, "1", "5") and acc["acmeai"] == ("101", "Acme AI", None, 8, "1", "9") and acc["newco"] == ("103", "New", "nb", None, "3", "3") and len(acc) == 6
    fact = {(r.handle, r.value) for r in out["facts"].collect()}
    assert fact == {("acme", "acme"), ("acmeai", "acme"), ("newco", "new-co"), ("bo", "v")}
    assert {(r.channel_id, r.metric, r.value) for r in out["observations"].collect()} == {(10, "bio", "bio"), (10, "followers_count", "7"), (11, "followers_count", "8"), (ch["x", "newco"].channel_id, "bio", "nb")}
    assert [(r.canonical_id, r.removed_slug, r.source, r.merged_at) for r in out["audit"].collect()] == [(1, "acme-ai", "organization-coverage-manifest", "8")]
    assert as_set(out["labs"]) == [("acme", "Acme", "one firm"), ("bo", "Bo's", None)]

    version = publication.publish_tables(f"file://{tmp_path}/log", out)
    first = publication.published_tables(spark, f"file://{tmp_path}/log")
    again = manifests.apply_coverage(spark, m, first, seen, "8")
    assert version == 1 and dict(as_set(again["counts"])) == {"organizations": 2, "created_entities": 0, "merged_entities": 0, "imported_accounts": 0, "linked_channels": 0, "already_grouped": 1}
    for name in ROWS:
        assert as_set(again[name].select(*first[name].columns)) == as_set(first[name]), name


FORM = [
    ({"slug": "Acme"}, "", "bad_slug"), ({"slug": "acme\n"}, "", "bad_slug"), ({"name": "  "}, "", "no_name"), ({"reason": None}, "", "no_reason"), ({"evidence_url": "http://e.example"}, "", "no_https_evidence"),
    ({"channels": []}, "", "no_channels"), ({"channels": None}, "", "no_channels"), ({"slug": "lab", "legacy_lab_slug": "lab"}, "", "bad_lab_slug"), ({"legacy_lab_slug": ""}, "", "bad_lab_slug"),
    ({"channels": [channel("irc", "a")]}, "irc:a", "bad_kind"), ({"channels": [channel(None, "a")]}, ":a", "bad_kind"), ({"channels": [channel("github", " ")]}, "github:", "no_key"), ({"channels": [channel("x", None, "1")]}, "x:", "no_key"),
    ({"channels": [channel("x", "A", " ")]}, "x:a", "no_x_id"), ({"channels": [channel("x", "A", "1"), channel("x", "@a", "1")]}, "x:a", "repeated_handle"), ({"channels": [channel("blog", "http://b.example")]}, "blog:http://b.example", "key_not_https"),
    ({"channels": [channel("github", "g", relationship="fan")]}, "github:g", "bad_relationship"), ({"channels": [channel("github", "g", evidence_url=None)]}, "github:g", "no_https_evidence"),
    ({"merge_handles": [{"handle": "who", "expected_entity_name": "W"}]}, "@who", "not_a_channel"), ({"merge_handles": [{"handle": None, "expected_entity_name": "W"}]}, "@", "no_handle"), ({"merge_handles": [{"handle": "acmeai", "expected_entity_name": " "}]}, "@acmeai", "no_expected_name"),
    ({"merge_handles": [{"handle": h, "expected_entity_name": "Acme AI"} for h in ("acmeai", "@AcmeAI")]}, "@acmeai", "repeated_merge"),
]


def test_a_manifest_is_held_to_its_form(spark, tmp_path):
    assert as_set(manifests.form_faults(read(spark, tmp_path, organisation(), NEW))) == []
    found = {tuple(r) for r in manifests.form_faults(read(spark, tmp_path, *[organisation(**({"slug": f"o{k}"} | changed)) for k, (changed, _, _) in enumerate(FORM)])).collect()}
    for k, (changed, item, fault) in enumerate(FORM):
        slug = changed.get("slug") or f"o{k}"
        assert (slug, item, fault) in found, (changed, {r for r in found if r[0] == slug})
    twice = read(spark, tmp_path, organisation(), organisation(channels=[channel("github", "ACME")], merge_handles=[]))
    assert {(r.item, r.fault) for r in manifests.form_faults(twice).collect()} == {("", "repeated_slug"), ("github:acme", "claimed_twice")}


def test_a_manifest_is_held_to_registry_and_snapshot(spark, tmp_path):
    reg, seen = registry(spark), snapshot(spark)
    check = lambda *orgs, r=reg, s=seen: {(x.slug, x.item, x.fault) for x in manifests.registry_faults(read(spark, tmp_path, *orgs), r, s).collect()}
    assert check(organisation(), NEW) == set()
    assert check(organisation(name="Other")) == {("acme", "", "canonical_name")}
    assert ("bo", "", "canonical_kind") in check(organisation("bo", "Bo")) and ("gone", "", "canonical_rejected") in check(organisation("gone", "Gone"))
    one = lambda key, x, name=None, slug="n", **o: organisation(slug, "N", channels=[channel("x", key, x)], merge_handles=[{"handle": key, "expected_entity_name": name}] if name else [], legacy_lab_slug=None, **o)
    assert check(one("bo", "102", "Bo")) == {("n", "@bo", "member_kind"), ("n", "x:bo", "not_in_snapshot")}
    assert check(one("zed", "105", "Zee")) == {("n", "@zed", "member_name")} and check(one("zed", "105")) == {("n", "x:zed", "other_owner")}
    assert check(one("gone", "1", "Gone")) == {("n", "@gone", "member_rejected"), ("n", "x:gone", "owner_rejected"), ("n", "x:gone", "not_in_snapshot")}
    assert check(one("newco", "9", "New")) == {("n", "x:newco", "other_x_id"), ("n", "@newco", "no_entity")}
    moved = registry(spark, accounts=[("newco", None, None, None, None, None, None), ("elder", "103", None, None, None, None, None)])
    assert check(one("newco", "103"), r=moved) == {("n", "x:newco", "registry_x_id"), ("n", "x:newco", "taken_x_id")}
    both = check(one("zed", "105", "Zed", "n"), one("zed2", "106", "Zed", "m"))
    assert both == {("n", "@zed", "member_shared"), ("m", "@zed2", "member_shared")}
    assert ("acme", "@zed", "member_named") in check(organisation("zed", "Zed", channels=[channel("x", "zed2", "106")], merge_handles=[], legacy_lab_slug=None), organisation(channels=[channel("x", "zed", "105")], merge_handles=[{"handle": "zed", "expected_entity_name": "Zed"}]))
    two = registry(spark, owners=[*ROWS["owners"], (3, 15, "identity", 1.0, None, None)])
    assert ("n", "@zed", "several_entities") in check(one("zed", "105", "Zed"), r=two)
    assert check(organisation(legacy_lab_slug="no")) == {("acme", "", "lab_missing")}
    labs = registry(spark, labs=[("acme", "A", None), ("acme-lab", "L", None)])
    assert check(organisation(), r=labs) == {("acme", "", "lab_twice")}
    no_labs = {k: v for k, v in reg.items() if k != "labs"}
    assert check(organisation(legacy_lab_slug="no"), r=no_labs) == set() and "labs" not in manifests.apply_coverage(spark, read(spark, tmp_path, organisation()), no_labs, seen, "8")
    empty = {k: v.limit(0) for k, v in reg.items()}
    assert check(NEW, r=empty) == set() and check(NEW, r=empty, s=seen.limit(0)) == {("new-co", "x:newco", "not_in_snapshot")}
    made = manifests.apply_coverage(spark, read(spark, tmp_path, NEW), empty, seen, "8")
    assert [r.entity_id for r in made["entities"].collect()] == [1] and sorted(r.channel_id for r in made["channels"].collect()) == [1, 2]
    with pytest.raises(manifests.ManifestFault, match="canonical_name"):
        manifests.apply_coverage(spark, read(spark, tmp_path, organisation(name="Other"), NEW), reg, seen, "8")


def test_a_manifest_names_its_snapshot_by_digest(spark, tmp_path):
    (tmp_path / "snap").mkdir()
    (tmp_path / "snap" / "following.db").write_bytes(b"accounts")
    files = readers.snapshot_files(spark, f"file://{tmp_path}/snap").collect()
    assert [(r.path.rsplit("/", 1)[1], r.bytes) for r in files] == [("following.db", 8)]
    digest = files[0].sha256
    named = {"snapshot_id": "s1", "cohort_sha256": "c", "database_sha256": digest}
    runs = lambda *r: spark.createDataFrame(r, "snapshot_id string, cohort_sha256 string, status string")
    check = lambda head, r, d=digest: {x.fault for x in manifests.head_faults(read(spark, tmp_path, NEW, **head)["head"], r, d).collect()}
    good = runs(("s1", "c", "complete"))
    assert check({"snapshot": named}, good) == set()
    assert check({"snapshot": named, "schema_version": None}, good) == {"unsupported_version"}
    assert check({"snapshot": named}, good, "0" * 64) == {"other_database"}
    assert check({"snapshot": named}, runs(("s2", "d", "partial"))) == {"other_snapshot", "other_cohort", "snapshot_not_complete"}
    assert check({"snapshot": named | {"cohort_sha256": " "}}, good) == {"no_snapshot", "other_cohort"}
    assert "snapshot_not_complete" in check({"snapshot": named}, runs().limit(0)) and "no_snapshot" in check({"snapshot": None}, good)


REMOVAL = "entity_id long, name string, kind string, model_decision string, review_basis string, reason string"
FINE = (3, "Bo", "person", "remove", "model_remove", "off topic")


def removal(**changed):
    return tuple((dict(zip(("entity_id", "name", "kind", "model_decision", "review_basis", "reason"), FINE, strict=True)) | changed).values())


def test_removals_take_only_what_nothing_rests_on(spark):
    reg = registry(spark)
    audit, edges, labs = spark.createDataFrame([(1,)], "canonical_id long"), spark.createDataFrame([("ZED9", "Acme")], "source string, target string"), spark.createDataFrame([("BO2",)], "handle string")
    check = lambda *rows, a=audit, e=edges, l=labs, r=reg: {tuple(x) for x in manifests.removal_faults(spark.createDataFrame(rows, REMOVAL), r, a, e, l).collect()}
    assert check(FINE, removal(entity_id=99)) == set() and check(FINE, l=None) == set()
    assert check(FINE, FINE) == {(3, "repeated_entity")} and check(removal(entity_id=None)) == {(None, "no_entity_id")}
    assert check(removal(model_decision="keep")) == {(3, "bad_review")} == check(removal(review_basis=None)) and check(removal(model_decision="keep", review_basis="manual_override_from_keep")) == set()
    assert check(removal(reason="\t")) == {(3, "no_name_or_reason")} and check(removal(name="Bob")) == {(3, "other_identity")} and check(removal(kind="firm")) == {(3, "bad_kind"), (3, "other_identity")}
    org = lambda k, name: removal(entity_id=k, name=name, kind="organization")
    assert check(org(1, "Acme")) == {(1, "merge_canonical"), (1, "in_graph")} and check(org(4, "Gone")) == {(4, "rejected"), (4, "no_account")}
    assert check(org(2, "Acme AI")) == {(2, "not_one_handle")} == check(removal(entity_id=2, name="Acme AI", kind="organization"), r=registry(spark, owners=ROWS["owners"][2:]))
    assert check(FINE, l=spark.createDataFrame([("Bo",)], "handle string"), e=spark.createDataFrame([("x", "BO")], "source string, target string")) == {(3, "seeded_lab"), (3, "in_graph")}
    out = manifests.apply_removals(spark.createDataFrame([FINE, removal(entity_id=99)], REMOVAL), reg, audit, edges, labs)
    assert dict(as_set(out["counts"])) == {"requested": 2, "removed_entities": 1, "removed_channels": 1, "removed_accounts": 1, "already_removed": 1}
    assert {r.entity_id for r in out["entities"].collect()} == {1, 2, 4, 5} and 12 not in {r.channel_id for r in out["channels"].collect()} | {r.channel_id for r in out["owners"].collect()}
    assert {r.handle for r in out["accounts"].collect()} == {"acme", "acmeai", "zed", "zed2"} and [r.handle for r in out["facts"].collect()] == ["acme"]
    none = manifests.apply_removals(spark.createDataFrame([], REMOVAL), reg, audit, edges)
    assert as_set(none["entities"]) == as_set(reg["entities"])
    with pytest.raises(manifests.ManifestFault, match="bad_review"):
        manifests.apply_removals(spark.createDataFrame([FINE, removal(entity_id=5, model_decision=None)], REMOVAL), reg, audit, edges)


def test_seeds_are_reviewed_complete_and_active(spark):
    source = "x_id string, handle string, category string, weight string, reason string"
    fetched = spark.createDataFrame([(1, "Ann", "complete"), (2, "bo", "complete"), (3, "cy", "partial"), (4, "di", "complete")], "x_id long, handle string, status string")
    who = spark.createDataFrame([("1", 10, "active"), ("2", 20, "active"), ("3", 30, "active"), ("4", 10, "active")], "x_id string, entity_id long, state string")
    nodes = spark.createDataFrame([(1,), (2,), (3,), (4,), (4,)], "x_id long")
    make = lambda *rows: spark.createDataFrame(rows, source)
    check = lambda *rows, n=nodes: {tuple(r) for r in manifests.seed_faults(make(*rows), fetched, who, n).collect()}
    ann, bo = (" 1 ", "@ANN", "lab", "3", "r"), ("2", "bo", "press", "1.0", "r")
    assert check(ann, bo) == set()
    assert check(("1", "ann", "lab", "x", "r")) == {("ann", "bad_weight")} == check(("1", "ann", "lab", None, "r")) and check(("1", "ann", "lab", "0", "r")) == {("ann", "incomplete")} == check(("1", "ann", " ", "1", "r"))
    assert check(ann, ann) == {("ann", "repeated_source")} and check(ann, ("4", "di", "lab", "1", "r")) == {("ann", "shared_entity"), ("di", "shared_entity")}
    assert check(("3", "cy", "c", "1", "r"), ("9", "no", "c", "1", "r"), ("2", "bob", "c", "1", "r")) == {("cy", "not_complete_and_active"), ("no", "other_identity"), ("bob", "other_identity")}
    assert check(bo, n=nodes.limit(0)) == {("bo", "not_complete_and_active")}
    assert {(r.x_id, r.entity_id, r.weight) for r in manifests.seeds(make(ann, bo), fetched, who, nodes).collect()} == {("1", 10, 0.75), ("2", 20, 0.25)}
    digest = lambda *rows: manifests.seeds_digest(make(*rows)).first()[0]
    assert digest(ann, bo) == digest(("2", "@Bo", "press", "1", "r"), ("1", "ann", "lab", "3.0", "r")) != digest(ann, ann) and len(digest()) == 64
    with pytest.raises(manifests.ManifestFault, match="incomplete"):
        manifests.seeds(make(("1", "ann", "", "1", "r")), fetched, who, nodes)


def test_labs_of_a_repeated_slug_are_told_apart(spark, tmp_path):
    def told(*labs):
        m = read(spark, tmp_path, *[organisation("dup", "Acme", channels=[], merge_handles=[], legacy_lab_slug=x) for x in labs])
        return [t for t in as_set(manifests.registry_faults(m, registry(spark), snapshot(spark))) if t[2].startswith("lab_")]

    assert told("acme-lab", "bo") == []
    assert told("acme-lab", "none") == [("dup", "", "lab_missing")]
