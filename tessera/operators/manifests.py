"""Reviewed manifests as tables: parent organisations with their channels, removals, seeds.

Each manifest is held to all its rules at once, as rows (.., fault), before anything changes; what is applied is a new set of
tables, which ``publication.publish_tables`` replaces together.

Coverage of organisations has three tables, in which ``pos`` and ``place`` are places in the file: organisations (pos, slug, name, reason,
evidence_url, lab_slug), listed (pos, place, slug, kind, key, relationship, evidence_url, expected_x_id, label) and merges (pos, place, slug,
handle, expected_name). The registry has entities (entity_id, kind, slug, name, rejected, notes, updated_at), channels (channel_id, kind, key,
label, last_seen_at), owners (entity_id, channel_id, relationship, confidence, evidence_url, notes), accounts (handle, x_id, display_name, bio,
followers, first_seen_at, last_seen_at), facts (handle, source, fact, value, observed_at, evidence_url), observations (channel_id, source,
metric, value, observed_at, evidence_url) and, if it has any, labs (slug, name, notes). Clocks are texts of one format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.hashing import fingerprint
from tessera.operators import registry as reg
from tessera.operators.network import ranked
from tessera.operators.upserts import pick
from tessera.session import Scratch

#: Fixed values.
COVERAGE_VERSION, SEEDS_VERSION = "organization-coverage-v1", "following-personalization-v1"
CHANNEL_KINDS = ("x", "website", "blog", "github")
RELATIONSHIPS = ("identity", "official")
ENTITY_KINDS = ("person", "organization", "unsure", "unknown")
REVIEWS = (("remove", "model_remove"), ("review", "manual_add_from_review"), ("keep", "manual_override_from_keep"))

COVERAGE = """schema_version string, snapshot struct<snapshot_id: string, cohort_sha256: string, database_sha256: string>,
organizations array<struct<slug: string, name: string, reason: string, evidence_url: string, legacy_lab_slug: string,
  channels: array<struct<kind: string, key: string, relationship: string, evidence_url: string, expected_x_id: string, label: string>>,
  merge_handles: array<struct<handle: string, expected_entity_name: string>>>>"""


def _blank(c: Column | str) -> Column:
    """Null, or without anything but white space."""
    return ~F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).rlike(r"(?U)[^\s\x1c-\x1f]")


def _no_https(c: str) -> Column:
    return ~F.coalesce(F.col(c).startswith("https://"), F.lit(False))


def _bad_slug(c: str) -> Column:
    return ~F.coalesce(F.col(c).rlike(r"\A[a-z0-9-]+\z"), F.lit(False))


def _told(df: DataFrame, keys: list[Column], tests: dict[str, Column]) -> DataFrame:
    """A row (keys, fault) per test that holds."""
    found = F.array_compact(F.array(*[F.when(t, F.lit(f)) for f, t in tests.items()]))
    return df.select(*keys, F.explode(found).alias("fault"))


def _marked(df: DataFrame, keys: list[str], out: str, count: Column | None = None) -> DataFrame:
    """df with ``out``: whether the keys occur more than once (or ``count`` is over one for them). Null keys never do."""
    many = df.groupBy(*keys).agg((F.count("*") if count is None else count).alias("_n")).where("_n > 1").select(*keys, F.lit(True).alias(out))
    return df.join(many, keys, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def read_coverage(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """head, organisations, listed and merges of a JSON file; fields that don't fit are null and told as faults. Numbers are read as texts."""
    whole = spark.read.schema(COVERAGE).option("multiLine", True).json(path)
    org = whole.select(F.posexplode("organizations").alias("pos", "o"))
    at = [F.col("pos"), F.col("o.slug").alias("slug")]
    listed = org.select(*at, F.posexplode("o.channels").alias("place", "c")).select("pos", "place", "slug", "c.*")
    merges = org.select(*at, F.posexplode("o.merge_handles").alias("place", "m")).select("pos", "place", "slug", "m.handle", F.col("m.expected_entity_name").alias("expected_name"))
    return {
        "head": whole.select("schema_version", "snapshot.*"),
        "organisations": org.select(*at, "o.name", "o.reason", "o.evidence_url", F.col("o.legacy_lab_slug").alias("lab_slug")),
        "listed": listed,
        "merges": merges,
    }


def _normal(m: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The manifest with keys and handles as the registry has them."""
    handle = F.lower(F.regexp_replace("handle", "^@", ""))
    return m | {"listed": m["listed"].withColumn("key", reg.channel_key(F.col("kind"), F.col("key"))), "merges": m["merges"].withColumn("handle", handle)}


def _items(m: dict[str, DataFrame]) -> tuple[list[Column], list[Column], list[Column]]:
    slug = F.col("slug")
    org = [slug, F.lit("").alias("item")]
    channel = [slug, F.concat(F.coalesce("kind", F.lit("")), F.lit(":"), F.coalesce("key", F.lit(""))).alias("item")]
    merge = [slug, F.concat(F.lit("@"), F.coalesce("handle", F.lit(""))).alias("item")]
    return org, channel, merge


def head_faults(head: DataFrame, runs: DataFrame, digest: str) -> DataFrame:
    """(slug, item, fault) with empty slug: what keeps a coverage manifest from the snapshot that it names.

    head: schema_version, snapshot_id, cohort_sha256, database_sha256. runs: snapshot_id, cohort_sha256, status, of the snapshot at hand. digest: of its
    file (``readers.snapshot_files``).
    """
    run = runs.agg(F.max(F.struct("snapshot_id", "cohort_sha256", "status")).alias("_r"))
    one = head.limit(1).withColumn("_k", F.lit(1)).join(run.withColumn("_k", F.lit(1)), "_k", "full_outer")
    tests = {
        "unsupported_version": ~F.equal_null("schema_version", F.lit(COVERAGE_VERSION)),
        "no_snapshot": _blank("snapshot_id") | _blank("cohort_sha256") | _blank("database_sha256"),
        "other_database": ~F.equal_null("database_sha256", F.lit(digest)),
        "snapshot_not_complete": ~F.equal_null(F.col("_r.status"), F.lit("complete")),
        "other_snapshot": ~F.equal_null("snapshot_id", F.col("_r.snapshot_id")),
        "other_cohort": ~F.equal_null("cohort_sha256", F.col("_r.cohort_sha256")),
    }
    return _told(one, [F.lit("").alias("slug"), F.lit("").alias("item")], tests)


def form_faults(manifest: dict[str, DataFrame]) -> DataFrame:
    """(slug, item, fault): what is wrong with a coverage manifest by itself; item is empty, kind:key of a channel, or @handle of a merge.

    A handle may be listed once in all; another key may be listed by one organisation.
    """
    m = _normal(manifest)
    by_org, by_channel, by_merge = _items(m)
    org = _marked(m["organisations"], ["slug"], "_twice").join(m["listed"].select("pos", F.lit(True).alias("_any")).distinct(), "pos", "left")
    orgs = {
        "bad_slug": _bad_slug("slug"),
        "repeated_slug": F.col("_twice"),
        "no_name": _blank("name"),
        "no_reason": _blank("reason"),
        "no_https_evidence": _no_https("evidence_url"),
        "no_channels": F.col("_any").isNull(),
        "bad_lab_slug": F.col("lab_slug").isNotNull() & (_bad_slug("lab_slug") | F.equal_null("lab_slug", "slug")),
    }
    x = F.equal_null("kind", F.lit("x"))
    listed = _marked(_marked(m["listed"], ["kind", "key"], "_twice"), ["kind", "key"], "_shared", F.count_distinct("pos"))
    channels = {
        "bad_kind": ~F.coalesce(F.col("kind").isin(*CHANNEL_KINDS), F.lit(False)),
        "no_key": _blank("key"),
        "bad_relationship": ~F.coalesce(F.col("relationship").isin(*RELATIONSHIPS), F.lit(False)),
        "no_https_evidence": _no_https("evidence_url"),
        "no_x_id": x & _blank("expected_x_id"),
        "repeated_handle": x & F.col("_twice"),
        "key_not_https": F.col("kind").isin("website", "blog") & _no_https("key"),
        "claimed_twice": ~x & F.col("_shared"),
    }
    own = m["listed"].where("kind = 'x'").select("pos", F.col("key").alias("handle"), F.lit(True).alias("_own")).distinct()
    merges = {"no_handle": _blank("handle"), "not_a_channel": F.col("_own").isNull(), "repeated_merge": F.col("_twice"), "no_expected_name": _blank("expected_name")}
    merged = _marked(m["merges"], ["pos", "handle"], "_twice").join(own, ["pos", "handle"], "left")
    return _told(org, by_org, orgs).unionByName(_told(listed, by_channel, channels)).unionByName(_told(merged, by_merge, merges)).distinct()


def _owned(registry: dict[str, DataFrame]) -> DataFrame:
    """(kind, _low, channel_id, entity_id, _kind, _name, _rejected): owned channels by lower-case key."""
    e = registry["entities"].select("entity_id", F.col("kind").alias("_kind"), F.col("name").alias("_name"), F.coalesce("rejected", F.lit(False)).alias("_rejected"))
    ch = registry["channels"].select("channel_id", "kind", F.lower("key").alias("_low"))
    return ch.join(registry["owners"].select("channel_id", "entity_id").distinct(), "channel_id").join(e, "entity_id")


def _members(m: dict[str, DataFrame], registry: dict[str, DataFrame]) -> DataFrame:
    """merges with the entities that own their handles, and the entity of their slug (canonical_id) if there is one."""
    who = _owned(registry).where("kind = 'x'").select(F.col("_low").alias("handle"), "entity_id", "_kind", "_name", "_rejected").distinct()
    canon = registry["entities"].select("slug", F.col("entity_id").alias("canonical_id"))
    return m["merges"].join(who, "handle", "left").join(canon, "slug", "left")


def _observed(accounts: DataFrame) -> DataFrame:
    """Accounts of a snapshot by lower-case handle; of repeated handles that of the least x_id."""
    a = accounts.withColumn("x_id", F.col("x_id").cast("string")).withColumn("key", F.lower("handle"))
    return a.groupBy("key").agg(F.min_by(F.struct(*[c for c in a.columns if c != "key"]), "x_id").alias("_a")).select("key", "_a.*")


def registry_faults(manifest: dict[str, DataFrame], registry: dict[str, DataFrame], accounts: DataFrame) -> DataFrame:
    """(slug, item, fault): what keeps a coverage manifest from being applied to a registry and a snapshot.

    accounts: x_id, handle of the snapshot. An organisation that the registry has must be an organisation of that name and not rejected; so must
    what is merged into it. A channel belongs to nobody, to the organisation, or to what is merged into it. Handles and ids
    must be those of the snapshot, and of no other account. What is merged goes into one organisation and is none of the organisations named.
    """
    m = _normal(manifest)
    by_org, by_channel, by_merge = _items(m)
    e = registry["entities"]
    canon = e.select("slug", F.col("entity_id").alias("_id"), F.col("kind").alias("_kind"), F.col("name").alias("_name"), F.coalesce("rejected", F.lit(False)).alias("_rejected"))
    org = m["organisations"].join(canon, "slug", "inner")
    out = _told(org, by_org, {"canonical_kind": ~F.equal_null("_kind", F.lit("organization")), "canonical_name": ~F.equal_null("_name", "name"), "canonical_rejected": F.col("_rejected")})

    named = org.select(F.col("_id").alias("entity_id"), F.lit(True).alias("_named")).distinct()
    found = _members(m, registry).join(named, "entity_id", "left")
    found = _marked(_marked(found, ["pos", "handle"], "_many", F.count_distinct("entity_id")), ["entity_id"], "_shared", F.count_distinct("slug"))
    other = F.col("entity_id").isNotNull() & ~F.equal_null("entity_id", "canonical_id")
    merges = {
        "no_entity": F.col("entity_id").isNull(),
        "several_entities": F.col("_many"),
        "member_kind": other & ~F.equal_null("_kind", F.lit("organization")),
        "member_name": other & ~F.equal_null("_name", "expected_name"),
        "member_rejected": other & F.col("_rejected"),
        "member_shared": other & F.col("_shared"),
        "member_named": other & F.coalesce("_named", F.lit(False)),
    }
    out = out.unionByName(_told(found, by_merge, merges))

    x = m["listed"].where("kind = 'x'")
    seen = _observed(accounts).select("key", F.col("x_id").alias("_x"))
    have = registry["accounts"].select(F.lower("handle").alias("key"), F.col("x_id").cast("string").alias("_had"), F.lit(True).alias("_is"))
    holder = registry["accounts"].select(F.col("x_id").cast("string").alias("_x"), F.lower("handle").alias("_holder")).distinct()
    j = x.join(seen, "key", "left").join(have, "key", "left").join(holder, "_x", "left")
    known = F.col("_x").isNotNull()
    listed = {
        "not_in_snapshot": ~known,
        "other_x_id": known & ~F.equal_null("_x", "expected_x_id"),
        "registry_x_id": known & F.col("_is") & ~F.equal_null("_had", "_x"),
        "taken_x_id": known & (F.col("_holder") != F.col("key")),
    }
    out = out.unionByName(_told(j, by_channel, listed))

    ours = found.select("pos", "entity_id", F.lit(True).alias("_ours")).where("entity_id is not null").distinct()
    own = m["listed"].withColumn("_low", F.lower("key")).join(_owned(registry).drop("channel_id").distinct(), ["kind", "_low"]).join(e.select("slug", F.col("entity_id").alias("_id")), "slug", "left").join(ours, ["pos", "entity_id"], "left")
    owners = {"owner_rejected": F.col("_rejected"), "other_owner": ~F.col("_rejected") & ~F.equal_null("entity_id", "_id") & F.col("_ours").isNull()}
    out = out.unionByName(_told(own, by_channel, owners))

    if "labs" in registry:
        names = m["organisations"].where("lab_slug is not null").select("pos", "slug", F.explode(F.array("lab_slug", "slug")).alias("_s"))
        n = names.join(registry["labs"].select(F.col("slug").alias("_s"), F.lit(1).alias("_l")).distinct(), "_s", "left").groupBy("pos", "slug").agg(F.count("_l").alias("_n"))
        out = out.unionByName(_told(n, by_org, {"lab_missing": F.col("_n") == 0, "lab_twice": F.col("_n") > 1}))
    return out.distinct()


class ManifestFault(ValueError):
    """A manifest has faults; nothing was changed."""


def _refuse(faults: DataFrame) -> None:
    some = faults.limit(5).collect()
    if some:
        raise ManifestFault("the manifest cannot be applied: " + "; ".join(" ".join(str(v) for v in r if v not in (None, "")) for r in some))


def _numbered(new: DataFrame, order: list[str], ids: DataFrame, column: str) -> DataFrame:
    """new with ``column``: numbers above all of ids, in order."""
    top = ids.agg(F.coalesce(F.max(column), F.lit(0)).cast("long").alias("_top")).first()[0]
    return ranked(new, [F.asc(c) for c in order], "_place").withColumn(column, F.col("_place") + F.lit(top)).drop("_place")


def _put(table: DataFrame, rows: DataFrame, keys: list[str], kept: tuple[str, ...] = ()) -> DataFrame:
    """table with rows put in by their keys: columns that rows lack, or ``kept`` where they are null in rows, stay as they were."""
    news = [c for c in rows.columns if c not in keys]
    r = rows.select(*keys, *[F.col(c).alias(f"_{c}") for c in news], F.lit(True).alias("_new"))
    value = lambda c: F.when(F.col("_new"), F.coalesce(f"_{c}", c) if c in kept else F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return table.join(r, keys, "full_outer").select(*[value(c) if c in news else F.col(c) for c in table.columns])


def apply_coverage(spark: SparkSession, manifest: dict[str, DataFrame], registry: dict[str, DataFrame], accounts: DataFrame, observed_at: str) -> dict[str, DataFrame]:
    """All tables of the registry after a coverage manifest, ``audit`` of merges, and ``counts`` (what, n); ManifestFault if it has faults.

    Organisations that the registry lacks are made, accounts of listed handles come from the snapshot (the first day seen is the earlier, the last
    the later), what is merged leaves its channels to the organisation, and each listed channel is the organisation's with the manifest's relationship and
    evidence. Of a key that an organisation lists twice the last counts. Applied again, the same manifest changes nothing. ``head_faults`` is the caller's, who has the file.
    accounts: x_id, handle, display_name, bio, followers, first_observed_at, last_observed_at.
    """
    m = _normal(manifest)
    _refuse(form_faults(m))
    _refuse(registry_faults(m, registry, accounts))
    source = F.concat(F.lit("following-snapshot:"), F.lit(m["head"].first()["snapshot_id"]))
    org = m["organisations"]

    entities = registry["entities"]
    fresh = _numbered(org.join(entities, "slug", "left_anti").select("slug", "name", F.col("reason").alias("notes")), ["slug"], entities, "entity_id")
    fresh = fresh.withColumns({"kind": F.lit("organization"), "rejected": F.lit(False), "updated_at": F.lit(observed_at)})
    entities = entities.unionByName(fresh.select(*[F.col(c) if c in fresh.columns else F.lit(None).alias(c) for c in entities.columns]))
    canon = entities.select("slug", F.col("entity_id").alias("canonical_id"))

    found = _members(m, registry).drop("canonical_id").join(canon, "slug").select("slug", "canonical_id", F.col("entity_id").alias("duplicate_id")).distinct()
    scratch = Scratch(spark)
    merges = found.where("canonical_id <> duplicate_id").join(org.select("slug", "reason", "evidence_url"), "slug").withColumn("source", F.lit("organization-coverage-manifest"))
    merges = scratch.write(merges, "merges")
    merged = reg.merge_entities(spark, entities, registry["owners"], merges.drop("slug"), observed_at)

    seen = scratch.write(m["listed"].where("kind = 'x'").select("slug", "key").join(_observed(accounts), "key"), "seen")
    listed = pick(m["listed"], ["kind", "key"], [F.desc("place")]).join(seen.select("slug", "key", F.lit("x").alias("kind"), "display_name", "last_observed_at"), ["slug", "kind", "key"], "left")
    rows = listed.select("slug", "kind", "key", "relationship", "evidence_url", F.coalesce("display_name", "label").alias("label"), F.coalesce("last_observed_at", F.lit(observed_at)).alias("last_seen_at"))
    had = registry["channels"].select("kind", "key", "channel_id")
    new = _numbered(rows.join(had, ["kind", "key"], "left_anti").select("kind", "key"), ["kind", "key"], had, "channel_id")
    rows = scratch.write(rows.join(had.unionByName(new), ["kind", "key"]).join(canon, "slug").join(org.select("slug", F.col("reason").alias("notes")), "slug"), "rows")
    was = registry["channels"].select("channel_id", F.col("last_seen_at").alias("_was"))
    put = rows.join(was, "channel_id", "left").select("channel_id", "kind", "key", F.nullif("label", F.lit("")).alias("label"), F.greatest("last_seen_at", "_was").alias("last_seen_at"))
    channels = _put(registry["channels"], put, ["channel_id", "kind", "key"], ("label",))

    claims = rows.select("channel_id", F.col("canonical_id").alias("entity_id"), "relationship", F.lit(1.0).alias("confidence"), "evidence_url", "notes")
    owners = _put(merged["channels"], claims, ["channel_id"])
    linked = claims.join(merged["channels"].select("channel_id", F.col("entity_id").alias("_had")).distinct(), "channel_id", "left").where("not (entity_id <=> _had)")

    old = registry["accounts"].select(F.lower("handle").alias("key"), F.col("first_seen_at").alias("_first"), F.col("last_seen_at").alias("_last"), F.lit(True).alias("_old"))
    upserted = seen.join(old, "key", "left")
    account = upserted.select(F.col("key").alias("handle"), "x_id", "display_name", "bio", "followers", F.least("first_observed_at", "_first").alias("first_seen_at"), F.greatest("last_observed_at", "_last").alias("last_seen_at"))
    url = F.concat(F.lit("https://x.com/"), "key").alias("evidence_url")
    fact = seen.select(F.col("key").alias("handle"), source.alias("source"), F.lit("organization_coverage").alias("fact"), F.col("slug").alias("value"), F.col("last_observed_at").alias("observed_at"), url)
    told = seen.join(rows.where("kind = 'x'").select("key", "channel_id"), "key")
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f).cast("string").alias("value")) for c, f in (("followers_count", "followers"), ("bio", "bio"))])
    measured = told.select("channel_id", source.alias("source"), F.col("last_observed_at").alias("observed_at"), url, F.inline(pairs)).where("value is not null")

    out = {
        "entities": merged["entities"],
        "channels": channels,
        "owners": owners,
        "accounts": _put(registry["accounts"].withColumn("x_id", F.col("x_id").cast("string")), account, ["handle"]),
        "facts": _put(registry["facts"], fact, ["handle", "source", "fact"]),
        "observations": _put(registry["observations"], measured, ["channel_id", "source", "metric", "observed_at"], ("evidence_url",)),
        "audit": merged["audit"],
    }
    if "labs" in registry:
        labs = registry["labs"]
        moves = org.where("lab_slug is not null").select(F.col("lab_slug").alias("_from"), F.col("slug").alias("_slug"), F.col("name").alias("_name"), F.col("reason").alias("_notes"), F.lit(True).alias("_moved"))
        j = labs.join(moves, labs["slug"] == F.col("_from"), "left")
        out["labs"] = j.select(*[F.when(F.col("_moved"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in ("slug", "name", "notes") else F.col(c) for c in labs.columns])
    n = lambda what, df: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    moved = registry["owners"].join(merges.select(F.col("duplicate_id").alias("entity_id")).distinct(), "entity_id", "left_semi").select("channel_id")
    gone = merges.select("duplicate_id").distinct()
    counts = n("organizations", org).unionByName(n("created_entities", fresh)).unionByName(n("merged_entities", gone)).unionByName(n("imported_accounts", upserted.where("_old is null")))
    counts = counts.unionByName(n("linked_channels", moved.unionByName(linked.select("channel_id"))))
    signed = m["merges"].select(F.lit(1).alias("_v")).unionByName(gone.select(F.lit(-1).alias("_v"))).agg(F.coalesce(F.sum("_v"), F.lit(0)).alias("n"))
    out["counts"] = counts.unionByName(signed.select(F.lit("already_grouped").alias("what"), "n"))
    return out


def removal_faults(removals: DataFrame, registry: dict[str, DataFrame], audit: DataFrame, edges: DataFrame, labs: DataFrame | None = None) -> DataFrame:
    """(entity_id, fault): what keeps reviewed removals from being applied; entities that the registry lacks were removed before.

    removals: entity_id, name, kind, model_decision, review_basis, reason. audit: canonical_id of merges. edges: source, target handles.
    labs: handle. An entity goes only if it is what the manifest says, owns one channel, which is an account's handle, and nothing else rests on it.
    """
    pair = F.lit(False)
    for decision, basis in REVIEWS:
        pair = pair | (F.equal_null("model_decision", F.lit(decision)) & F.equal_null("review_basis", F.lit(basis)))
    form = {
        "no_entity_id": F.col("entity_id").isNull(),
        "repeated_entity": F.col("_twice"),
        "bad_kind": ~F.coalesce(F.col("kind").isin(*ENTITY_KINDS), F.lit(False)),
        "bad_review": ~pair,
        "no_name_or_reason": _blank("name") | _blank("reason"),
    }
    out = _told(_marked(removals, ["entity_id"], "_twice"), [F.col("entity_id")], form)
    e = registry["entities"].select("entity_id", F.col("name").alias("_name"), F.col("kind").alias("_kind"), F.coalesce("rejected", F.lit(False)).alias("_rejected"))
    held = registry["owners"].select("entity_id", "channel_id").distinct().join(registry["channels"].select("channel_id", "kind", "key"), "channel_id")
    j = removals.join(e, "entity_id")
    wanted = held.join(removals.select("entity_id").distinct(), "entity_id", "left_semi")
    one = wanted.groupBy("entity_id").agg(F.count("*").alias("_n"), F.max(F.struct("kind", "key")).alias("_c"))
    mark = lambda df, c, out: df.select(c).distinct().withColumn(out, F.lit(True))
    j = j.join(one, "entity_id", "left").withColumn("_key", F.when((F.col("_n") == 1) & (F.col("_c.kind") == "x"), F.lower("_c.key")))
    j = j.join(mark(audit.select(F.col("canonical_id").alias("entity_id")), "entity_id", "_canonical"), "entity_id", "left")
    j = j.join(mark(registry["accounts"].select(F.lower("handle").alias("_key")), "_key", "_account"), "_key", "left")
    j = j.join(mark(edges.select(F.explode(F.array(F.lower("source"), F.lower("target"))).alias("_key")), "_key", "_edge"), "_key", "left")
    tests = {
        "other_identity": ~F.equal_null("_name", "name") | ~F.equal_null("_kind", "kind"),
        "rejected": F.col("_rejected"),
        "merge_canonical": F.col("_canonical"),
        "not_one_handle": F.col("_key").isNull(),
        "no_account": F.col("_key").isNotNull() & F.col("_account").isNull(),
        "in_graph": F.col("_account") & F.col("_edge"),
    }
    if labs is not None:
        j = j.join(mark(labs.select(F.lower("handle").alias("_key")), "_key", "_lab"), "_key", "left")
        tests["seeded_lab"] = F.col("_account") & F.col("_lab")
    return out.unionByName(_told(j, [F.col("entity_id")], tests)).distinct()


def apply_removals(removals: DataFrame, registry: dict[str, DataFrame], audit: DataFrame, edges: DataFrame, labs: DataFrame | None = None) -> dict[str, DataFrame]:
    """entities, channels, owners, accounts and facts without what was removed, and ``counts`` (what, n); ManifestFault if any removal has a fault."""
    _refuse(removal_faults(removals, registry, audit, edges, labs))
    gone = removals.join(registry["entities"].select("entity_id"), "entity_id", "left_semi").select("entity_id")
    channel = registry["owners"].join(gone, "entity_id", "left_semi").select("channel_id").distinct()
    handle = registry["channels"].join(channel, "channel_id", "left_semi").select(F.lower("key").alias("_key")).distinct()
    without = lambda name: registry[name].withColumn("_key", F.lower("handle")).join(handle, "_key", "left_anti").select(*registry[name].columns)
    n = lambda what, df: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    accounts = registry["accounts"].withColumn("_key", F.lower("handle")).join(handle, "_key", "left_semi")
    lost = removals.join(registry["entities"].select("entity_id"), "entity_id", "left_anti")
    counts = n("requested", removals).unionByName(n("removed_entities", gone)).unionByName(n("removed_channels", channel)).unionByName(n("removed_accounts", accounts)).unionByName(n("already_removed", lost))
    return {
        "entities": registry["entities"].join(gone, "entity_id", "left_anti"),
        "channels": registry["channels"].join(channel, "channel_id", "left_anti"),
        "owners": registry["owners"].join(gone, "entity_id", "left_anti"),
        "accounts": without("accounts"),
        "facts": without("facts"),
        "counts": counts,
    }


def _sources(sources: DataFrame) -> DataFrame:
    bare = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    weight = F.expr("try_cast(weight AS double)")
    return sources.select(bare("x_id").alias("x_id"), F.lower(F.regexp_replace(bare("handle"), "^@", "")).alias("handle"), bare("category").alias("category"), bare("reason").alias("reason"), weight.alias("weight"))


def seed_faults(sources: DataFrame, fetched: DataFrame, identities: DataFrame, nodes: DataFrame) -> DataFrame:
    """(handle, fault): what keeps the sources of a personalised rank from being used.

    sources: x_id, handle, category, weight (number or text), reason. fetched: x_id, handle, status of the snapshot. identities: x_id, entity_id, state.
    nodes: x_id of the graph. Every source is fetched completely, active, in the graph, and the only one of its entity.
    """
    s = _marked(_marked(_sources(sources), ["x_id"], "_twice"), ["handle"], "_again")
    bad = F.col("weight").isNull() | F.isnan("weight")
    form = {
        "bad_weight": bad,
        "incomplete": _blank("x_id") | _blank("handle") | _blank("reason") | _blank("category") | F.coalesce(F.col("weight") <= 0, F.lit(False)),
        "repeated_source": F.col("_twice") | F.col("_again"),
    }
    got = fetched.select(F.col("x_id").cast("string").alias("x_id"), F.lower("handle").alias("_handle"), "status")
    who = identities.select(F.col("x_id").cast("string").alias("x_id"), "entity_id", "state")
    node = nodes.select(F.col("x_id").cast("string").alias("x_id"), F.lit(True).alias("_node")).distinct()
    j = _marked(s.join(got, "x_id", "left").join(who, "x_id", "left").join(node, "x_id", "left"), ["entity_id"], "_shared", F.count_distinct("x_id"))
    same = F.equal_null("_handle", "handle")
    tests = {
        "other_identity": ~same,
        "not_complete_and_active": same & ~(F.equal_null("status", F.lit("complete")) & F.equal_null("state", F.lit("active")) & F.col("_node").isNotNull()),
        "shared_entity": F.col("_shared"),
    }
    return _told(s, [F.col("handle")], form).unionByName(_told(j, [F.col("handle")], tests)).distinct()


def seeds(sources: DataFrame, fetched: DataFrame, identities: DataFrame, nodes: DataFrame) -> DataFrame:
    """(x_id, handle, entity_id, category, reason, weight): sources with weights that add up to 1, for ``pagerank``; ManifestFault if any has a fault."""
    _refuse(seed_faults(sources, fetched, identities, nodes))
    s = _sources(sources)
    total = s.agg(F.sum("weight")).first()[0]
    who = identities.select(F.col("x_id").cast("string").alias("x_id"), "entity_id")
    return s.join(who, "x_id").select("x_id", "handle", "entity_id", "category", "reason", (F.col("weight") / F.lit(total)).alias("weight"))


def seeds_digest(sources: DataFrame) -> DataFrame:
    """One row (fingerprint) of the sources as used, free of their order."""
    s = _sources(sources)
    return s.agg(fingerprint(s, *s.columns).alias("fingerprint"))
