"""Registry: entities, their channels, rejections, and views over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions import text
from tessera.operators.events import roots
from tessera.operators.network import ranked
from tessera.operators.upserts import pick
from tessera.session import Scratch


def identities(accounts: DataFrame, channels: DataFrame, owners: DataFrame, entities: DataFrame, rejections: DataFrame) -> DataFrame:
    """(x_id, handle, entity_id, name, kind, state): accounts with the entity that owns their channel.

    Accounts and channels meet by lower-case handle; state is active, rejected, or unknown without
    an entity.
    """
    ch = channels.join(owners, "channel_id").select(F.lower("channel_key").alias("_h"), "entity_id").distinct()
    e = entities.join(rejections.select("entity_id", F.lit(True).alias("_r")).distinct(), "entity_id", "left")
    j = accounts.withColumn("_h", F.lower("handle")).join(ch, "_h", "left").join(e, "entity_id", "left")
    return j.select("x_id", "handle", "entity_id", "name", "kind", F.when(F.col("entity_id").isNull(), "unknown").when(F.col("_r"), "rejected").otherwise("active").alias("state"))


def lookup(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """rows (x_id, handle) with entity_id by id, else by lower-case handle; of repeated handles the greatest x_id counts."""
    by_id = accounts.groupBy("x_id").agg(F.max("entity_id").alias("_i"))
    by_handle = accounts.where("handle is not null").groupBy(F.lower("handle").alias("_h")).agg(F.max_by("entity_id", "x_id").alias("_e"))
    j = rows.withColumn("_h", F.lower("handle")).join(by_id, "x_id", "left").join(by_handle, "_h", "left")
    return j.select(*rows.columns, F.coalesce("_i", "_e").alias("entity_id"))


def representative_channel(channels: DataFrame) -> DataFrame:
    """One channel per entity: key equal to the slug, then shown name (else label) equal to the name, both in any case, then followers (none: 0), then key.

    channels: entity_id, slug, name, channel_key, display_name, label, followers.
    """
    shown = F.lower(F.coalesce("display_name", "label", F.lit("")))
    return pick(channels, ["entity_id"], [F.desc(F.lower("channel_key") == F.lower("slug")), F.desc(shown == F.lower("name")), F.desc(F.coalesce("followers", F.lit(0))), F.asc("channel_key")])


def reach_rank(entities: DataFrame) -> DataFrame:
    """entities with reach_rank (null without followers) and total. entities: entity_id, name, followers."""
    n = entities.agg(F.count("*").alias("total"))
    placed = ranked(entities, [F.desc_nulls_last("followers"), F.lower("name").asc(), F.asc("entity_id")], "_place")
    return placed.join(F.broadcast(n)).withColumn("reach_rank", F.when(F.col("followers").isNotNull(), F.col("_place"))).drop("_place")


def kind_counts(entities: DataFrame, kinds: list[str]) -> DataFrame:
    """(kind, n) for all kinds and rejected, which overrides the kind; missing ones at 0."""
    g = entities.groupBy(F.when(F.col("rejected"), "rejected").otherwise(F.col("kind")).alias("kind")).agg(F.count("*").alias("n"))
    dims = entities.sparkSession.createDataFrame([(k,) for k in [*kinds, "rejected"]], "kind string")
    return dims.join(F.broadcast(g), "kind", "left").fillna(0, ["n"])


def latest_of(entities: DataFrame, facts: DataFrame, value: str, clock: str, tie: str) -> DataFrame:
    """entities with the latest value of their facts: one aggregate, not one subquery per row."""
    f = facts.groupBy("entity_id").agg(F.max_by(value, F.struct(clock, tie)).alias(value))
    return entities.join(f, "entity_id", "left")


def total_followers(owners: DataFrame, channels: DataFrame) -> DataFrame:
    """(entity_id, followers): sum over distinct channels."""
    return owners.select("entity_id", "channel_id").distinct().join(channels, "channel_id").groupBy("entity_id").agg(F.sum("followers").alias("followers"))


def search(entities: DataFrame, needle: str, group: str = "all") -> DataFrame:
    """Entities of a group (all, rejected, or a kind) whose name holds the needle; % and _ are wildcards here."""
    where = F.lower("name").like(f"%{needle.lower()}%")
    if group == "rejected":
        where = where & F.col("rejected")
    elif group != "all":
        where = where & ~F.col("rejected") & (F.col("kind") == group)
    else:
        where = where & ~F.col("rejected")
    return entities.where(where)


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of all rows in an order, with the number of rows before paging."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.join(F.broadcast(total)).orderBy(*order).offset(offset).limit(limit)


def several_owners(owners: DataFrame) -> DataFrame:
    """(channel_id, owners): channels with more than one owner; has to be empty."""
    return owners.groupBy("channel_id").agg(F.count_distinct("entity_id").alias("owners")).where("owners > 1")


def newest_facts(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, deleted): the newest fact per entity and name stays. facts: entity_id, fact, observed_at, fact_id."""
    w = W.partitionBy("entity_id", "fact").orderBy(F.desc("observed_at"), F.desc("fact_id"))
    r = facts.withColumn("_k", F.row_number().over(w))
    return r.where("_k = 1").drop("_k"), r.where("_k > 1").drop("_k")


def to_facts(accounts: DataFrame, columns: list[str]) -> DataFrame:
    """(x_id, fact, value): one row per column that isn't null."""
    return accounts.unpivot(["x_id"], [F.col(c).cast("string").alias(c) for c in columns], "fact", "value").where("value is not null")


def unlinked(accounts: DataFrame, channels: DataFrame) -> DataFrame:
    """Accounts that no channel names, as provisional entities."""
    return accounts.withColumn("_h", F.lower("handle")).join(channels.select(F.lower("channel_key").alias("_h")).distinct(), "_h", "left_anti").select("x_id", "handle", F.concat(F.lit("provisional:"), F.lower("handle")).alias("entity_id"))


def claim(owners: DataFrame, entities: DataFrame, claims: DataFrame) -> DataFrame:
    """Owners after claims (channel_id, entity_id): a channel moves only from an unknown entity that has no other channel.

    Of several claims on a channel the least entity wins; channels without an owner are taken.
    """
    own = owners.withColumn("_n", F.count("*").over(W.partitionBy("entity_id"))).join(entities.select("entity_id", (F.col("kind") == "unknown").alias("_u")), "entity_id", "left")
    want = claims.groupBy("channel_id").agg(F.min("entity_id").alias("_c"))
    j = own.join(want, "channel_id", "full_outer")
    free = F.col("entity_id").isNull() | (F.coalesce("_u", F.lit(False)) & (F.col("_n") == 1))
    return j.select("channel_id", F.when(F.col("_c").isNotNull() & free, F.col("_c")).otherwise(F.col("entity_id")).alias("entity_id"))


MERGE_FAULTS = ("same_entity", "unknown_canonical", "unknown_duplicate", "other_kind", "several_canonicals", "partial_audit")


def merge_faults(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """(duplicate_id, fault): what keeps merges from being applied.

    entities: entity_id, kind. merges: canonical_id, duplicate_id, reason, source, evidence_url; the last three are given together or not at all.
    """
    kind = lambda c: entities.select(F.col("entity_id").alias(f"{c}_id"), F.col("kind").alias(f"_{c}"))
    given = [F.col(c).isNotNull().cast("int") for c in ("reason", "source", "evidence_url")]
    n = F.count_distinct("canonical_id").alias("_n")
    j = merges.join(kind("canonical"), "canonical_id", "left").join(kind("duplicate"), "duplicate_id", "left").join(merges.groupBy("duplicate_id").agg(n), "duplicate_id")
    tests = (F.col("canonical_id") == F.col("duplicate_id"), F.col("_canonical").isNull(), F.col("_duplicate").isNull(), F.col("_canonical") != F.col("_duplicate"), F.col("_n") > 1, (given[0] + given[1] + given[2]).isin(1, 2))
    found = F.array_compact(F.array(*[F.when(t, f) for t, f in zip(tests, MERGE_FAULTS, strict=True)]))
    return j.select("duplicate_id", F.explode(found).alias("fault")).distinct()


def merge_entities(spark: SparkSession, entities: DataFrame, channels: DataFrame, merges: DataFrame, merged_at: str) -> dict[str, DataFrame]:
    """entities, channels and audit after all merges, or ValueError (a fault) or BrokenForest (a circle), and nothing is changed.

    entities: entity_id, kind, slug, name, updated_at and others; channels: entity_id and others. A duplicate goes and its channels move to
    the entity that it is merged into; where that is a duplicate, too, they go on to the one that stays, by pointer
    doubling, however long the chain and whatever the order of merges. The one that stays is what merges declare, not the
    least. Those that take something in are updated. audit has a row per merge that gives its reason: the canonical entity named, and
    the id, slug, name and kind of what was removed.
    """
    found = {r.fault for r in merge_faults(entities, merges).select("fault").distinct().collect()}
    if found:
        raise ValueError(f"entities cannot be merged: {next(f for f in MERGE_FAULTS if f in found)}")
    ends = roots(spark, merges.select(F.col("duplicate_id").alias("source_id"), F.col("canonical_id").alias("target_id")).distinct()).where("depth > 0")
    ends = Scratch(spark).write(ends.select(F.col("node").alias("entity_id"), F.col("root").alias("_to")), "survivors")
    gone, kept = ends.select("entity_id"), ends.select(F.col("_to").alias("entity_id")).distinct().withColumn("_took", F.lit(True))
    left = entities.join(gone, "entity_id", "left_anti").join(kept, "entity_id", "left")
    fresh = F.when(F.col("_took"), F.lit(merged_at)).otherwise(F.col("updated_at")).alias("updated_at")
    removed = entities.select(F.col("entity_id").alias("duplicate_id"), *[F.col(c).alias(f"removed_{c}") for c in ("slug", "name", "kind")])
    audit = merges.where("reason is not null").distinct().join(removed, "duplicate_id").withColumn("merged_at", F.lit(merged_at))
    moved = channels.join(ends, "entity_id", "left")
    return {
        "entities": left.select(*[fresh if c == "updated_at" else F.col(c) for c in entities.columns]),
        "channels": moved.select(*[F.coalesce("_to", "entity_id").alias(c) if c == "entity_id" else F.col(c) for c in channels.columns]),
        "audit": audit,
    }


def apply_manifest(entities: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rename and re-kind by a manifest (entity_id, name, kind); nothing changes unless every row is good.

    Raises if the manifest names an entity twice, one that doesn't exist, or an empty name.
    """
    bad = manifest.groupBy("entity_id").agg(F.count("*").alias("n"), F.max(F.coalesce(F.trim("name") == "", F.lit(False))).alias("e")).join(entities.select("entity_id", F.lit(True).alias("_x")), "entity_id", "left").where("n > 1 or e or _x is null")
    if bad.limit(1).count():
        raise ValueError("the manifest has rows that cannot be applied")
    m = manifest.select("entity_id", F.col("name").alias("_n"), F.col("kind").alias("_k"))
    j = entities.join(m, "entity_id", "left")
    return j.select(*[F.coalesce("_n", "name").alias(c) if c == "name" else F.coalesce("_k", "kind").alias(c) if c == "kind" else F.col(c) for c in entities.columns])


def ambiguous_names(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, company, matches): companies by name, ticker or alias, case-folded; company is null unless exactly one matches.

    names: company, name.
    """
    n = names.select("company", F.lower("name").alias("_n")).distinct()
    return wanted.select("name", F.lower("name").alias("_n")).distinct().join(n, "_n", "left").groupBy("name").agg(F.when(F.count_distinct("company") == 1, F.max("company")).alias("company"), F.count_distinct("company").alias("matches"))


PROTECTED = ("protected", "isProtected", "isPrivate", "private")


def admission(profiles: DataFrame, floor: int) -> DataFrame:
    """profiles with outcome and reason: too few followers first, then protected accounts; a missing count is told apart.

    profiles: followers and the provider's flags, as far as it has them.
    """
    flags = [F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in PROTECTED if c in profiles.columns]
    hidden = F.lit(False)
    for f in flags:
        hidden = hidden | f
    reason = F.when(F.col("followers").isNull(), "follower_count_missing").when(F.col("followers") < floor, "below_follower_floor").when(hidden, "protected_account")
    return profiles.withColumns({"reason": reason, "outcome": F.when(reason.isNull(), "admitted").when(reason == "follower_count_missing", "failed").otherwise("rejected")})


def channel_key(kind: Column, value: Column) -> Column:
    """The key of a channel: handles without @ or address in lower case, other values as they are."""
    t = F.trim(value)
    bare = F.lower(F.regexp_replace(F.regexp_replace(t, "^@", ""), "^https://github[.]com/", ""))
    return F.when(kind.isin("x", "github"), bare).otherwise(t)


def channel_url(kind: Column, key: Column) -> Column:
    """The address of a channel, null for kinds without one."""
    return F.when(kind == "x", F.concat(F.lit("https://x.com/"), key)).when(kind == "github", F.concat(F.lit("https://github.com/"), key)).when(kind.isin("blog", "website"), key)


def unique_slugs(named: DataFrame, order: str, kind: str, key: str, taken: DataFrame | None = None) -> DataFrame:
    """named with slug: the kind and the readable key; where that is taken (slug), or another row before by ``order`` has it, cut and with a digest of kind and key behind it."""
    s = named.withColumn("slug", text.slug(F.col(kind), F.col(key)))
    first = s.groupBy("slug").agg(F.min(order).alias("_first"))
    if taken is not None:
        first = first.join(taken.select("slug", F.lit(True).alias("_t")).distinct(), "slug", "left")
    else:
        first = first.withColumn("_t", F.lit(None).cast("boolean"))
    tail = F.substring(F.sha2(F.concat_ws(":", kind, key).cast("binary"), 256), 1, 10)
    clash = F.col("_t").isNotNull() | (F.col(order) != F.col("_first"))
    return s.join(first, "slug").withColumn("slug", F.when(clash, F.concat(F.substring("slug", 1, 69), F.lit("-"), tail)).otherwise(F.col("slug"))).drop("_first", "_t")


def promote(entities: DataFrame, results: DataFrame, contract: str) -> DataFrame:
    """entities with the kinds that results give to all unknown ones; raises if one of them has no result for its present input.

    entities: entity_id, kind, input_sha256. results: entity_id, input_sha256, contract, kind,
    finished_at, run_id. The last result counts.
    """
    unknown = entities.where("kind = 'unknown'").select("entity_id", "input_sha256")
    own = results.where(F.col("contract") == contract).join(unknown, ["entity_id", "input_sha256"], "left_semi")
    last = own.groupBy("entity_id").agg(F.max_by("kind", F.struct("finished_at", "run_id")).alias("_kind"))
    if unknown.join(last, "entity_id", "left_anti").limit(1).count():
        raise ValueError("an unknown entity has no result for its present input")
    j = entities.join(last, "entity_id", "left")
    return j.select(*[F.coalesce("_kind", "kind").alias(c) if c == "kind" else F.col(c) for c in entities.columns])


def group_faults(manifest: DataFrame, entities: DataFrame) -> DataFrame:
    """(group_id, fault): what keeps a manifest of groups (group_id, name, member) from being applied: unknown or repeated members, empty or several names."""
    g = manifest.groupBy("group_id").agg(F.count_distinct("name").alias("_names"), F.bool_or(F.coalesce(F.trim("name"), F.lit("")) == "").alias("_empty"))
    named = g.select("group_id", F.explode(F.array_compact(F.array(F.when(F.col("_names") > 1, "several_names"), F.when(F.col("_empty"), "empty_name")))).alias("fault"))
    lost = manifest.join(entities.select(F.col("entity_id").alias("member")), "member", "left_anti").select("group_id", F.lit("unknown_member").alias("fault"))
    twice = manifest.groupBy("member").agg(F.count("*").alias("n"), F.min("group_id").alias("group_id")).where("n > 1").select("group_id", F.lit("repeated_member").alias("fault"))
    return named.unionByName(lost).unionByName(twice).distinct()


def apply_groups(entities: DataFrame, manifest: DataFrame) -> DataFrame:
    """entities with group_id and group_name of a manifest that is sound as a whole; otherwise raises and nothing is changed."""
    if group_faults(manifest, entities).limit(1).count():
        raise ValueError("the manifest of groups is not sound")
    return entities.join(manifest.select(F.col("member").alias("entity_id"), "group_id", F.col("name").alias("group_name")), "entity_id", "left")
