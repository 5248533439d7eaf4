"""Artifacts and the posts that disclose them: primary posts, candidates, the audit of lineage, what readers see.

posts: post_id, author_id, conversation_id, post_type, raw_sha256. items: day, event_id, root_id,
daily_rank (the events that are visible on a day).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.artifacts import candidates
from tessera.session import join_checked

# Hosts that only redirect.
REDIRECT_HOSTS = ("bit.ly", "buff.ly", "goo.gle", "go.meta.me", "lnkd.in", "nvda.ws", "tinyurl.com")
# How fetch states, ways of fetching and kinds are shown.
STATES = {"success": "ready", "failed_retryable": "retryable", "failed_terminal": "unavailable", "in_progress": "fetching"}
METHODS = {"jina-reader-v1": "Jina Reader", "bounded-public-v1": "Direct fetch", "google-docs-public-text-v1": "Google Docs export", "arxiv-metadata-v1": "arXiv metadata"}
TYPES = {"paper": "document", "repository": "repository", "video": "video"}
DEFERRED = ("docs.google.com", "forms.gle", "linkedin.com", "paperform.co", "twitter.com", "x.com", "youtu.be", "youtube.com")
READABLE = ("announcement", "article", "other")


def primary_posts(posts: DataFrame, roots: DataFrame) -> DataFrame:
    """(root_id, post_id): each root with the replies of its author in its conversation; a root that isn't captured, or has no author, is alone.

    roots: root_id.
    """
    named = roots.select("root_id").distinct()
    own = posts.where("author_id <> ''").select(F.col("post_id").alias("root_id"), "author_id", F.coalesce(F.nullif("conversation_id", F.lit("")), "post_id").alias("conversation_id"))
    replies = posts.where("post_type = 'reply'").select("post_id", "author_id", "conversation_id")
    more = named.join(own, "root_id").join(replies, ["author_id", "conversation_id"]).select("root_id", "post_id")
    return more.union(named.select("root_id", F.col("root_id").alias("post_id"))).distinct()


def sources(items: DataFrame, posts: DataFrame) -> DataFrame:
    """(event_id, post_id, day, daily_rank): each captured primary post of an event, on the first day that shows the event.

    An event whose root is itself a reply has none, unless its conversation's root is captured and
    by the same author.
    """
    who = posts.select("post_id", "author_id")
    answers = posts.where("post_type = 'reply'").select(F.col("post_id").alias("root_id"), "author_id", "conversation_id")
    top = answers.join(who.select(F.col("post_id").alias("conversation_id"), F.col("author_id").alias("_top")), "conversation_id", "left")
    foreign = top.where("_top is null or _top = '' or _top <> author_id").select("root_id")
    good = items.join(foreign, "root_id", "left_anti")
    each = good.join(primary_posts(posts, good), "root_id").join(who.select("post_id"), "post_id", "left_semi")
    first = each.groupBy("event_id", "post_id").agg(F.min(F.struct("day", "daily_rank")).alias("_f"))
    return first.select("event_id", "post_id", "_f.day", "_f.daily_rank")


def artifact_candidates(items: DataFrame, posts: DataFrame, evidence: DataFrame) -> DataFrame:
    """sources() with the decision on each address that the post itself holds, the number of the day's events, and the relation.

    evidence: post_id, owner_id, observed_url, expanded_url; addresses of embedded posts (another
    owner) are theirs and are left out.
    """
    sizes = items.groupBy("day").agg(F.count_distinct("event_id").alias("day_candidates"))
    own = evidence.where("owner_id = post_id").select("post_id", "observed_url", "expanded_url").distinct()
    rows = sources(items, posts).join(own, "post_id").join(F.broadcast(sizes), "day")
    relation = F.when(F.col("reason") == "x_longform_article", "self_publishes").otherwise("links_to")
    return candidates(rows, "observed_url", "expanded_url").withColumn("relation", relation)


def lineage_faults(runs: DataFrame, accepted: DataFrame, posts: DataFrame, evidence: DataFrame, observations: DataFrame, disclosures: DataFrame, artifacts: DataFrame, supplements: DataFrame, policy: str, provider: str = "twitterapi_io") -> DataFrame:
    """(reason, candidate_id, event_id, root_id, source_id): what contradicts that a catalogue comes from primary posts; none means sound.

    runs: run_id, feed_run, policy. accepted: candidate_id, event_id, artifact_id, source_kind,
    source_provider, source_id, source_sha256, observed_url, expanded_url, run_id. posts and
    evidence (post_id, expanded_url) have a feed_run as well. observations: observation_id,
    artifact_id, source_id, source_sha256, observed_url. disclosures: observation_id. artifacts,
    supplements: artifact_id.
    """
    none = F.lit("")
    text = lambda c: F.coalesce(F.col(c).cast("string"), none)
    by_run = join_checked(accepted.sparkSession, accepted, runs.select("run_id", "feed_run"), ["run_id"], "left")
    source = posts.select("feed_run", F.col("post_id").alias("source_id"), F.col("author_id").alias("_author"), F.coalesce(F.nullif("conversation_id", none), "post_id").alias("root_id"), F.col("post_type").alias("_type"), F.col("raw_sha256").alias("_sha"))
    root = posts.select("feed_run", F.col("post_id").alias("root_id"), F.coalesce("author_id", none).alias("_root_author"), F.coalesce(F.nullif("conversation_id", none), "post_id").alias("_root_conversation"))
    bound = evidence.select("feed_run", F.col("post_id").alias("source_id"), "expanded_url", F.lit(True).alias("_bound")).distinct()
    j = by_run.join(source, ["feed_run", "source_id"], "left").join(root, ["feed_run", "root_id"], "left").join(bound, ["feed_run", "source_id", "expanded_url"], "left")
    there = F.col("_sha").isNotNull()
    follows = there & (F.col("source_id") != F.col("root_id")) & F.col("_root_author").isNotNull()
    codes = {
        "unexpected_source_provider": (F.col("source_kind") != "x_post") | (F.col("source_provider") != provider),
        "accepted_candidate_missing_artifact": F.col("artifact_id").isNull(),
        "missing_source_post": ~there,
        "stale_source_snapshot": there & (F.col("_sha") != F.col("source_sha256")),
        "foreign_author": follows & ((F.col("_root_author") == "") | (F.coalesce("_author", none) != F.col("_root_author"))),
        "non_reply_continuation": follows & (F.coalesce("_type", none) != "reply"),
        "wrong_conversation": follows & (F.col("root_id") != F.col("_root_conversation")),
        "unbound_source_url": there & F.col("_bound").isNull(),
    }
    failing = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in codes.items()]))
    of_candidates = j.select(F.explode(failing).alias("reason"), text("candidate_id").alias("candidate_id"), text("event_id").alias("event_id"), text("root_id").alias("root_id"), text("source_id").alias("source_id"))

    def plain(df, reason, candidate=none, source_id=none):
        return df.select(F.lit(reason).alias("reason"), candidate.alias("candidate_id"), none.alias("event_id"), none.alias("root_id"), source_id.alias("source_id"))

    keys = ["artifact_id", "source_id", "source_sha256", "observed_url"]
    captured = j.where(there).select(*keys).distinct()
    orphans = plain(observations.join(captured, keys, "left_anti"), "orphan_observation", source_id=text("source_id"))
    known = observations.select("artifact_id").union(supplements.select("artifact_id")).distinct()
    bare = plain(artifacts.join(known, "artifact_id", "left_anti"), "artifact_without_lineage", text("artifact_id"))
    silent = plain(observations.join(disclosures.select("observation_id").distinct(), "observation_id", "left_anti"), "observation_without_disclosure", text("observation_id"), text("source_id"))
    strange = plain(runs.where(~F.col("policy").eqNullSafe(F.lit(policy))).limit(1), "unexpected_selection_policy")
    return of_candidates.unionByName(orphans).unionByName(bare).unionByName(silent).unionByName(strange)


def reader_order(listed: DataFrame, developments: DataFrame) -> DataFrame:
    """listed with development_id and the rank it is shown by: its development's rank of the day if there is one, else its own.

    listed: artifact_id, source_event, best_source_rank, source_published_at. developments: event_id,
    development_id, daily_rank. Readers sort by (best_source_rank, source_published_at, artifact_id).
    """
    d = developments.select(F.col("event_id").alias("source_event"), "development_id", F.col("daily_rank").alias("_rank"))
    return listed.join(d, "source_event", "left").withColumn("best_source_rank", F.coalesce("_rank", "best_source_rank")).drop("_rank")


def shown_first(listed: DataFrame, count: int, start: int = 0) -> DataFrame:
    """A page of reader_order(), in its order."""
    return listed.orderBy("best_source_rank", "source_published_at", "artifact_id").offset(start).limit(count)


def stratum(host: Column, kind: Column, url: Column) -> Column:
    """Redirect, paper, repository, video, x_article or html."""
    h = F.lower(host)
    article = h.isin("x.com", "www.x.com") & url.contains("/i/article/")
    return F.when(h.isin(*REDIRECT_HOSTS), "redirect").when(kind.isin("paper", "repository", "video"), kind).when(article, "x_article").otherwise("html")


def _shown(names: dict[str, str], value: Column, rest: Column) -> Column:
    found = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[value]
    return F.coalesce(found, rest)


def fetch_state(status: Column) -> Column:
    return _shown(STATES, F.coalesce(status, F.lit("")), F.lit("catalogued"))


def fetch_method(policy: Column) -> Column:
    """The way's name; unknown ways are shown as they are."""
    return F.when(policy.isNotNull(), _shown(METHODS, policy, policy))


def artifact_type(kind: Column, url: Column) -> Column:
    return F.when(url.rlike("^https?://x\\.com/i/article/"), "x_article").otherwise(_shown(TYPES, F.coalesce(kind, F.lit("")), F.lit("web")))


def readable(kind: Column, host: Column, deferred: tuple[str, ...] = DEFERRED) -> Column:
    """Whether a reader may fetch an address: an ordinary kind, and no host under one that is deferred."""
    held_back = F.lit(False)
    for suffix in deferred:
        held_back = held_back | (F.lower(host) == suffix) | F.lower(host).endswith(f".{suffix}")
    return F.coalesce(kind.isin(*READABLE) & host.isNotNull() & ~held_back, F.lit(False))
