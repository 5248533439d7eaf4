"""Structural events: posts tied to their source by quote, retweet and the author's own replies.

Every post has one structural parent at most, so the links form a forest and a component is named by
its root. Roots are found by pointer doubling, in rounds that grow with the logarithm of the depth.

posts: post_id, author, post_type, in_reply_to, conversation_id, discovered_at, day.
relations: source_id, relation_type, target_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.hashing import content_id
from tessera.session import Scratch, shuffled


class BrokenForest(RuntimeError):
    """Several parents, or a cycle."""


def parent_candidates(posts: DataFrame, relations: DataFrame) -> DataFrame:
    """(post_id, relation_type, target_id) of posts that are no replies; quotes and retweets only follow their own kind."""
    own = posts.where("in_reply_to is null").select(F.col("post_id").alias("source_id"), "post_type")
    j = own.join(relations, "source_id").where("post_type not in ('quote', 'retweet') or relation_type = post_type")
    return j.select(F.col("source_id").alias("post_id"), "relation_type", "target_id").distinct()


def several_parents(posts: DataFrame, relations: DataFrame) -> DataFrame:
    """(post_id, n): posts with more than one structural parent; has to be empty."""
    return parent_candidates(posts, relations).groupBy("post_id").agg(F.count("*").alias("n")).where("n > 1")


def source_links(posts: DataFrame, relations: DataFrame) -> DataFrame:
    """(source_id, target_id, link_type) of quotes and retweets; a target that is itself a reply makes no link."""
    replies = posts.where("in_reply_to is not null").select(F.col("post_id").alias("target_id"))
    c = parent_candidates(posts, relations).join(replies, "target_id", "left_anti")
    return c.select(F.col("post_id").alias("source_id"), "target_id", F.col("relation_type").alias("link_type"))


def roots(spark: SparkSession, links: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root, depth) of every node of links (source_id, target_id); roots have depth 0.

    Only nodes that something points to take part in the rounds; the leaves, mostly the most, find their root by one join
    at the end. Each round doubles how far a pointer reaches, twice; a written table cuts the lineage. Raises
    BrokenForest if pointers still move after 4^rounds steps or run in a circle.
    """
    kept, scratch = Scratch(spark), Scratch(spark)
    every = kept.write(links.select(F.col("source_id").alias("node"), F.col("target_id").alias("up"), F.lit(1).cast("long").alias("steps")).distinct(), "pointers")
    now = scratch.write(every.join(shuffled(every.select(F.col("up").alias("node"))), "node", "left_semi"), "inner")

    def doubled(p: DataFrame) -> DataFrame:
        far = p.select(F.col("node").alias("up"), F.col("up").alias("_up2"), F.col("steps").alias("_more"))
        return p.join(shuffled(far), "up", "left").select("node", F.coalesce("_up2", "up").alias("up"), (F.col("steps") + F.coalesce("_more", F.lit(0))).alias("steps"), F.col("_up2").isNotNull().alias("_moved"))

    for _ in range(rounds):
        once = doubled(now)
        nxt = scratch.write(doubled(once.drop("_moved")), "pointers")
        state = nxt.agg(F.bool_or("_moved").alias("m"), F.max("steps").alias("s"), F.count("*").alias("n")).first()
        now = nxt.drop("_moved")
        scratch.drop(keep=1)
        if not state.m:
            break
        if state.s > state.n:
            raise BrokenForest("a cycle among structural parents")
    else:
        raise BrokenForest("pointers do not settle")
    found = now.select(F.col("node").alias("up"), F.col("up").alias("_root"), F.col("steps").alias("_more"))
    found = kept.write(every.join(shuffled(found), "up", "left").select("node", F.coalesce("_root", "up").alias("root"), (F.col("steps") + F.coalesce("_more", F.lit(0))).alias("depth")), "rooted")
    tops = found.select(F.col("root").alias("node")).distinct().select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"))
    return found.union(tops)


def _same_author(a_id: str, a: str, b_id: str, b: str) -> Column:
    """Equal ids where both have one, else equal handles."""
    both = (F.coalesce(a_id, F.lit("")) != "") & (F.coalesce(b_id, F.lit("")) != "")
    return F.coalesce(F.when(both, F.col(a_id) == F.col(b_id)).otherwise(F.col(a) == F.col(b)), F.lit(False))


def reply_links(posts: DataFrame, source_roots: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """(source_id, target_id, link_type) of replies by the author of their conversation's root.

    A reply hangs on the post it answers if that is by the same author (reply_parent), else on the
    root (primary_thread). Replies of others, or in conversations that aren't captured, make no link. Authors are the same
    by author_x_id where both posts have one, else by author; posts need not have the column author_x_id.
    """
    posts = posts if "author_x_id" in posts.columns else posts.withColumn("author_x_id", F.lit(None).cast("string"))
    replies = (posts if replies is None else replies).where("in_reply_to is not null and conversation_id is not null")
    named = lambda x, p: posts.select(F.col("post_id").alias(x), F.col("author_x_id").alias(f"_{p}i"), F.col("author").alias(f"_{p}a"))
    own = replies.select("post_id", "in_reply_to", "conversation_id").join(named("post_id", "s"), "post_id")
    captured = own.join(posts.select(F.col("post_id").alias("conversation_id")), "conversation_id")
    top = captured.join(source_roots.select(F.col("node").alias("conversation_id"), "root"), "conversation_id", "left").withColumn("root", F.coalesce("root", "conversation_id"))
    same = top.join(named("root", "r"), "root").where(_same_author("_si", "_sa", "_ri", "_ra"))
    parent = same.join(named("in_reply_to", "p"), "in_reply_to", "left")
    mine = F.col("_pa").isNotNull() & _same_author("_pi", "_pa", "_ri", "_ra")
    return parent.select(F.col("post_id").alias("source_id"), F.when(mine, F.col("in_reply_to")).otherwise(F.col("root")).alias("target_id"), F.when(mine, "reply_parent").otherwise("primary_thread").alias("link_type"))


def all_links(spark: SparkSession, posts: DataFrame, relations: DataFrame) -> DataFrame:
    """Links of quotes, retweets and replies; raises if a post has several parents.

    The conversation of a reply may itself be a reply. Those that name one wait until it is linked, or known to
    make no link, so that their root is the root of what it hangs on. Replies that wait for each other keep the
    conversation that they name as root.
    """
    if several_parents(posts, relations).limit(1).count():
        raise BrokenForest("a post has several structural parents")
    scratch = Scratch(spark)
    links = scratch.write(source_links(posts, relations), "links")
    waiting = posts.where("in_reply_to is not null and conversation_id is not null")
    while True:
        held = waiting.select(F.col("post_id").alias("conversation_id")).distinct()
        own = F.col("conversation_id") == F.col("post_id")
        later = scratch.write(waiting.where(~own).join(held, "conversation_id", "left_semi").select(*waiting.columns), "waiting")
        ready = waiting.where(own).unionByName(waiting.where(~own).join(held, "conversation_id", "left_anti").select(*waiting.columns))
        stuck = not ready.limit(1).count()
        made = reply_links(posts, roots(spark, links), waiting if stuck else ready).where("source_id <> target_id")
        links = scratch.write(links.unionByName(made), "links")
        if stuck or not later.limit(1).count():
            return links
        waiting = later


def members(spark: SparkSession, posts: DataFrame, links: DataFrame) -> DataFrame:
    """(root, post_id, depth, captured) of components worth showing.

    A component needs a link and a captured post; with one captured post only, it needs a target that
    isn't captured.
    """
    r = Scratch(spark).write(roots(spark, links), "roots")
    seen = r.join(posts.select(F.col("post_id").alias("node"), F.lit(True).alias("captured")), "node", "left").fillna(False, ["captured"])
    good = seen.groupBy("root").agg(F.count_if("captured").alias("_c"), F.count_if(~F.col("captured")).alias("_o")).where("_c > 1 or _c = 1 and _o > 0").select("root")
    return seen.join(good, "root", "left_semi").select("root", F.col("node").alias("post_id"), "depth", "captured")


def clusters(posts: DataFrame, mem: DataFrame) -> DataFrame:
    """(event_id, root, representative, members, links, first_day, last_day, n_days) per component.

    The representative is the root if captured, else of its direct children (of all, if there are none) the one
    discovered first, then published first, then observed directly, then of least id. posts: post_id, discovered_at,
    published_at, direct, day.
    """
    m = mem.join(posts.select("post_id", "discovered_at", "published_at", "direct", "day"), "post_id", "left")
    order = F.struct(F.least("depth", F.lit(2)), "discovered_at", "published_at", ~F.coalesce("direct", F.lit(False)), "post_id")
    rep = F.min_by("post_id", F.when(F.col("captured"), order))
    return m.groupBy("root").agg(
        rep.alias("representative"),
        F.count_if("captured").alias("members"),
        F.count_if(F.col("depth") > 0).alias("links"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.count_distinct("day").alias("n_days"),
    ).select(content_id(F.lit("x"), F.col("root")).alias("event_id"), "root", "representative", "members", "links", "first_day", "last_day", "n_days")


def visible_links(posts: DataFrame, links: DataFrame, day: str, rejected: DataFrame) -> DataFrame:
    """Links that can be seen as of a day: the source visible, the target visible or not captured.

    rejected: author. A captured target by a rejected author cuts the link; one not yet discovered
    stays as an anchor that isn't rendered.
    """
    p = posts.join(rejected.select("author", F.lit(True).alias("_r")), "author", "left")
    ok = p.where(F.col("_r").isNull() & (F.col("day") <= F.lit(day).cast("date"))).select(F.col("post_id").alias("source_id"))
    bad = p.where(F.col("_r").isNotNull() & (F.col("day") <= F.lit(day).cast("date"))).select(F.col("post_id").alias("target_id"))
    return links.join(ok, "source_id", "left_semi").join(bad, "target_id", "left_anti")


def as_of(posts: DataFrame, day: str) -> DataFrame:
    """Posts published and discovered by the day."""
    d = F.lit(day).cast("date")
    return posts.where((F.col("day") <= d) & (F.to_date("discovered_at") <= d))


def assign_later(spark: SparkSession, frozen: DataFrame, later_links: DataFrame, posts: DataFrame) -> DataFrame:
    """(post_id, event): posts that come later join the first frozen component up their parent chain.

    frozen: post_id, event. Components are never merged nor named anew: a chain is cut at a node
    that is owned already, and chains without one are left out.
    """
    owned = frozen.select(F.col("post_id").alias("source_id"))
    open_links = later_links.join(owned, "source_id", "left_anti")
    r = roots(spark, open_links)
    hit = r.where("depth > 0").join(frozen.select(F.col("post_id").alias("root"), "event"), "root")
    return hit.join(posts.select(F.col("post_id").alias("node")), "node", "left_semi").select(F.col("node").alias("post_id"), "event")


def canonical_day(items: DataFrame) -> DataFrame:
    """Items on their component's first direct day only. items: event, post_id, day, direct."""
    least = items.where("direct").groupBy("event").agg(F.min("day").alias("day"))
    return items.join(least, ["event", "day"], "left_semi")


def singletons(posts: DataFrame, mem: DataFrame, rejected: DataFrame) -> DataFrame:
    """Posts that are events of their own: no reply, in no component, author not rejected."""
    free = posts.where("in_reply_to is null").join(mem.select("post_id"), "post_id", "left_anti").join(rejected.select("author"), "author", "left_anti")
    return free.select(content_id(F.lit("x"), F.col("post_id")).alias("event_id"), "post_id", "author", "day")


def forest_rows(mem: DataFrame, links: DataFrame, posts: DataFrame) -> DataFrame:
    """(root, post_id, parent_id, relation, depth, parent_captured): rows of an event, as a reader walks them."""
    parent = links.select(F.col("source_id").alias("post_id"), F.col("target_id").alias("parent_id"), F.col("link_type"))
    seen = posts.select(F.col("post_id").alias("parent_id"), F.lit(True).alias("parent_captured"))
    j = mem.where("captured").join(parent, "post_id", "left").join(seen, "parent_id", "left")
    relation = F.when(F.col("link_type").isin("reply_parent", "primary_thread"), "reply").when(F.col("link_type").isin("quote", "retweet"), F.col("link_type")).when(F.col("depth") == 0, "root").otherwise("related")
    return j.select("root", "post_id", "parent_id", relation.alias("relation"), "depth", F.coalesce("parent_captured", F.lit(False)).alias("parent_captured"))


def forest_order(spark: SparkSession, rows: DataFrame, rounds: int = 40) -> DataFrame:
    """rows with sort_path, shown_depth and parent_missing: sorted by (root, sort_path) they read parents before children.

    rows: root, post_id, parent_id (null: none), relation, published. Below the root come its
    captured descendants, siblings by time and id; then posts whose parent isn't captured, with
    theirs; retweets last. A path is the chain of (time, id) from the top, found by pointer doubling:
    each round joins the chain of a post with that of the post it points to. Posts that none points to get theirs by one join at the end.
    """
    key = F.concat(F.date_format("published", "yyyyMMddHHmmssSSSSSS"), F.lit(":"), F.lpad(F.col("post_id").cast("string"), 20, "0"))
    told = rows.where("relation <> 'retweet' and post_id <> root").select("root", "post_id", "parent_id", key.alias("_key"))
    known = told.select(F.col("post_id").alias("parent_id"), "root", F.lit(True).alias("_told"))
    p = told.join(known, ["root", "parent_id"], "left")
    top = F.col("parent_id").eqNullSafe(F.col("root"))
    p = p.select("root", "post_id", F.when(F.col("_told").isNotNull() & ~top, F.col("parent_id")).alias("up"), F.array("_key").alias("path"), F.coalesce(~top & F.col("_told").isNull(), F.lit(False)).alias("loose"))
    scratch = Scratch(spark)
    every = Scratch(spark).write(p, "told")
    now = scratch.write(every.join(shuffled(every.where("up is not null").select("root", F.col("up").alias("post_id"))), ["root", "post_id"], "left_semi"), "paths")

    def longer(rows: DataFrame) -> DataFrame:
        far = now.select("root", F.col("post_id").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"), F.col("loose").alias("_loose"))
        return rows.join(shuffled(far), ["root", "up"], "left").select("root", "post_id", F.col("_up").alias("up"), F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("_path", "path")).alias("path"), (F.col("loose") | F.coalesce("_loose", F.lit(False))).alias("loose"))

    for _ in range(rounds):
        if not now.where("up is not null").limit(1).count():
            break
        now = scratch.write(longer(now), "paths")
        scratch.drop(keep=1)
    else:
        raise BrokenForest("a cycle among parents")
    found = longer(every).select("root", "post_id", F.array_join(F.concat(F.array(F.when(F.col("loose"), "1").otherwise("0")), "path"), "/").alias("_sort"), F.size("path").cast("long").alias("_depth"))
    j = rows.join(found, ["root", "post_id"], "left").join(known.select("root", "parent_id", "_told"), ["root", "parent_id"], "left")
    retweet = F.col("relation") == "retweet"
    sort_path = F.when(retweet, F.concat(F.lit("2/"), key)).otherwise(F.coalesce("_sort", F.lit("")))
    missing = (F.col("relation") == "reply") & (F.col("post_id") != F.col("root")) & ~F.col("parent_id").eqNullSafe(F.col("root")) & F.col("_told").isNull()
    return j.select(*rows.columns, sort_path.alias("sort_path"), F.when(retweet, F.lit(0)).otherwise(F.coalesce("_depth", F.lit(0))).cast("long").alias("shown_depth"), missing.alias("parent_missing"))


def week(daily: DataFrame, last_day: str, length: int = 7, carried: tuple[str, ...] = ()) -> DataFrame:
    """One row per event of the days up to last_day: its best (rank, day), its richest revision, its active days.

    daily: event, day, daily_rank, member_count, activity_days (null: the day alone) and the columns ``carried``. The
    richest revision is the row of most members, of equal ones the latest; member_count, revision_day
    and what is carried are that row's. Active days are the activity days of all rows that lie within the window.
    """
    d, begin = F.lit(last_day).cast("date"), F.date_sub(F.lit(last_day).cast("date"), length - 1)
    w = daily.where(F.col("day").between(begin, d)).withColumn("_days", F.filter(F.coalesce("activity_days", F.array("day")), lambda x: x.between(begin, d)))
    rich = F.max_by(F.struct("member_count", F.col("day").alias("revision_day"), *carried), F.struct("member_count", "day")).alias("_r")
    found = w.groupBy("event").agg(F.min(F.struct("daily_rank", "day")).alias("_b"), rich)
    active = w.select("event", F.explode("_days").alias("_d")).groupBy("event").agg(F.sort_array(F.collect_set("_d")).alias("_a"))
    return found.join(active, "event", "left").select("event", F.col("_b.daily_rank").alias("best_rank"), F.col("_b.day").alias("best_day"), "_r.*", F.coalesce("_a", F.array().cast("array<date>")).alias("active_days"))
