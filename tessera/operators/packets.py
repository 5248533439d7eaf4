"""Packets: what is read of a development, their addresses, and their rendering.

Everything is a row per source until a packet is rendered, so a packet of any size is built by joins
and aggregates.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text, time
from tessera.functions.hashing import content_id, fingerprint
from tessera.operators.upserts import pick

# What a cut packet ends with.
MARKER = "\n\n---\nTRUNCATED_EVIDENCE: The evidence packet exceeded the 20,000-token routing input limit. Remaining lower-priority evidence was omitted from this model call."


def post_sources(posts: DataFrame, day: Column) -> DataFrame:
    """(packet, place, post_id, author, text, published, relation): the posts of a development that are current, each once.

    posts: packet, event_id, is_primary, daily_rank, is_root, root_author, post_id, author, text,
    published, relationship, place (of the post in its event). The primary event comes first, then
    the others by rank and id; of an event its root, then what its author went on to say, but no retweets.
    A packet without a root left makes one of its first post; one without posts left is gone.
    """
    own = posts.where(F.col("is_root") | ((F.col("relationship") != "retweet") & (F.lower("author") == F.lower("root_author"))))
    ok = own.where(time.is_current(F.col("published"), day))
    place = F.struct((~F.col("is_primary")).alias("o"), "daily_rank", "event_id", (~F.col("is_root")).alias("r"), "place")
    relation = F.when(~F.col("is_root"), "same_author_continuation").when(F.col("is_primary"), "root").otherwise("independent_original")
    once = ok.select("packet", place.alias("place"), "post_id", "author", "text", "published", relation.alias("relation")).groupBy("packet", "post_id").agg(F.min_by(F.struct("author", "text", "published", "relation"), "place").alias("v"), F.min("place").alias("place"))
    heads = once.groupBy("packet").agg(F.bool_or(F.col("v.relation") == "root").alias("_has"), F.min("place").alias("_first"))
    j = once.join(heads, "packet")
    promoted = F.when(~F.col("_has") & (F.col("place") == F.col("_first")), "root").otherwise(F.col("v.relation"))
    return j.select("packet", "place", "post_id", "v.author", "v.text", "v.published", promoted.alias("relation"))


def artifact_sources(used: DataFrame, candidates: DataFrame, fetches: DataFrame) -> DataFrame:
    """(packet, artifact_id, author, title, text, relation): read artifacts that the packet's posts disclose, each once.

    used: post_sources(). candidates: packet, artifact_id, source_id, relation, title. fetches:
    artifact_id, status, finished_at, attempt_id, text. Of several disclosures one that publishes
    the artifact itself counts most, then that of the least post; of several fetches the last success with a text.
    """
    read = pick(fetches.where("status = 'success' and text is not null"), ["artifact_id"], [F.desc("finished_at"), F.desc("attempt_id")]).select("artifact_id", "text")
    seen = used.select("packet", F.col("post_id").alias("source_id"), "author")
    j = candidates.join(seen, ["packet", "source_id"])
    order = F.struct((F.col("relation") != "self_publishes").alias("o"), "source_id")
    one = j.groupBy("packet", "artifact_id").agg(F.min_by(F.struct("author", "title", "relation"), order).alias("v")).join(read, "artifact_id")
    own = F.col("v.relation") == "self_publishes"
    return one.select("packet", "artifact_id", F.when(own, F.col("v.author")).alias("author"), "v.title", "text", F.when(own, "self_published_artifact").otherwise("linked_artifact").alias("relation"))


def source_digest(texts: Column, *parts: Column) -> Column:
    """The address of one source: composed text and what is known of it; times of posting are no part."""
    return content_id(text.nfc(texts), *parts)


def evidence_address(sources: DataFrame, digest: str = "digest", place: str = "place") -> DataFrame:
    """(packet, evidence_address): the address of a packet's source digests with their places, added up, so that no packet is gathered."""
    return sources.groupBy("packet").agg(fingerprint(sources, place, digest).alias("evidence_address"))


def semantic_snapshots(members: DataFrame, links: DataFrame) -> DataFrame:
    """(event_id, snapshot): the address of an event's own evidence: its root, its author's other posts but retweets, and their links out.

    members: event_id, post_id, root_id, author, root_author, post_type, raw_sha256, published,
    discovered, direct. links: event_id, source_id, target_id, link_type. Reactions of others may
    come in for ever without a change of the address.
    """
    own = members.where((F.col("post_id") == F.col("root_id")) | ((F.lower("author") == F.lower("root_author")) & (F.col("post_type") != "retweet")))
    said = own.select("event_id", "root_id", F.lit("post").alias("what"), F.to_json(F.array("post_id", "raw_sha256", F.col("published").cast("string"), F.col("discovered").cast("string"), F.col("direct").cast("string"))).alias("row"))
    out = links.join(own.select("event_id", "root_id", F.col("post_id").alias("source_id")), ["event_id", "source_id"])
    tied = out.select("event_id", "root_id", F.lit("link").alias("what"), F.to_json(F.array("source_id", "target_id", "link_type")).alias("row"))
    rows = said.unionByName(tied).distinct()
    marks = rows.groupBy("event_id", "root_id").agg(fingerprint(rows, "what", "row").alias("mark"))
    return marks.select("event_id", content_id(F.col("event_id").cast("string"), F.col("root_id").cast("string"), F.col("mark")).alias("snapshot"))


def _section(title: str, rows: Column, name) -> Column:
    """A heading with the number of rows, and a numbered block for each; rows is an array of structs in order."""
    block = lambda x, i: F.concat(F.lit("\n\n### "), (i + 1).cast("string"), F.lit(". "), name(x, i), F.lit("\n\n"), x.quoted)
    return F.concat(F.lit(f"## {title} ("), F.size(rows).cast("string"), F.lit(")"), F.array_join(F.transform(rows, block), ""))


def render(sources: DataFrame) -> DataFrame:
    """(packet, input): a packet as a model reads it: source posts, the author's updates, supporting artifacts.

    sources: packet, day, place, source_type, relation, author, title, text; one root each. A rendered
    packet is one value and is made in one task; the rest of a packet is rows.
    """
    shown = text.display_text(F.col("text"), F.col("source_type") == "x_post")
    s = sources.withColumn("shown", shown)
    updates = (F.col("relation") == "same_author_continuation") & (F.col("shown") != "")
    group = F.when(F.col("source_type") == "artifact", "artifact").when(F.col("relation") == "root", "post").when(F.col("relation") == "independent_original", "post").when(updates, "update")
    s = s.withColumns({"_group": group, "_order": F.struct((F.col("relation") != "root").alias("r"), "place")}).where("_group is not null")
    s = s.withColumns({"quoted": text.block_quote(F.col("shown")), "author": text.collapse(F.coalesce("author", F.lit("Unknown author"))), "title": text.collapse(F.col("title"))})
    rows = lambda g: F.sort_array(F.collect_list(F.when(F.col("_group") == g, F.struct("_order", "author", "title", "shown", "quoted"))))
    p = s.groupBy("packet", "day").agg(rows("post").alias("posts"), rows("update").alias("updates"), rows("artifact").alias("artifacts"))
    some = F.size("artifacts") > 0
    empty = F.when(some, "> No substantive post text beyond the supporting artifact link.").otherwise("> No substantive post text was available.")
    said = F.transform("posts", lambda x: x.withField("quoted", F.when(x.shown == "", empty).otherwise(x.quoted)))
    by_author = lambda x, i: x.author
    by_title = lambda x, i: F.coalesce(F.nullif(x.title, F.lit("")), F.concat(F.lit("Artifact "), (i + 1).cast("string")))
    parts = [
        F.concat(F.lit("# Evidence about one development\n\nDate: "), F.col("day").cast("string")),
        _section("Source posts", said, by_author),
        F.when(F.size("updates") > 0, _section("Author updates", F.col("updates"), by_author)),
        F.concat(_section("Supporting artifacts", F.col("artifacts"), by_title), F.when(some, "").otherwise("\n\nNo supporting artifact text was included in this packet.")),
    ]
    return p.select("packet", F.array_join(F.array_compact(F.array(*parts)), "\n\n").alias("input"))


def truncated(x: Column, encode, decode, most: int = 20_000, marker: str = MARKER) -> Column:
    """x cut to ``most`` tokens with the marker at its end; encode and decode are the caller's tokenizer."""
    @F.pandas_udf(T.StringType())
    def cut(s: pd.Series) -> pd.Series:
        room = most - len(encode(marker))

        def one(v):
            ids = encode(v) if v is not None else []
            return v if len(ids) <= most else decode(ids[:room]).rstrip() + marker

        return s.map(one)

    return cut(x)
