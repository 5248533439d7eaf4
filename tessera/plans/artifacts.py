"""Queries over artifacts, developments and packets: pages for addresses, documents and conversations for text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text, urls
from tessera.operators import artifacts as art
from tessera.operators import developments as dev
from tessera.operators import routing
from tessera.plans import adapters as ad

HOST = "regexp_extract(lower({0}), '^https?://([^/?#:]+)', 1)"
URLS = f"""u AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS f FROM pages),
p AS (SELECT *, lower(regexp_extract(f, '^(https?)://', 1, 'i')) AS scheme, {HOST.format("f")} AS host, regexp_extract(f, '^https?://[^/?#:]+:([0-9]+)', 1, 'i') AS port,
  coalesce(nullif(regexp_extract(f, '^https?://[^/?#]+(/[^?]*)', 1, 'i'), ''), '/') AS path, regexp_extract(f, '\\?(.*)$', 1) AS query FROM u),
c AS (SELECT page_id, url, host, path, scheme || '://' || host || CASE WHEN port = '' OR (scheme = 'http' AND port = '80') OR (scheme = 'https' AND port = '443') THEN '' ELSE ':' || port END || path AS base,
  array_to_string(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND NOT list_contains([{", ".join(f"'{k}'" for k in urls.TRACKING)}], lower(split_part(x, '=', 1)))), '&') AS q FROM p WHERE port IN ('', '80', '443')),
canon AS (SELECT page_id, url, host, path, base || CASE WHEN q = '' THEN '' ELSE '?' || q END AS canonical_url FROM c)"""


def _pages(spark, sf_dir):
    return ad.table(spark, sf_dir, "pages").select("page_id", "url")


# Addresses made from a page's number, each with its canonical form (null: none), decision, reason and kind; Spark and DuckDB read the expressions alike.
MADE = (
    ("concat('HTTP://Bücher.Example:80/a', page_id, '?utm_x=1&b=', page_id, '%20c&d#top')", "concat('http://xn--bcher-kva.example/a', page_id, '?b=', page_id, '+c&d=')", "accepted", "external_http_url", "other"),
    ("concat('https://example.org./', page_id, '?q=a*b~c%zz')", "concat('https://example.org/', page_id, '?q=a%2Ab~c%25zz')", "accepted", "external_http_url", "other"),
    ("concat('http://example.org:443/news/', page_id)", "concat('http://example.org:443/news/', page_id)", "accepted", "external_http_url", "article"),
    ("concat('https://someone@example.org/', page_id)", "null", "failed", "invalid_url", ""),
    ("concat('https://example.org:8080/', page_id)", "null", "failed", "invalid_url", ""),
    ("concat('https://a..b/', page_id)", "null", "failed", "invalid_url", ""),
    ("concat('ftp://example.org/', page_id)", "null", "failed", "unsupported_scheme", ""),
    ("concat('no address ', page_id)", "null", "failed", "invalid_url", ""),
    ("concat('https://t.co/', page_id)", "concat('https://t.co/', page_id)", "excluded", "unresolved_short_url", ""),
    ("concat('https://x.com/i/article/', page_id)", "concat('https://x.com/i/article/', page_id)", "accepted", "x_longform_article", "article"),
    ("concat('https://twitter.com/a/statuses/', page_id, '/photo/1')", "concat('https://twitter.com/a/statuses/', page_id, '/photo/1')", "excluded", "ordinary_x_status", ""),
    ("concat('https://x.com/i/broadcasts/', page_id)", "concat('https://x.com/i/broadcasts/', page_id)", "excluded", "x_broadcast_deferred", ""),
    ("concat('https://x.com/u', page_id, '/')", "concat('https://x.com/u', page_id, '/')", "excluded", "x_profile", ""),
    ("concat('https://x.com/i/spaces/', page_id)", "concat('https://x.com/i/spaces/', page_id)", "excluded", "x_internal_url", ""),
    ("concat('https://pbs.twimg.com/', page_id)", "concat('https://pbs.twimg.com/', page_id)", "excluded", "x_media", ""),
    ("concat('https://example.org/Search/?q=', page_id)", "concat('https://example.org/Search/?q=', page_id)", "excluded", "search_navigation", ""),
    ("concat('https://discord.com/invite/', page_id)", "concat('https://discord.com/invite/', page_id)", "excluded", "invite_url", ""),
    ("concat('https://github.com/u', page_id)", "concat('https://github.com/u', page_id)", "excluded", "external_profile", ""),
    ("concat('https://github.com/u', page_id, '/r')", "concat('https://github.com/u', page_id, '/r')", "accepted", "external_http_url", "repository"),
    ("concat('https://youtube.com/@c', page_id)", "concat('https://youtube.com/@c', page_id)", "excluded", "external_profile", ""),
    ("concat('https://youtu.be/', page_id, '?si=1&t=2')", "concat('https://youtu.be/', page_id, '?t=2')", "accepted", "external_http_url", "video"),
    ("concat('https://medium.com/', page_id, '?source=x')", "concat('https://medium.com/', page_id)", "accepted", "external_http_url", "other"),
    ("concat('https://www.arxiv.org/PDF/', page_id, '.1v2.pdf?x=1')", "concat('https://arxiv.org/abs/', page_id, '.1v2?x=1')", "accepted", "external_http_url", "paper"),
    ("concat('https://www.linkedin.com/in/', page_id)", "concat('https://www.linkedin.com/in/', page_id)", "excluded", "external_profile", ""),
    ("concat('https://example.org/launch/', page_id)", "concat('https://example.org/launch/', page_id)", "accepted", "external_http_url", "announcement"),
)
MADE_SQL = "made AS (" + " UNION ALL ".join(f"SELECT page_id, {k} AS place, {a} AS url, {c} AS canonical_url, '{d}' AS decision, '{r}' AS reason, '{x}' AS kind FROM pages" for k, (a, c, d, r, x) in enumerate(MADE, 1)) + ")"


def _addresses(spark, sf_dir):
    """Each page's address (place 0) and those made from its number."""
    own = ad.table(spark, sf_dir, "pages")
    made = F.array(F.struct(F.lit(0).alias("place"), F.col("url").alias("url")), *[F.struct(F.lit(k).alias("place"), F.expr(m[0]).alias("url")) for k, m in enumerate(MADE, 1)])
    return own.select("page_id", F.explode(made).alias("x")).select("page_id", "x.place", "x.url")


def canonical_urls(spark, sf_dir):
    c = urls.canonical(_addresses(spark, sf_dir), F.col("url"))
    none = F.lit("")
    return c.select("page_id", "place", F.coalesce("canonical_url", none).alias("canonical_url"), F.coalesce(urls.artifact_id(F.col("canonical_url")), none).alias("artifact_id"), urls.is_merge_anchor(F.col("canonical_url")).alias("merge_anchor"))


def url_decisions(spark, sf_dir):
    c = art.candidates(_addresses(spark, sf_dir))
    return c.select("page_id", "place", "decision", "reason", F.coalesce("artifact_kind", F.lit("")).alias("artifact_kind"), F.coalesce("canonical_url", F.lit("")).alias("canonical_url"))


def artifact_aliases(spark, sf_dir):
    c = art.candidates(_pages(spark, sf_dir)).where("canonical_url is not null")
    return c.groupBy("artifact_id").agg(F.count("*").alias("observed"), F.min("url").alias("least_url"), F.min("page_id").alias("first_page"))


def website_counts(spark, sf_dir):
    return _pages(spark, sf_dir).groupBy(urls.website_key(F.col("url")).alias("website")).agg(F.count("*").alias("pages"))


def html_titles(spark, sf_dir):
    p = ad.table(spark, sf_dir, "pages")
    title = text.collapse(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    return p.select("page_id", title.alias("title"), F.coalesce(F.nullif(F.regexp_extract("html", r"(?i)<html[^>]*\slang=\"([^\"]*)\"", 1), F.lit("")), F.lit("")).alias("lang"))


def _fetches(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "view", "in_progress").when(F.col("event_type") == "click", "failed_retryable").when(F.col("event_type") == "signup", "failed_terminal").otherwise("other")
    return e.select((F.col("event_id") % 211).alias("artifact_id"), status.alias("status"), F.col("ts").alias("finished_at"), F.col("event_id").alias("attempt_id"), F.to_date("ts").alias("day"))


FETCH = """f AS (SELECT event_id % 211 AS artifact_id, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'view' THEN 'in_progress' WHEN 'click' THEN 'failed_retryable' WHEN 'signup' THEN 'failed_terminal' ELSE 'other' END AS status,
  ts AS finished_at, event_id AS attempt_id, ts::DATE AS day FROM events)"""


def best_fetches(spark, sf_dir):
    return art.best_fetch(_fetches(spark, sf_dir)).select("artifact_id", "status", "attempt_id")


def latest_outcomes(spark, sf_dir):
    return art.latest_outcome(_fetches(spark, sf_dir)).select("artifact_id", "status", "attempt_id")


def retryable_fetches(spark, sf_dir):
    return art.needs_retry(_fetches(spark, sf_dir)).select("artifact_id", "attempt_id")


def artifact_inspection(spark, sf_dir):
    f = _fetches(spark, sf_dir)
    obs = f.where("status <> 'other'").select("artifact_id", F.col("attempt_id").alias("obs_id"), F.col("finished_at").alias("observed_at"))
    ids = spark.range(0, 300).select(F.col("id").alias("artifact_id"))
    return art.inspect(ids, obs, f).select("artifact_id", "observations", F.coalesce(F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("first_seen"), "attempts", "successes")


def artifact_day_histogram(spark, sf_dir):
    return art.date_histogram(_fetches(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


def artifact_first_days(spark, sf_dir):
    f = _fetches(spark, sf_dir)
    return art.first_days(f.where("status = 'success'"), f.where("status = 'other'")).withColumn("first_day", F.col("first_day").cast("string"))


def best_candidates(spark, sf_dir):
    from pyspark.sql.window import Window as W

    f = _fetches(spark, sf_dir)
    w = W.partitionBy("day")
    url = F.concat(F.lit("https://e.example/"), F.col("attempt_id") % 97)
    r = f.select("artifact_id", "day", F.row_number().over(w.orderBy("attempt_id")).alias("rank"), F.count("*").over(w).alias("day_candidates"), (F.col("attempt_id") % 4).alias("source_id"), (F.col("attempt_id") % 3).alias("disclosure_id"), (F.col("attempt_id") % 5).alias("event_id"), url.alias("expanded_url"))
    first = r.withColumn("rank", F.when(F.col("artifact_id") % 3 == 0, 1).otherwise(F.col("rank")))
    return art.best_normalised(first).select("artifact_id", "event_id", "expanded_url", F.round("score", 9).alias("score"))


def document_bundles(spark, sf_dir):
    docs = ad.table(spark, sf_dir, "documents")
    ev = docs.select(F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("event_id"), (F.col("doc_id") % 4 == 0).alias("is_organisation"), F.col("n_chars").alias("daily_rank"))
    first = F.when(F.md5("text").substr(1, 1) < "8", F.lit("2024-01-01").cast("date")).when(F.md5("text").substr(1, 1) < "c", F.lit("2023-12-31").cast("date"))
    links = docs.select(F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("event_id"), F.md5("text").alias("artifact_id"), F.md5("text").alias("url"), (F.col("doc_id") % 3).alias("source_rank"), F.lit(True).alias("merge_anchor"), first.alias("first_day"))
    return dev.bundle_events(spark, ev, links, "2024-01-01")


def development_participants(spark, sf_dir):
    docs = ad.table(spark, sf_dir, "documents")
    role = F.when(F.col("doc_id") % 3 == 0, "post").when(F.col("doc_id") % 3 == 1, "quote").otherwise("retweet")
    votes = docs.select(F.md5("text").alias("development_id"), F.col("source").alias("entity"), role.alias("role"), F.col("doc_id").cast("string").alias("url"))
    return dev.participant_counts(dev.participants(votes))


def _sources(spark, sf_dir):
    c = ad.table(spark, sf_dir, "conversations")
    day = F.date_add(F.lit("2024-01-10").cast("date"), (F.col("turn") * 3 % 11 - 9).cast("int"))
    kind = F.when(F.col("role") == "system", "artifact").otherwise("x_post")
    return c.select(F.col("conv_id").alias("packet"), F.col("turn").alias("place"), kind.alias("source_type"), F.when(F.col("turn") == 0, "root").otherwise("same_author_continuation").alias("relation"), day.alias("published"), "text", F.when(F.col("conv_id") % 9 == 0, F.array(F.lit("photo"))).otherwise(F.array().cast("array<string>")).alias("media_types"))


SOURCES = """s AS (SELECT conv_id AS packet, turn AS place, CASE role WHEN 'system' THEN 'artifact' ELSE 'x_post' END AS source_type, CASE WHEN turn = 0 THEN 'root' ELSE 'same_author_continuation' END AS relation,
  DATE '2024-01-10' + (turn * 3 % 11 - 9)::INTEGER AS published, text, conv_id % 9 = 0 AS media FROM conversations)"""


def pruned_packets(spark, sf_dir):
    return routing.prune(_sources(spark, sf_dir), F.lit("2024-01-10")).select("packet", "place", "source_type", "relation")


# What is put behind texts: character references, letters to be composed, handles and addresses. Four words are left of it.
TAIL = " caf&eacute; R&amp;D cafe\u0301 @Jos\u00e9_1 (@ab) x@y &lt;https://t.co/q"


def _words_sql(x: str) -> str:
    said = f"nfc_normalize(replace(replace(replace({x}, '&eacute;', 'é'), '&amp;', '&'), '&lt;', '<'))"
    bare = f"regexp_replace(regexp_replace({said}, 'https?://\\S+', ' ', 'gi'), '(^|[^\\p{{L}}\\p{{N}}_])@[\\p{{L}}\\p{{N}}_]+', '\\1 ', 'g')"
    return f"len(regexp_extract_all({bare}, '[\\p{{L}}\\p{{N}}]+(?:[''’.\\-][\\p{{L}}\\p{{N}}]+)*'))::BIGINT"


def _marked(df, key):
    """df with TAIL behind every second text, by its key."""
    return df.withColumn("text", F.when(F.col(key) % 2 == 0, F.concat("text", F.lit(TAIL))).otherwise(F.col("text")))


def gated_packets(spark, sf_dir):
    return routing.gate(_marked(_sources(spark, sf_dir), "packet")).select("packet", F.coalesce("code", F.lit("")).alias("code"), "words")


def packet_hashes(spark, sf_dir):
    return routing.packet_hash(_sources(spark, sf_dir))


def routing_states(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events").select(F.to_date("ts").cast("string").alias("day"), (F.col("event_id") % 50).alias("item"), "event_type", "value").where("event_type in ('view', 'click')")
    items = e.where("event_type = 'view'").groupBy("day", "item").agg((F.count("*") % 2).cast("string").alias("evidence_sha256"))
    results = e.where("event_type = 'click' and day < '2024-01-20'").groupBy("day", "item").agg((F.count("*") % 2).cast("string").alias("evidence_sha256"), (F.max("value") > 50).alias("relevant"))
    s = routing.state(items, results)
    return s.groupBy("day", "routing_state").agg(F.count("*").alias("n"), F.count_if(routing.routing_filter("relevant")).alias("relevant"), F.count_if(routing.routing_filter("not_evaluated")).alias("not_evaluated"))


def reused_results(spark, sf_dir):
    c = ad.table(spark, sf_dir, "conversations")
    base = c.select((F.col("conv_id") % 40).cast("string").alias("event_id"), (F.col("turn") % 3).cast("string").alias("evidence_sha256"), F.col("role").alias("input_sha256"), F.lit("v1").alias("contract"), "conv_id", "turn")
    pending = base.where("turn < 3").select("event_id", "evidence_sha256", "input_sha256", "contract").distinct()
    done = base.where("turn >= 3").select("event_id", "evidence_sha256", "input_sha256", "contract", F.lit("complete").alias("status"), F.concat_ws("-", "conv_id", "turn").alias("result"), (F.col("conv_id") * 1000 + F.col("turn")).alias("finished_at"))
    return routing.reuse(pending, done).select("event_id", "evidence_sha256", "input_sha256", "status", F.coalesce("result", F.lit("")).alias("result"))


def run_telemetry(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events")
    runs = e.select("user_id", F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "pending").otherwise("complete").alias("status"), F.col("event_id").alias("tokens"), F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("cached"))
    return routing.telemetry(runs, ["user_id"])


def substantive_words(spark, sf_dir):
    d = _marked(ad.table(spark, sf_dir, "documents"), "doc_id")
    return d.select("doc_id", text.substantive_words(F.col("text")).alias("words"))


QUERIES = [
    (
        "canonical_urls",
        canonical_urls,
        f"""WITH {URLS}, {MADE_SQL}, a AS (SELECT page_id, 0 AS place, canonical_url, rtrim(path, '/') <> '' AS merge_anchor FROM canon UNION ALL SELECT page_id, place, canonical_url, canonical_url IS NOT NULL FROM made)
        SELECT page_id, place, coalesce(canonical_url, '') AS canonical_url, coalesce(sha256(canonical_url), '') AS artifact_id, merge_anchor FROM a""",
    ),
    (
        "url_decisions",
        url_decisions,
        f"""WITH {URLS}, {MADE_SQL} SELECT page_id, place, decision, reason, kind AS artifact_kind, CASE decision WHEN 'accepted' THEN canonical_url ELSE '' END AS canonical_url FROM made
        UNION ALL SELECT page_id, 0, 'accepted', 'external_http_url', CASE WHEN lower(path) LIKE '%.pdf' THEN 'paper' WHEN regexp_matches(lower(path), '/(blog|news|article|research)/') THEN 'article' WHEN regexp_matches(lower(path), 'announce|release|launch') THEN 'announcement' ELSE 'other' END, canonical_url FROM canon""",
    ),
    ("artifact_aliases", artifact_aliases, f"WITH {URLS} SELECT sha256(canonical_url) AS artifact_id, count(*) AS observed, min(url) AS least_url, min(page_id) AS first_page FROM canon GROUP BY 1"),
    ("website_counts", website_counts, f"WITH {URLS} SELECT regexp_replace(host, '^www\\.', '') AS website, count(*) AS pages FROM p GROUP BY 1"),
    (
        "html_titles",
        html_titles,
        """SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is'), '\\s+', ' ', 'g')) AS title, regexp_extract(html, '<html[^>]*\\slang="([^"]*)"', 1, 'i') AS lang FROM pages""",
    ),
    (
        "best_fetches",
        best_fetches,
        f"WITH {FETCH} SELECT artifact_id, status, attempt_id FROM f QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY CASE status WHEN 'success' THEN 0 WHEN 'in_progress' THEN 1 WHEN 'failed_retryable' THEN 2 ELSE 3 END, finished_at DESC, attempt_id DESC) = 1",
    ),
    (
        "latest_outcomes",
        latest_outcomes,
        f"WITH {FETCH} SELECT artifact_id, status, attempt_id FROM f QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY CASE status WHEN 'success' THEN 0 WHEN 'failed_terminal' THEN 1 WHEN 'failed_retryable' THEN 2 ELSE 3 END, finished_at DESC, attempt_id DESC) = 1",
    ),
    (
        "retryable_fetches",
        retryable_fetches,
        f"WITH {FETCH} SELECT artifact_id, attempt_id FROM f a WHERE status = 'failed_retryable' AND NOT EXISTS (SELECT 1 FROM f b WHERE b.artifact_id = a.artifact_id AND b.status = 'success' AND b.finished_at > a.finished_at)",
    ),
    (
        "artifact_inspection",
        artifact_inspection,
        f"""WITH {FETCH}, i AS (SELECT unnest(range(300)) AS artifact_id), o AS (SELECT artifact_id, count(*) AS n, min(finished_at) AS t FROM f WHERE status <> 'other' GROUP BY 1),
        g AS (SELECT artifact_id, count(*) AS a, count(*) FILTER (status = 'success') AS s FROM f GROUP BY 1)
        SELECT artifact_id, coalesce(n, 0)::BIGINT AS observations, coalesce(strftime(t, '%Y-%m-%d %H:%M:%S'), '') AS first_seen, coalesce(a, 0)::BIGINT AS attempts, coalesce(s, 0)::BIGINT AS successes FROM i LEFT JOIN o USING (artifact_id) LEFT JOIN g USING (artifact_id)""",
    ),
    ("artifact_day_histogram", artifact_day_histogram, f"WITH {FETCH} SELECT day::VARCHAR AS day, count(DISTINCT artifact_id) AS artifacts FROM f GROUP BY 1"),
    ("artifact_first_days", artifact_first_days, f"WITH {FETCH} SELECT artifact_id, min(day)::VARCHAR AS first_day FROM f WHERE status IN ('success', 'other') GROUP BY 1"),
    (
        "best_candidates",
        best_candidates,
        f"""WITH {FETCH}, r AS (SELECT artifact_id, CASE WHEN artifact_id % 3 = 0 THEN 1 ELSE row_number() OVER (PARTITION BY day ORDER BY attempt_id) END AS rank, count(*) OVER (PARTITION BY day) AS n, attempt_id % 4 = attempt_id % 3 AS own, attempt_id % 5 AS event_id, 'https://e.example/' || (attempt_id % 97) AS expanded_url FROM f),
        x AS (SELECT *, (rank - 1)::DOUBLE / greatest(n - 1, 1) AS score FROM r) SELECT artifact_id, event_id, expanded_url, round(score, 9) AS score FROM x QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY score, own DESC, event_id, expanded_url) = 1""",
    ),
    (
        "document_bundles",
        document_bundles,
        """WITH d AS (SELECT lpad(doc_id::VARCHAR, 10, '0') AS e, doc_id % 4 <> 0 AS o, n_chars AS r, md5(text) AS a FROM documents),
        g AS (SELECT a, count(*) AS n, first(e ORDER BY o, r, e) AS p FROM d GROUP BY a)
        SELECT sha256('["development","' || CASE WHEN n > 1 THEN 'artifact","' || a ELSE 'event","' || p END || '"]') AS development_id, p AS primary_event, CASE WHEN n > 1 THEN a ELSE '' END AS anchor, n AS n_events, e AS event_id FROM g JOIN d USING (a) WHERE n = 1 OR a[1] < '8' OR a[1] >= 'c'""",
    ),
    (
        "development_participants",
        development_participants,
        """WITH p AS (SELECT md5(text) AS development_id, source AS entity, bool_or(doc_id % 3 = 0) AS post, bool_or(doc_id % 3 <> 0) AS amp FROM documents GROUP BY 1, 2)
        SELECT development_id, count(*) FILTER (post) AS posters, count(*) FILTER (amp) AS amplifiers, count(*) AS attention FROM p GROUP BY 1""",
    ),
    (
        "pruned_packets",
        pruned_packets,
        f"""WITH {SOURCES}, k AS (SELECT *, source_type = 'x_post' AS post FROM s WHERE source_type <> 'x_post' OR DATE '2024-01-10' - published BETWEEN 0 AND 7),
        w AS (SELECT *, count(*) FILTER (post) OVER (PARTITION BY packet) AS posts, count(*) FILTER (post AND relation = 'root') OVER (PARTITION BY packet) AS roots, row_number() OVER (PARTITION BY packet ORDER BY NOT post, place) AS n FROM k)
        SELECT packet, place, source_type, CASE WHEN NOT post OR roots > 0 THEN relation WHEN n = 1 THEN 'root' ELSE 'same_author_continuation' END AS relation FROM w WHERE posts > 0""",
    ),
    (
        "gated_packets",
        gated_packets,
        f"""WITH {SOURCES}, m AS (SELECT * REPLACE (CASE WHEN packet % 2 = 0 THEN text || '{TAIL}' ELSE text END AS text) FROM s), v AS (SELECT *, {_words_sql("text")} AS w FROM m WHERE source_type = 'artifact' OR relation = 'root' OR trim(text) <> ''),
        g AS (SELECT packet, bool_or(media) AS m, count(*) AS n, count(*) FILTER (source_type = 'x_post') AS p, count(*) FILTER (source_type = 'x_post' AND relation = 'root') AS r, sum(CASE WHEN source_type = 'x_post' THEN w ELSE 0 END)::BIGINT AS words, bool_or(source_type = 'x_post' AND regexp_matches(text, 'https?://\\S+')) AS u FROM v GROUP BY 1)
        SELECT packet, CASE WHEN m THEN 'unsupported_media' WHEN n = 1 AND p = 1 AND r = 1 AND words <= 30 THEN CASE WHEN u THEN 'unavailable_linked_or_media_evidence' ELSE 'short_unsupported_text' END ELSE '' END AS code, words FROM g""",
    ),
    (
        "packet_hashes",
        packet_hashes,
        f"""WITH {SOURCES}, d AS (SELECT packet, sha256('{{"place":' || place || ',"relation":"' || relation || '","source_type":"' || source_type || '","text_sha256":"' || sha256(coalesce(text, '')) || '"}}') AS d FROM s)
        SELECT packet, {ad.fingerprint_sql("d")} AS evidence_sha256 FROM d GROUP BY 1""",
    ),
    (
        "routing_states",
        routing_states,
        """WITH e AS (SELECT ts::DATE::VARCHAR AS day, event_id % 50 AS item, event_type, value FROM events),
        i AS (SELECT day, item, count(*) % 2 AS h FROM e WHERE event_type = 'view' GROUP BY 1, 2), r AS (SELECT day, item, count(*) % 2 AS h, max(value) > 50 AS relevant FROM e WHERE event_type = 'click' AND day < '2024-01-20' GROUP BY 1, 2),
        s AS (SELECT i.day, CASE WHEN i.day NOT IN (SELECT day FROM r) THEN 'unavailable' WHEN r.h IS NULL THEN 'not_selected' WHEN r.h = i.h THEN 'evaluated' ELSE 'stale' END AS routing_state, relevant FROM i LEFT JOIN r ON r.day = i.day AND r.item = i.item)
        SELECT day, routing_state, count(*) AS n, count(*) FILTER (relevant) AS relevant, count(*) FILTER (relevant IS NULL) AS not_evaluated FROM s GROUP BY 1, 2""",
    ),
    (
        "reused_results",
        reused_results,
        """WITH b AS (SELECT (conv_id % 40)::VARCHAR AS event_id, (turn % 3)::VARCHAR AS evidence_sha256, role AS input_sha256, conv_id, turn FROM conversations),
        p AS (SELECT DISTINCT event_id, evidence_sha256, input_sha256 FROM b WHERE turn < 3), r AS (SELECT event_id, evidence_sha256, input_sha256, arg_max(conv_id || '-' || turn, conv_id * 1000 + turn) AS result FROM b WHERE turn >= 3 GROUP BY 1, 2, 3)
        SELECT p.event_id, p.evidence_sha256, p.input_sha256, CASE WHEN result IS NULL THEN 'pending' ELSE 'reused' END AS status, coalesce(result, '') AS result FROM p LEFT JOIN r USING (event_id, evidence_sha256, input_sha256)""",
    ),
    (
        "run_telemetry",
        run_telemetry,
        """WITH g AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type NOT IN ('error', 'view')) AS completed, count(*) FILTER (event_type = 'error') AS failed, sum(event_id)::BIGINT AS tokens, coalesce(sum(event_id) FILTER (event_id % 2 = 0), 0)::BIGINT AS cached FROM events GROUP BY 1)
        SELECT *, round(cached / tokens, 6) AS cache_ratio FROM g""",
    ),
    (
        "substantive_words",
        substantive_words,
        f"SELECT doc_id, {_words_sql(f"CASE WHEN doc_id % 2 = 0 THEN text || '{TAIL}' ELSE text END")} AS words FROM documents",
    ),
]
