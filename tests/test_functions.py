"""Decision tables and boundary values of the scalar functions."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import hashing, numbers, text, time, urls
from tessera.operators import artifacts


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


CANONICAL = [
    ("  https://h.example/a b?x=1 2  ", "https://h.example/a b?x=1+2"),
    ("https://H.example", "https://h.example/"),
    ("https://h.example?", "https://h.example/"),
    ("https://h.example:443/p;q#f?g", "https://h.example/p;q"),
    ("https://h.example:/p", "https://h.example/p"),
    ("https://h.example:0443/p", "https://h.example/p"),
    ("https://h.example:80/p", "https://h.example:80/p"),
    ("https://h.example:81/p", None),
    ("https://h.example:8x/p", None),
    ("https://@h.example/p", None),
    ("https:///p", None),
    ("https:p", None),
    ("https://h..example/p", None),
    ("https://" + "l" * 64 + ".example/", None),
    ("https://h.example.../p?&&a&=b&c==d", "https://h.example/p?a=&=b&c=%3Dd"),
    ("https://h.example/?UTM_Any=1&Gclid=2&gclids=3", "https://h.example/?gclids=3"),
    ("https://h.example/?k=%C3%BC%2b+%e2%98%83%", "https://h.example/?k=%C3%BC%2B+%E2%98%83%25"),
    ("https://h.example/?si=1&source=2", "https://h.example/?si=1&source=2"),
    ("https://youtu.be/v?SI=1&pp=2&feature=3&v=4", "https://youtu.be/v?v=4"),
    ("https://www.medium.com/s?source=1&k=2", "https://www.medium.com/s?k=2"),
    ("http://arxiv.org/HTML/9901.00001v3/?a=b", "https://arxiv.org/abs/9901.00001v3?a=b"),
    ("http://arxiv.org/abs/old/9901", "http://arxiv.org/abs/old/9901"),
    ("http://arxiv.org/list/9901", "http://arxiv.org/list/9901"),
    ("https://MÜNCHEN.example/ß", "https://xn--mnchen-3ya.example/ß"),
    ("ftp://h.example/", None),
    ("", None),
    (None, None),
]


def test_canonical_url(spark):
    df = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(CANONICAL)], "k int, x string")
    df = urls.canonical(df, F.col("x"), "c")
    assert {r.k: r.c for r in df.collect()} == {k: want for k, (_, want) in enumerate(CANONICAL)}


DECIDED = [
    ("https://twitter.com/n0", None, "excluded", "x_profile", None),
    ("https://www.x.com/n0/status/77?s=20", None, "excluded", "ordinary_x_status", None),
    ("https://x.com/n0/status/77a", None, "excluded", "x_internal_url", None),
    ("https://x.com/n0/I/Article/5", None, "accepted", "x_longform_article", "article"),
    ("https://video.twimg.com/a.mp4", None, "excluded", "x_media", None),
    ("https://any.example/search//", None, "excluded", "search_navigation", None),
    ("https://any.example/search/x", None, "accepted", "external_http_url", "other"),
    ("https://discord.com/channels/1", None, "accepted", "external_http_url", "other"),
    ("https://www.discord.gg/", None, "excluded", "invite_url", None),
    ("https://github.com//", None, "excluded", "external_profile", None),
    ("https://gitlab.com/one", None, "accepted", "external_http_url", "repository"),
    ("https://youtube.com/c/name", None, "excluded", "external_profile", None),
    ("https://youtube.com/clip/name", None, "accepted", "external_http_url", "video"),
    ("https://linkedin.com/company/z", None, "excluded", "external_profile", None),
    ("https://linkedin.com/jobs/z", None, "accepted", "external_http_url", "other"),
    ("https://any.example/Paper.PDF", None, "accepted", "external_http_url", "paper"),
    ("https://any.example/x-Released", None, "accepted", "external_http_url", "announcement"),
    ("https://t.co/z", None, "excluded", "unresolved_short_url", None),
    ("https://t.co/z", "https://www.t.co/y", "excluded", "unresolved_short_url", None),
    ("https://t.co/z", "https://any.example/research/z", "accepted", "external_http_url", "article"),
    ("https://t.co/z", "mailto:z@any.example", "failed", "unsupported_scheme", None),
    ("//any.example/z", None, "failed", "unsupported_scheme", None),
    ("any.example/z", None, "failed", "invalid_url", None),
    (None, None, "failed", "invalid_url", None),
]


def test_url_decisions(spark):
    df = spark.createDataFrame([(k, *r[:2]) for k, r in enumerate(DECIDED)], "k int, url string, full string")
    got = {r.k: (r.decision, r.reason, r.artifact_kind) for r in artifacts.candidates(df, "url", "full").collect()}
    assert got == {k: r[2:] for k, r in enumerate(DECIDED)}


@pytest.mark.parametrize(
    "x,want",
    [
        ("2026-07-11T08:00:00Z", dt.datetime(2026, 7, 11, 8)),
        ("2026-07-11", dt.datetime(2026, 7, 11)),
        ("Sat Jul 11 08:00:00 +0000 2026", dt.datetime(2026, 7, 11, 8)),
        ("Sat, 11 Jul 2026 10:00:00 +0200", dt.datetime(2026, 7, 11, 8)),
        ("yesterday", None),
        (None, None),
    ],
)
def test_parse_time(spark, x, want):
    got = one(spark, lambda c: F.date_format(time.parse(c), "yyyy-MM-dd HH:mm:ss"), x)
    assert got == (want and want.strftime("%Y-%m-%d %H:%M:%S"))


@pytest.mark.parametrize("published,want", [("2026-07-07T23:59:00", True), ("2026-07-06T23:59:00", False), ("2026-07-15T00:00:00", False), (None, False)])
def test_freshness_is_seven_days_inclusive(spark, published, want):
    assert one(spark, lambda c: time.is_current(c.cast("timestamp"), F.lit("2026-07-14")), published) is want


@pytest.mark.parametrize("below,total,want", [(3, 4, "1.000000"), (2, 4, "0.666667"), (0, 4, "0.000000"), (0, 1, "1.000000")])
def test_position(spark, below, total, want):
    from tessera.operators.network import position

    got = spark.createDataFrame([(below, total)], "b long, t long").select(position(F.col("b"), F.col("t"))).first()[0]
    assert str(got) == want


def test_zero_metric_falls_through(spark):
    df = spark.createDataFrame([("0", None), ("0", "4"), ("3", "9"), ("x", None)], "a string, b string")
    assert [r[0] for r in df.select(numbers.metric(F.col("a"), F.col("b"))).collect()] == [None, 4, 3, None]


@pytest.mark.parametrize("n,want", [(0, 0), (1, 60), (20, 60), (30, 90), (100, 200), (199, 398), (200, 200)])
def test_page_credits(spark, n, want):
    assert one(spark, numbers.page_credits, n, "long") == want


def test_canonical_json_hash_equals_python(spark):
    want = hashlib.sha256(json.dumps(["x", 'a"b/ü', None], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    assert one(spark, lambda c: hashing.content_id(F.lit("x"), c, F.lit(None).cast("string")), 'a"b/ü') == want


def test_fingerprint_ignores_order_and_partitions(spark):
    a = spark.range(50).selectExpr("id", "id % 7 as k")
    f = lambda d: d.agg(hashing.fingerprint(d, "id", "k")).first()[0]
    assert f(a) == f(a.orderBy(F.desc("id")).repartition(7)) != f(a.where("id > 0"))


def test_shard(spark):
    want = int.from_bytes(hashlib.sha256(b"abc").digest()[:8], "big") % 97
    assert one(spark, lambda c: hashing.shard(c, 97), "abc") == want


@pytest.mark.parametrize("x,want", [("v2.0-beta isn't one_two", 4), ("HTTPS://h.example/a(b) c", 1), ("a @b_1é c@d (@e)", 3), ("R&amp;D caf&eacute;", 3), ("e\u0301t\u0301 - …", 1), ("", 0), (None, 0)])
def test_substantive_words(spark, x, want):
    assert one(spark, text.substantive_words, x) == want


def test_text_helpers(spark):
    assert one(spark, text.collapse, "  a \n\t b ") == "a b"
    assert one(spark, text.handle, " @@Bob ") == "@bob"
    assert one(spark, text.profile_handle, "https://x.com/Some_One?s=1") == "some_one"
    assert one(spark, text.profile_handle, "https://example.com/a") is None
    assert one(spark, text.organisation_key, "Straße & Söhne Co., Limited") == "strasseandshne"
    assert one(spark, text.organisation_key, "Coinc GmbH") == "coincgmbh"
    slug = lambda x: text.slug(F.lit("x"), x)
    assert one(spark, slug, "--A b/C!") == "x-a-b-c" and one(spark, slug, "x" * 80) == "x-" + "x" * 72
    assert one(spark, slug, "日本") == "x-" + hashlib.sha256("x:日本".encode()).hexdigest()[:12]
    assert one(spark, lambda c: text.markdown_link(c, "X"), "[Y](b) [X](https://a.b)") == "https://a.b"
    assert one(spark, text.block_quote, "a\n\nb") == "> a\n>\n> b"
    assert one(spark, text.display_text, "https://t.co/abc") == ""
    assert one(spark, text.display_text, "see https://t.co/abc  &amp; go") == "see [link] & go"
    assert one(spark, lambda c: text.display_text(c, F.lit(False)), "see https://t.co/abc  &amp; go ") == "see https://t.co/abc  & go"
    assert one(spark, text.article_body, "a \r\nb\r\n\r\n") == "a\nb"
    assert tuple(one(spark, text.role_company, "VP, Research, Acme")) == ("VP, Research", "Acme")
    assert one(spark, text.chunk_words(5), "ab cd efghijkl m") == ["ab cd", "efghi", "jkl m"]
    assert one(spark, text.folded, "ＡB") == "ab"


def test_batches_are_cut_and_put_together_by_bytes():
    import pyarrow as pa

    from tessera.session import gathered, slices

    batches = [pa.record_batch({"a": list(range(n)), "t": ["x" * 10] * n}) for n in (0, 3, 1, 50, 2, 0, 9)]
    rows = [r for b in batches for r in b.column(0).to_pylist()]
    for f in (slices, gathered):
        out = list(f(iter(batches), 1, 200))
        assert [r for b in out for r in b.column(0).to_pylist()] == rows and max(b.num_rows for b in out) <= 20
    assert len(list(gathered(iter(batches), 1, 10_000))) == 1 and not list(gathered(iter([]), 1))
    long = pa.record_batch({"a": [1, 2, 3], "t": ["x" * 500, None, "y"]})
    assert [b.num_rows for b in slices(iter([long]), 1, 200)] == [1, 2]
