"""What a fetched body is: media type, text or the reason why there is none, and text that is no content.

Rules are expressions; only NFKC folding (and an extractor of main text, which the caller brings) is
Python. PDF readers are not part of this library: their text comes in as a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

LEAST, MOST = 80, 5_000_000
TEXTUAL = ("application/json", "application/ld+json", "application/xml", "application/xhtml+xml", "text/xml")
# Codes, and the kinds of pages that are shells, in order. In a rule, title and text are folded; short is the length below which it holds.
SHELL_MARKS = ("checking your network connection", "enable javascript", "unable to load the form", "using a different browser")
PLACEHOLDER, SHELL, GARBLED = "extraction_placeholder_content", "extraction_non_content_shell", "extraction_garbled_text"


def media_type(header: Column) -> Column:
    """The type of a Content-Type header, without parameters."""
    return F.lower(F.trim(F.substring_index(F.coalesce(header, F.lit("")), ";", 1)))


def charset(header: Column) -> Column:
    """The charset of a Content-Type header, null without one."""
    return F.nullif(F.regexp_extract(header, r"(?i)charset\s*=\s*['\"]?([^;'\"\s]+)", 1), F.lit(""))


def disposition_title(header: Column) -> Column:
    """The file name of a Content-Disposition header without .txt; the encoded form counts more."""
    wide = F.try_url_decode(F.replace(F.regexp_extract(header, r"(?i)(?:^|;)\s*filename\*\s*=\s*UTF-8''([^;]+)", 1), F.lit("+"), F.lit("%2B")))
    quoted = F.regexp_extract(header, r'(?i)(?:^|;)\s*filename\s*=\s*"([^"]+)"', 1)
    bare = F.regexp_extract(header, r"(?i)(?:^|;)\s*filename\s*=\s*([^;]+)", 1)
    name = F.coalesce(*[F.nullif(F.trim(F.btrim(F.trim(x), F.lit('"'))), F.lit("")) for x in (wide, quoted, bare)])
    return F.nullif(F.trim(F.regexp_replace(name, r"(?i)\.txt$", "")), F.lit(""))


def html_title(body: Column) -> Column:
    """The first title that says something."""
    titles = F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<title[^>]*>(.*?)</title>"), 1), lambda x: F.trim(x))
    return F.try_element_at(F.filter(titles, lambda x: x != ""), F.lit(1))


def declared_canonical(body: Column, url: Column) -> Column:
    """The address of the first link element whose rel has canonical, resolved against the page's own; null without one."""
    links = F.regexp_extract_all(body, F.lit(r"(?is)(<link\b[^>]*>)"), 1)
    ours = F.filter(links, lambda x: x.rlike(r"(?is)\brel\s*=\s*(\"[^\"]*\bcanonical\b[^\"]*\"|'[^']*\bcanonical\b[^']*'|canonical\b)"))
    href = F.trim(F.regexp_extract(F.try_element_at(ours, F.lit(1)), r"(?is)\bhref\s*=\s*[\"']?([^\"'>\s]+)", 1))
    origin, scheme = F.regexp_extract(url, "^([a-z]+://[^/?#]+)", 1), F.regexp_extract(url, "^([a-z]+:)", 1)
    folder = F.when(F.regexp_extract(url, "^[a-z]+://[^/?#]+(/[^?#]*)", 1) == "", F.concat(origin, F.lit("/"))).otherwise(F.regexp_replace(F.regexp_extract(url, "^([a-z]+://[^?#]+)", 1), "[^/]*$", ""))
    return F.when(href == "", None).when(href.rlike("(?i)^[a-z][a-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(origin, href)).otherwise(F.concat(folder, href))


def _any(x: Column, *words: str) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | x.contains(w)
    return out


def shell_kind(title: Column, text: Column, size: Column, host: Column, path: Column) -> Column:
    """The kind of page that stands where content was asked for, null if it is none; the first rule that holds decides."""
    below = lambda n: size < n
    marks = ("troubleshooting", "accessibility", "fehlerbehebung", "bedienungshilfen", "share", "freigeben")
    menus = sum((text.contains(m).cast("int") for m in marks), F.lit(0))
    shut = text.contains("javascript") & _any(text, "file cannot be opened", "file can't be opened", "datei kann", "nicht geöffnet werden")
    asks = title.isin("sign in", "sign in required", "google forms: sign-in") & below(2500) & _any(text, "continue with", "email or phone", "sign in to", "securely sign you in")
    greets = title.startswith("welcome back") & below(2500) & _any(text, "continue with", "log in")
    rules = (
        ("security verification", _any(title, "just a moment") | _any(text, "performing security verification", "security service to protect against malicious bots")),
        ("browser verification", _any(title, "checking your browser", "verifying your browser", "vercel security checkpoint") | _any(text, "complete the check below to continue", "vercel security checkpoint")),
        ("bot or network security", _any(title, "are you a robot") | _any(text, "you've been blocked by network security") | (_any(text, "detected unusual activity from your computer network") & _any(text, "not a robot"))),
        ("client-rendered JavaScript", below(1000) & _any(text, "javascript is disabled", "enable javascript in your browser", "javascript must be enabled", "need to enable javascript")),
        ("client loading error", _any(text, "there was an error while loading. please reload this page")),
        ("not-found", _any(title, "page not found") | title.rlike(r"^404(\s|$)") | text.startswith("404 ")),
        ("redirect", title.startswith("redirecting") & text.startswith("redirecting")),
        ("region-unavailable", _any(title, "not available in your region") | _any(text, "isn't yet available in your region")),
        ("consent", host.isin("consent.google.com", "consent.youtube.com")),
        ("Google Docs editor", (host == "docs.google.com") & path.startswith("/document/") & (shut | (below(1500) & (menus >= 3)))),
        ("authentication", asks | greets | ((host == "chatgpt.com") & below(1000) & _any(text, "log in to get answers")) | (path.rlike("^/(login|signin|sign-in)") & below(2500))),
        ("access-denied", _any(title, "access denied") | text.startswith("access denied")),
        ("error", path.contains("/error/") & below(1000)),
        ("video site chrome", host.isin("youtube.com", "www.youtube.com", "youtu.be") & below(1000)),
    )
    out = F.lit(None).cast("string")
    for kind, holds in reversed(rules):
        out = F.when(holds, kind).otherwise(out)
    return out


def text_issues(rows: DataFrame, text: str = "text", title: str = "title", url: str = "url") -> DataFrame:
    """rows with issue and shell: why their text is no content, null if it may be.

    Text that is mostly placeholders comes first, then shells, then text full of control characters.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    fold = lambda c: T.collapse(T.folded(F.coalesce(c, F.lit(""))))
    r = rows.withColumns({"_title": fold(F.col(title)), "_text": fold(body), "_size": F.length(body)})
    host = F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    path = F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1))
    count = lambda pattern: F.length(body) - F.length(F.regexp_replace(body, pattern, ""))
    seen = F.length(F.regexp_replace(body, r"(?U)\s", ""))
    blank = (seen >= 100) & (count("[█�]") >= 0.9 * seen)
    controls, readable = count(r"[\p{C}&&[^\n\r\t]]"), count(r"[\x20-\x7e\n\r\t]")
    r = r.withColumn("shell", shell_kind(F.col("_title"), F.col("_text"), F.col("_size"), F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))))
    garbled = (controls >= 10) & (controls >= 0.001 * F.greatest("_size", F.lit(1))) & (readable < 0.5 * F.greatest("_size", F.lit(1)))
    issue = F.when(blank, PLACEHOLDER).when(F.col("shell").isNotNull(), SHELL).when(garbled, GARBLED)
    return r.withColumn("issue", issue).withColumn("shell", F.when(F.col("issue") == SHELL, F.col("shell"))).drop("_title", "_text", "_size")


def clean_text(x: Column) -> Column:
    """Composed text, line feeds only, no blanks at line ends, none around, one line feed at the end."""
    return F.concat(F.regexp_replace(T.article_body(x), r"^\s+", ""), F.lit("\n"))


def extract(fetched: DataFrame, main_text: Column, pdf_text: Column | None = None, main_size: Column | None = None) -> DataFrame:
    """fetched with title, canonical, text and error: one of them null.

    fetched: body (decoded), content_type, kind, url. main_text is the main text of an HTML body,
    pdf_text that of a PDF (null: unreadable); both are the caller's. A body is PDF, HTML, other text,
    or unsupported, in this order. main_size is what a main text has to have LEAST of (null: none);
    unless given, the characters of the cleaned text.
    """
    kind, body = media_type(F.col("content_type")), F.coalesce(F.col("body"), F.lit(""))
    pdf = (kind == "application/pdf") | body.startswith("%PDF-")
    html = kind.isin("text/html", "application/xhtml+xml", "") | F.lower(F.substring(body, 1, 4096)).contains("<html")
    plain = kind.startswith("text/") | kind.isin(*TEXTUAL)
    none = F.lit(None).cast("string")
    r = fetched.withColumn("_form", F.when(pdf, "pdf").when(html, "html").when(plain, "text").otherwise("other"))
    r = r.withColumn("_got", clean_text(F.when(F.col("_form") == "pdf", none if pdf_text is None else pdf_text).when(F.col("_form") == "html", F.coalesce(main_text, F.lit(""))).when(F.col("_form") == "text", body)))
    size = F.length("_got")  # one line feed is always there
    said = size - 1 if main_size is None else F.coalesce(main_size, F.lit(0))
    low = F.lower("_got")
    marks = sum((low.contains(m).cast("int") for m in SHELL_MARKS), F.lit(0))
    error = (
        F.when(F.col("_form") == "other", "unsupported_media_type")
        .when((F.col("_form") == "pdf") & F.col("_got").isNull(), "pdf_unreadable")
        .when((F.col("_form") == "pdf") & (F.length("_got") > MOST), "text_too_large")
        .when((F.col("_form") == "pdf") & (size - 1 < LEAST), "pdf_no_text_layer")
        .when((F.col("_form") == "html") & (F.col("kind") == "video"), "video_transcript_unavailable")
        .when((F.col("_form") == "html") & (said < LEAST), "extraction_empty_or_client_rendered")
        .when((F.col("_form") == "html") & (F.length("_got") < 2000) & (marks >= 2), "extraction_client_rendered_shell")
        .when((F.col("_form") == "text") & (F.col("_got") == "\n"), "text_empty")
    )
    page = F.col("_form") == "html"
    r = r.withColumns({"error": error, "title": F.when(page, html_title(body)), "canonical": F.when(page, declared_canonical(body, F.col("url")))})
    return r.withColumn("text", F.when(F.col("error").isNull(), F.col("_got"))).drop("_form", "_got")
