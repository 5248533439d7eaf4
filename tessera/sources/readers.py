"""Readers and writers of raw captures: feeds, sitemaps, archives, checkpoints, manifests, blobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions import text

RSS = "struct<channel:struct<item:array<struct<title:string,link:string,pubDate:string,description:string,guid:string>>>>"
ATOM = "struct<entry:array<struct<id:string,title:string,summary:string,published:string,updated:string,link:array<struct<_href:string,_rel:string>>,author:array<struct<name:string>>>>>"
SITEMAP = "struct<url:array<struct<loc:string,lastmod:string>>>"


def rss(pages: DataFrame, body: str = "body") -> DataFrame:
    """(.., title, link, published, summary, guid): items of RSS feeds, one row each; broken feeds give none."""
    x = F.from_xml(F.col(body), RSS, {"rowTag": "rss", "mode": "PERMISSIVE"})
    items = pages.select(*[c for c in pages.columns if c != body], F.explode(x["channel"]["item"]).alias("i"))
    return items.select(*[c for c in items.columns if c != "i"], F.trim("i.title").alias("title"), F.trim("i.link").alias("link"), F.col("i.pubDate").alias("published"), F.col("i.description").alias("summary"), F.col("i.guid").alias("guid"))


def atom(pages: DataFrame, body: str = "body") -> DataFrame:
    """(.., id, title, summary, published, link, authors): entries of Atom feeds; the link is an href."""
    x = F.from_xml(F.col(body), ATOM, {"rowTag": "feed", "mode": "PERMISSIVE"})
    e = pages.select(*[c for c in pages.columns if c != body], F.explode(x["entry"]).alias("e"))
    link = F.coalesce(F.filter(F.col("e.link"), lambda l: F.coalesce(l["_rel"], F.lit("alternate")) == "alternate")[0]["_href"], F.col("e.link")[0]["_href"])
    return e.select(*[c for c in e.columns if c != "e"], F.trim("e.id").alias("id"), text.collapse(F.col("e.title")).alias("title"), text.collapse(F.col("e.summary")).alias("summary"), F.coalesce("e.published", "e.updated").alias("published"), link.alias("link"), F.col("e.author.name").alias("authors"))


def sitemap(pages: DataFrame, holds: str = "/news/", body: str = "body") -> DataFrame:
    """(.., loc, lastmod): addresses of sitemaps that hold a path."""
    x = F.from_xml(F.col(body), SITEMAP, {"rowTag": "urlset", "mode": "PERMISSIVE"})
    u = pages.select(*[c for c in pages.columns if c != body], F.explode(x["url"]).alias("u"))
    return u.select(*[c for c in u.columns if c != "u"], F.trim("u.loc").alias("loc"), F.col("u.lastmod").alias("lastmod")).where(F.contains("loc", F.lit(holds)))


def releases(orgs: DataFrame, repos: DataFrame, rel: DataFrame, top: int = 5) -> DataFrame:
    """Releases of each organisation's ``top`` repositories by stars. orgs: org; repos: org, repo, stars; rel: org, repo, tag, published_at."""
    w = W.partitionBy("org").orderBy(F.desc("stars"), "repo")
    best = repos.join(orgs.select("org").distinct(), "org", "left_semi").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= top).select("org", "repo")
    return rel.join(best, ["org", "repo"])


def cached(responses: DataFrame, now: str, age_seconds: int) -> DataFrame:
    """The latest response per request if it is young enough. responses: request, fetched_at, response_id, body."""
    last = responses.groupBy("request").agg(F.max_by(F.struct("body", "fetched_at", "response_id"), F.struct("fetched_at", "response_id")).alias("r")).select("request", "r.*")
    return last.where(F.col("fetched_at").cast("timestamp") >= F.lit(now).cast("timestamp") - F.make_interval(secs=F.lit(age_seconds)))


def checkpoint_fold(lines: DataFrame, contract: str) -> DataFrame:
    """(entity, result, error): the last valid result per entity wins and erases its error; errors stay while unresolved.

    lines: pos, entity, contract, result, error. Lines of another contract don't count.
    """
    ok = lines.where(F.col("contract") == contract)
    g = ok.groupBy("entity").agg(F.max_by("result", F.when(F.col("result").isNotNull(), F.col("pos"))).alias("result"), F.max_by("error", F.when(F.col("error").isNotNull(), F.col("pos"))).alias("_e"))
    return g.select("entity", "result", F.when(F.col("result").isNull(), F.col("_e")).alias("error"))


def snapshot_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256): files below a path with their digests."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def blobs(rows: DataFrame, body: str, path: str) -> None:
    """Write texts once per content, in folders by the first two digits of their digest; contents that are there already are not written again."""
    spark = rows.sparkSession
    d = rows.select(F.sha2(F.col(body).cast("binary"), 256).alias("sha256"), F.col(body).alias("body")).dropDuplicates(["sha256"])
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        d = d.join(spark.read.parquet(path).select("sha256"), "sha256", "left_anti")
    d.withColumn("prefix", F.substring("sha256", 1, 2)).write.mode("append").partitionBy("prefix").parquet(path)


def export_csv(rows: DataFrame, columns: list[str], path: str) -> None:
    rows.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def manifest(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """A JSON or CSV manifest; raises if a required field is empty in any row."""
    read = spark.read.schema(schema)
    rows = read.option("header", True).csv(path) if path.endswith(".csv") else read.option("multiLine", True).json(path)
    bad = None
    for c in required:
        b = F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
        bad = b if bad is None else bad | b
    if bad is not None and rows.where(bad).limit(1).count():
        raise ValueError(f"{path}: a required field is empty")
    return rows


def raw_counts(raw: DataFrame) -> DataFrame:
    """(lab, source, n) in order of lab and source."""
    return raw.groupBy("lab", "source").agg(F.count("*").alias("n")).orderBy("lab", "source")
