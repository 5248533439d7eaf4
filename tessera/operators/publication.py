"""Runs named by content, pointers that make them visible, and writes that happen once."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from tessera.functions.hashing import fingerprint


def run_id(df: DataFrame, keys: list[str], *contract: str) -> str:
    """SHA-256 of the contract and the fingerprint of df's keys: equal input has an equal run."""
    mark = df.agg(fingerprint(df, *keys).alias("f"))
    return mark.select(F.sha2(F.to_json(F.array(*map(F.lit, contract), "f")).cast("binary"), 256)).first()[0]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def materialise(df: DataFrame, root: str, run: str) -> bool:
    """Write df as the run's folder below root unless it is there and whole; True if it was reused."""
    spark, path = df.sparkSession, f"{root}/run_id={run}"
    if _exists(spark, f"{path}/_SUCCESS"):
        return True
    df.write.mode("overwrite").parquet(path)
    return False


def pointers(log: DataFrame, tie: str) -> DataFrame:
    """(day, run_id): the run published last for each day. log: day, run_id, published_at and a tie-breaker."""
    w = W.partitionBy("day").orderBy(F.desc("published_at"), F.desc(tie))
    return log.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("day", "run_id")


def current(runs: DataFrame, pointer: DataFrame) -> DataFrame:
    """Rows of the runs that are visible."""
    return runs.join(pointer, ["day", "run_id"], "left_semi")


class Conflict(RuntimeError):
    """Another publication changed the same days in between."""


def _put_if_absent(spark: SparkSession, path: str, said: str) -> bool:
    """Make the file ``path`` with what is said, whole or not at all; False if it is there.

    The text is written beside it and gets its name in one step: by a link in a local file system, else by a rename that
    never replaces. A store without such a rename can't hold a log.
    """
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    conf = spark._jsc.hadoopConfiguration()
    fs = target.getFileSystem(conf)
    out = fs.create(beside)
    out.write(bytearray(said.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            os.link(beside.toUri().getPath(), target.toUri().getPath())
        else:
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), conf).rename(beside, target, none)
        return True
    except Exception:
        if fs.exists(target):
            return False
        raise
    finally:
        fs.delete(beside, False)


class DayLog:
    """What is published for each day, as a log of versions: ``root``/_log/<version>.json.

    A version is a file that holds the state of all days; the greatest number counts. It is put in place if absent, so
    of two writers of one version one has to read again. A reader finds the last version whole, whatever
    writers do or wherever they stop.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, f"{root.rstrip('/')}/_log"

    def read(self) -> tuple[int, dict[str, dict]]:
        """(version, day -> what is published); version 0 is before the first publication."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return 0, {}
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        last = max((n for n in names if re.fullmatch(r"\d{20}\.json", n)), default=None)
        if last is None:
            return 0, {}
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{last}"))
        try:
            return int(last[:20]), json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, changes: dict[str, dict], check: Callable[[dict[str, dict]], None] | None = None, base: int | None = None) -> int:
        """Replace some days, all or none, and return the version.

        ``check`` gets the state of the other days and raises if the changes don't go with it; it is called again whenever another
        writer was faster. With ``base``, the version that the changes rest on, Conflict is raised if one of
        their days has changed since.
        """
        held = None
        while True:
            version, days = self.read()
            if base is not None and version != base and any(days.get(d, {}).get("version", 0) > base for d in changes):
                raise Conflict(f"a day was published in version {version}, after {base}")
            others = {d: v for d, v in days.items() if d not in changes}
            if check and others != held:
                check(others)
                held = others
            new = others | {d: v | {"version": version + 1} for d, v in changes.items()}
            if _put_if_absent(self.spark, f"{self.folder}/{version + 1:020d}.json", json.dumps(new, sort_keys=True)):
                return version + 1


def publish(spark: SparkSession, days: DataFrame, finished: DataFrame, path: str, base: int | None = None) -> int:
    """Replace the run that each of some days points to, all or none, and return the version.

    days: day, run_id. Each run has to be finished (run_id) and a day may be named once. Other days
    keep their pointers.
    """
    if days.join(finished, "run_id", "left_anti").limit(1).count():
        raise ValueError("a run that is not finished cannot be published")
    if days.groupBy("day").count().where("count > 1").limit(1).count():
        raise ValueError("a day is named twice")
    return DayLog(spark, path).commit({str(r.day): {"run_id": r.run_id} for r in days.select("day", "run_id").collect()}, base=base)


def published(spark: SparkSession, path: str) -> DataFrame:
    """(day, run_id) as published last; day as text."""
    _, days = DayLog(spark, path).read()
    return spark.createDataFrame([(d, v["run_id"]) for d, v in days.items()], "day string, run_id string")


#: What keeps cohorts from being published, in the order in which it is looked for.
COHORT_FAULTS = ("no_candidates", "repeated_development", "repeated_rank", "several_days", "other_day", "no_completed_run")


def cohort_faults(items: DataFrame, days: DataFrame, other: DataFrame, runs: DataFrame, prompt_version: str) -> DataFrame:
    """(fault, day, development_id): what keeps the cohorts of ``days`` from being published; empty if nothing does.

    items: day, development_id, daily_rank. days: day. other: day, development_id of what is published; of days that
    are replaced nothing counts. runs: day, development_id, daily_rank, prompt_version of completed runs.
    """
    none = F.lit(None).cast("string")
    told = lambda df, fault, who=None: df.select(F.lit(fault).alias("fault"), "day", (F.col("development_id") if who is None else who).alias("development_id"))
    empty = told(days.join(items, "day", "left_anti"), "no_candidates", none)
    twice = told(items.groupBy("day", "development_id").count().where("count > 1"), "repeated_development")
    tied = told(items.groupBy("day", "daily_rank").count().where("count > 1"), "repeated_rank", none)
    spread = items.groupBy("development_id").agg(F.count_distinct("day").alias("n"), F.min("day").alias("day")).where("n > 1")
    rest = other.join(days, "day", "left_anti")
    taken = told(rest.join(items.select("development_id").distinct(), "development_id", "left_semi"), "other_day")
    done = runs.where(F.col("prompt_version") == prompt_version)
    undone = told(items.join(done, ["day", "development_id", "daily_rank"], "left_anti"), "no_completed_run")
    return empty.unionByName(twice).unionByName(tied).unionByName(told(spread, "several_days")).unionByName(taken).unionByName(undone).distinct()


def cohorts(items: DataFrame, audience: str, kind: str, limit: int) -> DataFrame:
    """(day, candidate_count, selection_sha256): the address of each day's cohort, in order of rank and id. A cohort is one short list."""
    listed = F.array_sort(F.collect_list(F.struct("daily_rank", "development_id")))
    said = F.to_json(F.struct(F.lit(audience).alias("audience"), listed.alias("candidates"), F.lit(kind).alias("selection_kind"), F.lit(limit).alias("selection_limit")))
    return items.groupBy("day").agg(F.count("*").alias("candidate_count"), F.sha2(said.cast("binary"), 256).alias("selection_sha256"))


ITEM = "day string, development_id string, daily_rank long"


def publish_cohorts(items: DataFrame, runs: DataFrame, root: str, prompt_version: str, published_at: str, audience: str, kind: str, limit: int, days: list[str] | None = None, base: int | None = None) -> int:
    """Replace the cohorts of some days (those of items, or ``days``), all or none, and return the version.

    Items are written to a folder of their own, then a version of the log names it. Nothing is visible before that, and
    nothing of what was visible is touched. A cohort that doesn't hold, also against days that others publish meanwhile, raises ValueError.
    """
    spark = items.sparkSession
    folder = f"{root.rstrip('/')}/data/{uuid.uuid4().hex}"
    items.select(F.col("day").cast("string").alias("day"), F.col("development_id").cast("string").alias("development_id"), F.col("daily_rank").cast("long").alias("daily_rank")).write.parquet(folder)
    own = spark.read.schema(ITEM).parquet(folder)
    marks = {r.day: r for r in cohorts(own, audience, kind, limit).collect()}
    named = sorted(set(days or marks))
    if not named:
        raise ValueError("no day to publish")
    wanted = spark.createDataFrame([(d,) for d in named], "day string")

    def check(others: dict[str, dict]) -> None:
        found = {r.fault for r in cohort_faults(own, wanted, _cohort_items(spark, others), runs, prompt_version).select("fault").distinct().collect()}
        if found:
            raise ValueError(f"the cohorts cannot be published: {next(f for f in COHORT_FAULTS if f in found)}")

    told = {d: {"folder": folder, "selection_limit": limit, "published_at": published_at} | ({"candidate_count": marks[d].candidate_count, "selection_sha256": marks[d].selection_sha256} if d in marks else {}) for d in named}
    return DayLog(spark, root).commit(told, check, base)


def _cohort_items(spark: SparkSession, days: dict[str, dict]) -> DataFrame:
    """Items of days as the log has them; a folder is read for its own days only."""
    out = spark.createDataFrame([], ITEM)
    for folder in sorted({v["folder"] for v in days.values()}):
        out = out.unionByName(spark.read.schema(ITEM).parquet(folder).where(F.col("day").isin([d for d, v in days.items() if v["folder"] == folder])))
    return out


def published_cohorts(spark: SparkSession, root: str) -> DataFrame:
    """(day, development_id, daily_rank, selection_limit, candidate_count, selection_sha256, published_at) as published last."""
    _, days = DayLog(spark, root).read()
    marks = [(d, v["selection_limit"], v["candidate_count"], v["selection_sha256"], v["published_at"]) for d, v in days.items()]
    about = spark.createDataFrame(marks, "day string, selection_limit long, candidate_count long, selection_sha256 string, published_at string")
    return _cohort_items(spark, days).join(about, "day")


def publish_tables(root: str, tables: dict[str, DataFrame], base: int | None = None) -> int:
    """Replace several tables at once and return the version: all are written to folders of their own before one version of the log names them."""
    spark, changes = next(iter(tables.values())).sparkSession, {}
    for name, df in tables.items():
        folder = f"{root.rstrip('/')}/data/{name}-{uuid.uuid4().hex}"
        df.write.parquet(folder)
        changes[name] = {"folder": folder, "schema": df.schema.json()}
    return DayLog(spark, root).commit(changes, base=base)


def published_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the last version, by name; all are of one version."""
    _, named = DayLog(spark, root).read()
    return {n: spark.read.schema(StructType.fromJson(json.loads(v["schema"]))).parquet(v["folder"]) for n, v in named.items()}
