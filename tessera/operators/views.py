"""Views kept by day: a day is computed again only if the code or a row that it depends on has changed."""

from __future__ import annotations

import datetime as dt
import hashlib
import inspect
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions.hashing import fingerprint
from tessera.operators.publication import DayLog, _exists


def code_digest(*parts: Callable | str) -> str:
    """SHA-256 over the source of functions, and over texts that stand for what they use: versions, parameters."""
    said = [p if isinstance(p, str) else inspect.getsource(p) for p in parts]
    return hashlib.sha256(json.dumps(said).encode()).hexdigest()


def day_keys(sources: dict[str, DataFrame], code: str, back: int = 0) -> dict[str, str]:
    """Day -> address of all that the day's view depends on: the code, and each source's rows of the day and of ``back`` days before.

    A row per day and source reaches the driver. Rows without a day belong to no day.
    """
    marks: dict[str, dict[str, str]] = {}
    for name, df in sorted(sources.items()):
        per = df.where("day is not null").groupBy(F.col("day").cast("date").alias("d")).agg(fingerprint(df, *df.columns).alias("f"))
        for r in per.collect():
            marks.setdefault(r.d.isoformat(), {})[name] = r.f
    shapes = {name: df.schema.json() for name, df in sources.items()}
    before = lambda day: [marks.get(d, {}) for d in _days(day, back)]
    return {day: hashlib.sha256(json.dumps([code, shapes, before(day)], sort_keys=True).encode()).hexdigest() for day in marks}


def _days(day: str, back: int) -> list[str]:
    at = dt.date.fromisoformat(day)
    return [(at - dt.timedelta(days=k)).isoformat() for k in range(back + 1)]


def _of(days: list[str]) -> Column:
    """Rows of some days; of a column of dates it reaches the scan."""
    return F.col("day").cast("date").isin([dt.date.fromisoformat(d) for d in days])


def refreshed(root: str, sources: dict[str, DataFrame], build: Callable[..., DataFrame], code: str, back: int = 0) -> tuple[DataFrame, list[str]]:
    """(the view, the days that were computed) after what changed is computed again.

    sources: name -> rows with a column day. build gets the same names with rows of the days to compute, and of ``back`` days
    before each, and returns rows with day; what it returns for other days is left out. Days that no source has any more go. What is kept is a
    version of a DayLog, put in place at once: readers find the former or the new one, and of two refreshes the later one commits over
    the days that it computed. A folder that is lost is computed again.
    """
    spark = next(iter(sources.values())).sparkSession
    log = DayLog(spark, root)
    keys = day_keys(sources, code, back)
    _, held = log.read()
    whole = {f: _exists(spark, f"{f}/_SUCCESS") for f in {v["folder"] for v in held.values() if v.get("folder")}}
    stale = sorted(d for d, k in keys.items() if held.get(d, {}).get("key") != k or not whole.get(held[d].get("folder"), False))
    dropped = [d for d, v in held.items() if d not in keys and v.get("folder")]
    changes: dict[str, dict] = {d: {"key": None, "folder": None, "schema": None} for d in dropped}
    if stale:
        wanted = sorted({d for s in stale for d in _days(s, back)})
        rows = build(**{n: df.where(_of(wanted)) for n, df in sources.items()}).where(_of(stale))
        folder = f"{root.rstrip('/')}/data/{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        changes |= {d: {"key": keys[d], "folder": folder, "schema": rows.schema.json()} for d in stale}
    if changes:
        log.commit(changes)
    return kept(spark, root), stale


def kept(spark: SparkSession, root: str) -> DataFrame:
    """The view as it was left last; each folder is read for its own days only. Raises LookupError if nothing was ever kept."""
    _, held = DayLog(spark, root).read()
    live = {d: v for d, v in held.items() if v.get("folder")}
    if not live:
        raise LookupError(f"no view below {root}")
    out = None
    for folder in sorted({v["folder"] for v in live.values()}):
        days = [d for d, v in live.items() if v["folder"] == folder]
        schema = StructType.fromJson(json.loads(live[days[0]]["schema"]))
        part = spark.read.schema(schema).parquet(folder).where(_of(days))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
