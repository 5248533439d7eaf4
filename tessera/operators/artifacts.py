"""Artifacts: addresses that posts disclose, how they were fetched, and which to read."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions import numbers, urls
from tessera.operators.graph import components
from tessera.operators.upserts import pick


def candidates(observed: DataFrame, url: str = "url", expanded: str | None = None) -> DataFrame:
    """observed with decision, reason, canonical_url, artifact_kind and artifact_id of each address."""
    seen = F.trim(F.coalesce(F.col(url), F.lit("")))
    full = F.coalesce(F.nullif(F.trim(F.col(expanded)), F.lit("")), seen) if expanded else seen
    s = observed.withColumns({"_seen": seen, "_full": full})
    s = s.withColumns({"_first": urls.parsed(F.col("_seen")), "_parts": urls.parsed(F.col("_full"))})
    s = s.withColumns({"_name": urls.ascii_host(F.col("_first")), "_host": urls.ascii_host(F.col("_parts"))})
    s = s.withColumn("_c", urls.put_together(F.col("_parts"), F.col("_host")))
    decided = urls.decide(*map(F.col, ("_seen", "_full", "_parts", "_name", "_c")))
    # Out of a generator of one row: a filter on the decision would otherwise be pushed below and repeat all of this.
    out = s.select(*observed.columns, F.explode(F.array(decided)).alias("_d")).select(*observed.columns, "_d.*")
    return out.withColumn("artifact_id", F.when(F.col("canonical_url").isNotNull(), urls.artifact_id(F.col("canonical_url"))))


def _status_rank(status: Column, order: tuple[str, ...]) -> Column:
    out = F.lit(len(order))
    for k in range(len(order) - 1, -1, -1):
        out = F.when(status == order[k], k).otherwise(out)
    return out


def best_fetch(fetches: DataFrame) -> DataFrame:
    """The fetch to show per artifact: success, then in progress, then retryable, then others; of equal ones the latest."""
    return pick(fetches, ["artifact_id"], [_status_rank(F.col("status"), ("success", "in_progress", "failed_retryable")), F.desc("finished_at"), F.desc("attempt_id")])


def latest_outcome(fetches: DataFrame) -> DataFrame:
    """The outcome per artifact: success, then terminal, then retryable failures, then others; of equal ones the latest."""
    return pick(fetches, ["artifact_id"], [_status_rank(F.col("status"), ("success", "failed_terminal", "failed_retryable")), F.desc("finished_at"), F.desc("attempt_id")])


def day_observations(obs: DataFrame) -> DataFrame:
    """One row per artifact of a day's observations with their number and the first and last time.

    obs: artifact_id, rank, observed_at, obs_id.
    """
    w = W.partitionBy("artifact_id")
    o = obs.withColumns({"observations": F.count("*").over(w), "first_at": F.min("observed_at").over(w), "last_at": F.max("observed_at").over(w), "_k": F.row_number().over(w.orderBy(F.asc_nulls_last("rank"), "observed_at", "obs_id"))})
    return o.where("_k = 1").drop("_k")


def best_normalised(candidates: DataFrame) -> DataFrame:
    """Best candidate per artifact by score = (rank - 1) / (n - 1) of its day, as it is; then own disclosures, event, address.

    candidates: artifact_id, rank, day_candidates, source_id, disclosure_id, event_id, expanded_url. Those accepted are the caller's choice.
    """
    own = F.coalesce(F.col("source_id") == F.col("disclosure_id"), F.lit(False))
    r = candidates.withColumn("score", numbers.normalised_rank(F.col("rank").cast("double"), F.col("day_candidates")))
    return pick(r, ["artifact_id"], [F.asc("score"), F.desc(own), F.asc("event_id"), F.asc("expanded_url")])



def first_days(*tables: DataFrame) -> DataFrame:
    """(artifact_id, first_day) over all tables that have artifact_id and day."""
    out = tables[0].select("artifact_id", "day")
    for t in tables[1:]:
        out = out.unionByName(t.select("artifact_id", "day"))
    return out.groupBy("artifact_id").agg(F.min("day").alias("first_day"))


def date_histogram(obs: DataFrame) -> DataFrame:
    """(day, artifacts): distinct artifacts per day."""
    return obs.groupBy("day").agg(F.count_distinct("artifact_id").alias("artifacts"))


def inspect(artifacts: DataFrame, obs: DataFrame, fetches: DataFrame) -> DataFrame:
    """(artifact_id, observations, first_seen, attempts, successes): each side is counted on its own, then joined."""
    o = obs.groupBy("artifact_id").agg(F.count_distinct("obs_id").alias("observations"), F.min("observed_at").alias("first_seen"))
    f = fetches.groupBy("artifact_id").agg(F.count_distinct("attempt_id").alias("attempts"), F.count_distinct(F.when(F.col("status") == "success", F.col("attempt_id"))).alias("successes"))
    return artifacts.join(o, "artifact_id", "left").join(f, "artifact_id", "left").fillna(0, ["observations", "attempts", "successes"])


def needs_retry(fetches: DataFrame) -> DataFrame:
    """Native failures that no later success of the artifact made good."""
    bad = fetches.where("status = 'failed_retryable'").select("artifact_id", "attempt_id", F.col("finished_at").alias("failed_at"))
    best = fetches.where("status = 'success'").groupBy("artifact_id").agg(F.max("finished_at").alias("_ok"))
    return bad.join(best, "artifact_id", "left").where("_ok is null or _ok <= failed_at").drop("_ok")


def converge(spark: SparkSession, aliases: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with artifact_id replaced by the least id that redirects connect it with. aliases: a, b."""
    c = components(spark, aliases.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return rows.join(c.withColumnRenamed("node", "artifact_id"), "artifact_id", "left").withColumn("artifact_id", F.coalesce("component", "artifact_id")).select(*rows.columns)


def quota_cohort(rows: DataFrame, quotas: dict[str, int], limit: int, per_host: int = 4, per_event: int = 2) -> DataFrame:
    """A cohort of ``limit`` rows by quotas per stratum, with caps per host and event, then filled up in order.

    rows: artifact_id, stratum, host, event, score. Quotas are scaled by limit / 30 and are 1 at
    least. The choice is sequential and made by one task, from what it can come to, which is cut out in
    parallel. A row is passed over only if its host or event is used up. At most limit / per_host
    hosts and limit / per_event events ever are; of a host the first limit + per_host rows are enough, since
    no more than limit of them can belong to events that are used up, and of an event likewise. So of a
    stratum, and of all rows, some (limit / per_host)(limit + per_host) + (limit / per_event)(limit +
    per_event) + 2 limit rows decide, however many there are.
    """
    order = [F.asc("score"), F.asc("artifact_id")]
    enough = -(-limit // per_host) * (limit + per_host) + -(-limit // per_event) * (limit + per_event) + 2 * limit

    def first(df: DataFrame, by: list[str]) -> DataFrame:
        for keys, most in ((["host", "event"], min(per_host, per_event)), (["host"], limit + per_host), (["event"], limit + per_event)):
            df = df.withColumn("_k", F.row_number().over(W.partitionBy(*by, *keys).orderBy(*order))).where(F.col("_k") <= most).drop("_k")
        return df

    own = first(rows, ["stratum"]).where(F.col("stratum").isin(*quotas)).withColumn("_k", F.row_number().over(W.partitionBy("stratum").orderBy(*order))).where(F.col("_k") <= enough).drop("_k")
    near = own.unionByName(first(rows, []).orderBy(*order).limit(enough)).dropDuplicates(["artifact_id"])
    scaled = {k: max(1, round(v * limit / 30)) for k, v in quotas.items()}

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "artifact_id"], kind="stable").reset_index(drop=True)
        hosts: dict = {}
        events: dict = {}
        taken: list[int] = []

        def fits(k: int) -> bool:
            return hosts.get(pdf.host[k], 0) < per_host and events.get(pdf.event[k], 0) < per_event

        def take(k: int) -> None:
            hosts[pdf.host[k]] = hosts.get(pdf.host[k], 0) + 1
            events[pdf.event[k]] = events.get(pdf.event[k], 0) + 1
            taken.append(k)

        for stratum, quota in scaled.items():
            left = min(quota, limit - len(taken))
            for k in pdf.index[pdf.stratum == stratum]:
                if left <= 0:
                    break
                if fits(k):
                    take(k)
                    left -= 1
        chosen = set(taken)
        for k in pdf.index:
            if len(taken) >= limit:
                break
            if k not in chosen and fits(k):
                take(k)
        return pdf.loc[taken].assign(place=range(1, len(taken) + 1))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", place long"
    columns = list(rows.columns)
    return near.select(*columns).groupBy(F.lit(1).alias("_all")).applyInPandas(lambda pdf: choose(pdf[columns]), schema)


def explicit_selection(wanted: DataFrame, known: DataFrame, fetched: DataFrame) -> DataFrame:
    """(artifact_id, state) of explicitly named ids: selected, missing, or unbound (known but never observed)."""
    j = wanted.select("artifact_id").distinct().join(known.select("artifact_id", F.lit(True).alias("_k")).distinct(), "artifact_id", "left").join(fetched.select("artifact_id", F.lit(True).alias("_f")).distinct(), "artifact_id", "left")
    return j.select("artifact_id", F.when(F.col("_k").isNull(), "missing").when(F.col("_f").isNull(), "unbound").otherwise("selected").alias("state"))


def like_search(rows: DataFrame, column: str, needle: str) -> DataFrame:
    """Rows that hold the needle, in which % and _ are ordinary characters."""
    safe = needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return rows.where(F.lower(column).like(f"%{safe.lower()}%"))
