"""Streaming counterparts: day windows with a watermark, first observations, exactly-once sinks, leases.

Batch operators of this package serve as the reference: each stream's final result equals theirs over
the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from tessera.operators import publication


def day_counts(stream: DataFrame, ts: str = "ts", keys: tuple[str, ...] = ("event_type",), late: str = "1 day", days: str = "1 day", slide: str | None = None) -> DataFrame:
    """(window_start, keys, n, total): tumbling or sliding windows of days; rows later than ``late`` are dropped."""
    w = F.window(F.col(ts).cast("timestamp"), days, slide) if slide else F.window(F.col(ts).cast("timestamp"), days)
    marked = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return marked.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(stream: DataFrame, ts: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(key, session_start, session_end, n): sessions that a pause of ``gap`` ends."""
    marked = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return marked.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def first_within(stream: DataFrame, keys: list[str], ts: str = "ts", late: str = "7 days") -> DataFrame:
    """The first row per key inside the watermark: later ones add nothing."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def once_sink(root: str, keys: list[str], contract: str = "v1"):
    """A foreachBatch function that writes a batch under its content's name, so that a batch run again writes nothing."""

    def write(batch: DataFrame, _epoch: int) -> None:
        batch.persist()
        try:
            if batch.limit(1).count():
                publication.materialise(batch, root, publication.run_id(batch, keys, contract))
        finally:
            batch.unpersist()

    return write


LEASE_MINUTES, ATTEMPTS = 10, 3
NEW = ("pending", 0, None, "")
LEASED = "item long, status string, attempts long, reason string"


def replay(events: pd.DataFrame, state: tuple = NEW, lease: float = LEASE_MINUTES) -> tuple:
    """(status, attempts, lease_until, reason) after a work item's events in order (at, event).

    claim takes a pending or retryable item, or one whose lease ran out, if attempts are left; done closes a lease with
    success, fail with failed_retryable and reject with failed_terminal. A lease that ran out is failed_retryable for the
    reason lease_expired as soon as that is noticed, and what its holder still reports counts until another claims the item.
    """
    status, attempts, until, reason = state
    for at, event in zip(events["at"], events["event"]):
        if event == "claim":
            if status == "in_progress" and until is not None and at > until:
                status, until, reason = "failed_retryable", None, "lease_expired"
            if status in ("pending", "failed_retryable") and attempts < ATTEMPTS:
                status, attempts, until, reason = "in_progress", attempts + 1, at + pd.Timedelta(minutes=lease), ""
        elif status == "in_progress" or reason == "lease_expired":
            closed = {"done": "success", "fail": "failed_retryable", "reject": "failed_terminal"}.get(event)
            status, until, reason = (closed, None, "") if closed else (status, until, reason)
    return status, attempts, until, reason


def leases(events: DataFrame) -> DataFrame:
    """(item, status, attempts, reason) from a log item, at, seq, event, in one pass per item."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        status, attempts, _, reason = replay(pdf.sort_values(["at", "seq"]))
        return pd.DataFrame({"item": [pdf["item"].iloc[0]], "status": [status], "attempts": [attempts], "reason": [reason]})

    return events.groupBy("item").applyInPandas(run, LEASED)


class LeaseKeeper(StatefulProcessor):
    """One item's lease: events move it, and a timer of the processing clock ends it if none comes."""

    def __init__(self, lease: float):
        self.lease = lease

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("item", "status string, attempts long, until timestamp, reason string")

    def _now(self) -> tuple:
        status, attempts, until, reason = self.state.get() if self.state.exists() else NEW
        return status, attempts, pd.Timestamp(until) if until is not None else None, reason

    def _keep(self, key: tuple, now: tuple) -> pd.DataFrame:
        self.state.update((now[0], now[1], now[2].to_pydatetime() if now[2] is not None else None, now[3]))
        return pd.DataFrame({"item": [key[0]], "status": [now[0]], "attempts": [now[1]], "reason": [now[3]]})

    def _clear(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        before = self._now()
        now = replay(pd.concat(list(rows)).sort_values(["at", "seq"]), before, self.lease)
        if now[1] != before[1] or now[0] != "in_progress":
            self._clear()
            if now[0] == "in_progress":
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.lease * 60_000))
        yield self._keep(key, now)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, attempts, _, reason = self._now()
        if status == "in_progress":
            yield self._keep(key, ("failed_retryable", attempts, None, "lease_expired"))

    def close(self) -> None:
        pass


def lease_stream(events: DataFrame, lease: float = LEASE_MINUTES) -> DataFrame:
    """leases() as a stream that emits items when events touch them, and when ``lease`` minutes pass after a claim without one.

    The session needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    return events.groupBy("item").transformWithStateInPandas(LeaseKeeper(lease), outputStructType=LEASED, outputMode="Update", timeMode="ProcessingTime")


def completed_runs(items: DataFrame, states: DataFrame) -> DataFrame:
    """(run_id, expected, success, failed_retryable, failed_terminal) from the states of a run's items.

    items: run_id, item. states: item, status, attempts; of several per item success counts, then terminal, then retryable
    failures, then the last attempt. An item in another state, or without one, has to be tried again.
    """
    ended = ("success", "failed_terminal", "failed_retryable")
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ended)), F.col("status")), F.lit(0))
    best = states.groupBy("item").agg(F.min_by("status", F.struct(F.when(rank == 0, len(ended) + 1).otherwise(rank), -F.col("attempts"))).alias("status"))
    j = items.select("run_id", "item").distinct().join(best, "item", "left")
    counts = {s: F.count_if(F.col("status") == s) for s in ("success", "failed_terminal")}
    told = j.groupBy("run_id").agg(F.count("*").alias("expected"), *[c.alias(s) for s, c in counts.items()])
    return told.select("run_id", "expected", "success", (F.col("expected") - F.col("success") - F.col("failed_terminal")).alias("failed_retryable"), "failed_terminal")
