"""Pages of a provider, read along their cursors from recorded responses: a Spark data source for batches and streams.

    record(responses, path, "2024-01-01")
    spark.dataSource.register(RecordedPages)
    spark.read.format("recorded_pages").option("path", path).load()

A recording is a folder of JSON lines below ``path``; its name has to come after those of earlier ones, since a stream
goes on behind the last that it has read. Options: ``field``, the list that a page must have (default tweets);
``attempts`` per page (4); ``wait``, to sleep as the provider asks (false); ``mode``: record, where
a fault is a row, or fail, where it raises. Pages of a source are asked for one after another by one task, as a
provider gives them, which holds the source's cursors and one page; snapshots.page_order places pages
of any number by joins instead.
"""

from __future__ import annotations

import io
import json
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tessera.session import ship

SCHEMA = "source string, place long, cursor string, next_cursor string, has_next boolean, items long, body string, attempts int, waited double, fault string, retryable boolean"
#: Statuses after which a later run may ask again, and the longest pause in seconds.
RETRYABLE_STATUS = (408, 409, 425, 429, 500, 502, 503, 504)
LONGEST_WAIT = 60.0


class PagerFault(RuntimeError):
    """A page that can't be taken, where the caller wants none."""


def record(responses: DataFrame, path: str, name: str) -> None:
    """Write responses as the recording ``name``; a source is whole in one file.

    responses: source, cursor (empty or null: the first page), attempt (from 1), status (null: no answer), retry_after, body.
    """
    ship(responses.sparkSession)
    rows = responses.select(
        F.col("source").cast("string").alias("source"),
        F.coalesce("cursor", F.lit("")).alias("cursor"),
        F.col("attempt").cast("int").alias("attempt"),
        F.col("status").cast("int").alias("status"),
        F.col("retry_after").cast("string").alias("retry_after"),
        "body",
    )
    rows.repartition("source").sortWithinPartitions("source", "cursor", "attempt").write.json(f"{path.rstrip('/')}/{name}")


@dataclass
class Recording(InputPartition):
    path: str


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", path.rstrip("/")))


def recordings(path: str) -> list[str]:
    """Names of recordings that are whole, in order."""
    from pyarrow import fs

    store, root = _store(path)
    names = [f.base_name for f in store.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.Directory]
    return sorted(n for n in names if store.get_file_info(f"{root}/{n}/_SUCCESS").type == fs.FileType.File)


def _files(path: str, names: list[str]) -> list[Recording]:
    from pyarrow import fs

    store, root = _store(path)
    found = [f.path for n in names for f in store.get_file_info(fs.FileSelector(f"{root}/{n}"))]
    return [Recording(p) for p in found if re.search(r"/part-[^/]*\.json$", p)]


def pause(retry_after: str | None, attempt: int) -> float:
    """Seconds before the next attempt: what the provider says, else 2^attempt; at most LONGEST_WAIT."""
    try:
        asked = float(retry_after) if retry_after else 2.0**attempt
    except ValueError:
        asked = 2.0**attempt
    return max(0.0, min(asked, LONGEST_WAIT))


def opened(body: str | None, field: str) -> tuple[dict, str | None, bool]:
    """(page, fault, retryable) of a body."""
    try:
        page = json.loads(body or "")
    except ValueError:
        return {}, "provider_json", True
    if not isinstance(page, dict):
        return {}, "provider_shape", True
    if page.get("status") == "error":
        return page, "provider_error", False
    return (page, None, False) if isinstance(page.get(field), list) else (page, "provider_shape", True)


class _Reader:
    def __init__(self, options):
        self.path = options["path"]
        self.field = options.get("field", "tweets")
        self.most = int(options.get("attempts", "4"))
        self.wait = options.get("wait", "false").lower() == "true"
        self.fail = options.get("mode", "record").lower() == "fail"

    def read(self, partition: Recording) -> Iterator[tuple]:
        store, _ = _store(self.path)
        with store.open_input_file(partition.path) as file, io.BufferedReader(file, 1 << 16) as f:
            for source, where in self._sources(f):
                yield from self._walk(f, source, where)

    def _sources(self, f) -> Iterator[tuple[str, dict[str, list[int]]]]:
        """(source, cursor -> offsets of its attempts): the file is in order of sources and attempts."""
        source, where, at = None, {}, 0
        while True:
            f.seek(at)
            line = f.readline()
            row = json.loads(line) if line else {}
            if source is not None and row.get("source") != source:
                yield source, where
                where = {}
            if not line:
                return
            source = row["source"]
            where.setdefault(row["cursor"], []).append(at)
            at += len(line)

    def _page(self, f, offsets: list[int]) -> tuple[str | None, int, float, str | None, bool]:
        """(body, attempts, waited, fault, retryable) of a page."""
        waited, tried = 0.0, 0
        for tried, at in enumerate(offsets[: self.most], 1):
            f.seek(at)
            row = json.loads(f.readline())
            status = row.get("status")
            if status == 429 and tried < self.most:
                pausing = pause(row.get("retry_after"), tried - 1)
                waited += pausing
                if self.wait:
                    time.sleep(pausing)
                continue
            if status is None:
                return None, tried, waited, "network", True
            if status != 200:
                return None, tried, waited, "provider_http", status in RETRYABLE_STATUS
            return row.get("body"), tried, waited, None, False
        return None, tried, waited, "not_recorded", True

    def _walk(self, f, source: str, where: dict[str, list[int]]) -> Iterator[tuple]:
        cursor, place, seen = "", 0, set()
        while True:
            place += 1
            body, attempts, waited, fault, retryable = self._page(f, where.get(cursor, []))
            page, items = {}, None
            if fault is None:
                page, fault, retryable = opened(body, self.field)
                items = None if fault else len(page[self.field])
            more = bool(page.get("has_next_page"))
            following = str(page.get("next_cursor") or "")
            if fault is None and more and (not following or following in seen):
                fault, retryable = "cursor_repeat" if following else "cursor_missing", True
            if fault and self.fail:
                raise PagerFault(f"{fault}: source {source}, cursor {cursor!r}")
            yield source, place, cursor, following or None, more, items, body, attempts, waited, fault, retryable
            if fault or not more:
                return
            seen.add(following)
            cursor = following


class _Batch(_Reader, DataSourceReader):
    def partitions(self) -> list[Recording]:
        return _files(self.path, recordings(self.path))


class _Stream(_Reader, DataSourceStreamReader):
    """An offset is the name of the last recording."""

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max(recordings(self.path), default="")}

    def partitions(self, start: dict, end: dict) -> list[Recording]:
        return _files(self.path, [n for n in recordings(self.path) if start["after"] < n <= end["after"]])


class RecordedPages(DataSource):
    """(source, place, cursor, next_cursor, has_next, items, body, attempts, waited, fault, retryable): a row per page asked for.

    A fault ends its source: network, provider_http, provider_json, provider_error, provider_shape, cursor_missing, cursor_repeat, or
    not_recorded, where a page points to one that was never asked for.
    """

    @classmethod
    def name(cls) -> str:
        return "recorded_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)
