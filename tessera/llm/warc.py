"""WARC archives of pages: written once per payload with revisits, read back by boundary-chain verification.

An archive is a text file of Spark's writer, so it is committed, retried and stored like any other
table; a record is ``WARC/1.1``, headers, block, and two line ends. It is read by Spark's splittable
text reader with the magic as line separator: a piece is what stands between two magics, whether they begin
a record or lie in a payload.

* Each task reads splits and emits, for each piece that has a whole header, a candidate: its offset
  in the split, the offset of its successor by Content-Length, and the offset at which a chain that goes through it
  leaves the split. What pieces and magics of the splits before take together turns them into
  offsets in the file.
* A chain of records from the start of a file enters each split in one place. Entries are found by pointer
  jumping over the exits: pointers double each round, so a file of n splits takes log2(n) rounds, whatever
  its records.
* From its entry each split is walked once; candidates that are not met are magics inside payloads and go. A
  payload that holds magics is put together from its pieces, which a second read fetches only if
  there is such a record.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import Scratch, join_checked, ship

VERSION = "1.1"
END = "\r\n\r\n"
#: The digits of base 32 of RFC 4648, in order. Fixed values.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "<urn:x-page:"
PIECES = "file string, split long, rel long, next_rel long, succ_rel long, total long, starts binary, succs binary, kind string, record_id string, refers_to string, target string, payload_bytes long, payload_digest string, whole boolean, payload binary, content binary"


def base32(hexed: Column) -> Column:
    """Upper-case base 32 of 40 hex digits: five hex digits are four of base 32."""
    part = lambda i: F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0")
    return F.translate(F.concat(*map(part, range(8))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _uri(c: Column) -> Column:
    """A text as a header's value: controls, blanks, angles and slashes behind WARC in percent form, so that it has no line end and no magic."""
    for plain, coded in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), (" ", "%20"), ("<", "%3C"), (">", "%3E"), ("WARC/", "WARC%2F")):
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(value): the archive record of every row of pages, without the two line ends at its end.

    Of rows of equal payload that with the largest page_id is the response, and the others are
    revisits that name it. A null html is an empty payload, and empty payloads are equal as any others. Rows that
    have that page_id in common are all responses; a null page_id counts as less than any other. Rows are repeated as
    they are.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), body.alias("body"))
    keyed = rows.select("*", F.sha1(F.col("body").cast("binary")).alias("sha"), F.xxhash64("body").alias("check"), F.octet_length("body").cast("long").alias("bytes"))
    key = ["sha", "check", "bytes"]
    shared = keyed.groupBy(*key).agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    found = join_checked(spark, keyed, Scratch(spark).write(shared, "shared"), key, "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit(RECORD), F.coalesce(_uri(F.col(c).cast("string")), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("body")))
    header = F.concat_ws(
        "\r\n",
        F.lit(f"WARC/{VERSION}"),
        F.when(revisit, "WARC-Type: revisit").otherwise("WARC-Type: response"),
        F.concat(F.lit("WARC-Record-ID: "), name("page_id")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), _uri(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("sha"))),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name("first"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))).cast("string")),
    )
    return found.select(F.concat(header, F.lit(END), block).alias("value"))


def write(pages: DataFrame, path: str, **named: str) -> None:
    """Write the records of pages below path, a file per task."""
    records(pages, **named).write.text(path, lineSep=END)


_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d{1,18})[ \t]*\r?$")
_FIELDS = re.compile(rb"(?im)^(warc-type|warc-record-id|warc-refers-to|warc-target-uri|warc-payload-digest|content-type):[ \t]*(.*?)[ \t]*\r?$")


def _parsed(header: bytes, block: bytes | None, keep: bool) -> dict:
    """What a record says; block is None if it isn't at hand whole.

    The payload is what follows the HTTP header, or the whole block where there is none. A revisit has no
    payload of its own: its digest is the one declared, its length that of the HTTP header.
    """
    field = {k.lower(): v.decode("utf-8", "replace") for k, v in reversed(_FIELDS.findall(header))}
    out = {"kind": field.get(b"warc-type"), "record_id": field.get(b"warc-record-id"), "refers_to": field.get(b"warc-refers-to"), "target": field.get(b"warc-target-uri"), "whole": block is not None}
    if block is None:
        return out
    cut = block.find(b"\r\n\r\n") + 4 if field.get(b"content-type", "").startswith("application/http") else 0
    head, body = (block[:cut], block[cut:]) if cut > 3 else (b"", block)
    if out["kind"] == "revisit":
        told = _LENGTH.search(head)
        out["payload_bytes"] = int(told[1]) if told else None
        out["payload_digest"] = field.get(b"warc-payload-digest", "").removeprefix("sha1:") or None
    else:
        out["payload_bytes"] = len(body)
        out["payload_digest"] = base64.b32encode(hashlib.sha1(body).digest()).decode()
        if keep:
            out["payload"] = body
    return out


def _scan(spark: SparkSession, path: str, magic: bytes, payload: bool, contents: bool, trailing: int = len(END)) -> DataFrame:
    """Rows of PIECES: one per piece, and a summary per split with its ``total`` bytes and the starts and successors of its candidates.

    Offsets are of the magic, counted from where the first piece of the split begins. With ``contents`` the rows are
    the pieces' bytes and no more.
    """
    ship(spark)
    schema = spark.createDataFrame([], PIECES).schema
    names = schema.fieldNames()
    arrow = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}[schema[n].dataType.simpleString()]) for n in names])
    text = spark.read.text(path, lineSep=magic.decode())
    text = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))
    m = len(magic)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, starts, succs = None, [], [], []
        place = room = 0
        size_of = lambda row: len(row.get("content") or row.get("payload") or b"")

        def summary() -> dict:
            return {"file": at[0], "split": at[1], "total": place, "starts": np.array(starts, "<i8").tobytes(), "succs": np.array(succs, "<i8").tobytes()}

        def table(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema=arrow)

        for b in batches:
            files, splits, values = b.column(0), b.column(1), b.column(2)
            for i in range(b.num_rows):
                key = (files[i].as_py(), splits[i].as_py())
                if key != at:
                    if at:
                        held.append(summary())
                    at, starts, succs, place = key, [], [], 0
                piece = values[i].as_py()
                begin, place = place - m, place + len(piece) + m
                row = {"file": key[0], "split": key[1], "rel": begin, "next_rel": place - m}
                if contents:
                    held.append(row | {"content": piece})
                else:
                    end = piece.find(b"\r\n\r\n")
                    size = _LENGTH.search(piece, 0, end + 2) if end >= 0 else None
                    if size:
                        stop = end + 4 + int(size[1])
                        whole = stop <= len(piece)
                        row["succ_rel"] = begin + m + stop + trailing
                        starts.append(begin)
                        succs.append(row["succ_rel"])
                        row |= _parsed(piece[:end], piece[end + 4 : stop] if whole else None, payload)
                    held.append(row)
                size = size_of(row)
                if len(held) >= 4096 or room + size > 8_000_000:
                    yield table(held)
                    held, room = [], 0
                else:
                    room += size
        if at:
            held.append(summary())
        if held:
            yield table(held)

    return text.mapInArrow(run, schema)


def _exits(starts: bytes, succs: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates of a split in ascending order, their successors, and where a chain through each leaves the split's candidates, found from the last to the first."""
    s, t = np.frombuffer(starts, "<i8"), np.frombuffer(succs, "<i8")
    place = np.searchsorted(s, t)
    inside = (place < len(s)) & (s[np.minimum(place, max(len(s) - 1, 0))] == t) if len(s) else np.zeros(0, bool)
    out = t.copy()
    for i in range(len(s) - 1, -1, -1):
        if inside[i]:
            out[i] = out[place[i]]
    return s, t, out


def reachable(spark: SparkSession, splits: DataFrame) -> DataFrame:
    """(file, offset, end): candidates that the chain from the start of their file meets.

    ``splits`` are (file, split, start, starts, succs), start being the offset of the split's first piece in the file.
    """
    ship(spark)
    scratch = Scratch(spark)

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                s, _, x = _exits(r["starts"], r["succs"])
                yield pa.RecordBatch.from_arrays([pa.array([r["file"]] * len(s), pa.string()), pa.array(s + r["start"]), pa.array(x + r["start"]), pa.array(np.full(len(s), r["split"], "<i8"))], ["file", "offset", "jump", "split"])

    columns = splits.select("file", "split", "start", "starts", "succs")
    every = columns.mapInArrow(leave, "file string, offset long, jump long, split long")
    jumps = scratch.write(every, "exits")
    entries = jumps.select("file", F.col("jump").alias("offset")).union(jumps.select("file", F.lit(0).cast("long").alias("offset"))).distinct()
    state = jumps.join(entries, ["file", "offset"]).select("*", (F.col("offset") == 0).alias("met"))
    state = scratch.write(state, "entries")
    while True:
        ahead = state.select("file", F.col("offset").alias("jump"), F.col("jump").alias("far"))
        moved = state.join(ahead, ["file", "jump"], "left").select("file", "offset", "split", F.coalesce("far", "jump").alias("jump"), "met", F.when(F.col("met"), F.col("jump")).alias("says"), F.col("far").isNotNull().alias("goes"))
        moved = scratch.write(moved, "moved")
        said = moved.where(F.col("says").isNotNull()).select("file", F.col("says").alias("offset")).distinct().withColumn("told", F.lit(True))
        state = scratch.write(moved.join(said, ["file", "offset"], "left").select("file", "offset", "split", "jump", (F.col("met") | F.coalesce("told", F.lit(False))).alias("met"), "goes"), "entries")
        if not state.where("goes").limit(1).count():
            break
        state = state.drop("goes")
    begun = state.where("met").select("file", "split", "offset")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                s, t = np.frombuffer(r["starts"], "<i8"), np.frombuffer(r["succs"], "<i8")
                place, seen = np.searchsorted(s, t), []
                i = int(np.searchsorted(s, r["offset"] - r["start"]))
                while i < len(s):
                    seen.append(i)
                    j = int(place[i])
                    i = j if j < len(s) and s[j] == t[i] else len(s)
                seen = np.array(seen, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([r["file"]] * len(seen), pa.string()), pa.array(s[seen] + r["start"]), pa.array(t[seen] + r["start"])], ["file", "offset", "end"])

    return columns.join(begun, ["file", "split"]).mapInArrow(walk, "file string, offset long, end long").distinct()


def _assembled(spark: SparkSession, path: str, magic: bytes, payload: bool, spread: DataFrame, owned: DataFrame, starts: DataFrame) -> DataFrame:
    """The records of ``spread`` (file, offset, end), put together from the pieces that ``owned`` (file, offset, owner) gives them."""
    pieces = _scan(spark, path, magic, payload, True).where("content is not null").join(starts, ["file", "split"]).select("file", (F.col("rel") + F.col("start")).alias("offset"), "content")
    parts = join_checked(spark, pieces, owned, ["file", "offset"], "inner")
    parts = parts.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("offset", "content"))).alias("parts"))
    rows = parts.join(spread.withColumnRenamed("offset", "owner"), ["file", "owner"]).select("file", F.col("owner").alias("offset"), "end", F.col("parts.content").alias("parts"))
    schema = spark.createDataFrame([], "file string, offset long, end long, kind string, record_id string, refers_to string, target string, payload_bytes long, payload_digest string, payload binary").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                whole = magic.join(r["parts"])
                cut = whole.find(b"\r\n\r\n")
                size = int(_LENGTH.search(whole, 0, cut + 2)[1])
                got = _parsed(whole[:cut], whole[cut + 4 : cut + 4 + size], payload)
                row = {k: r.get(k, got.get(k)) for k in schema.fieldNames()}
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in schema]))

    return rows.mapInArrow(run, schema)


def read(spark: SparkSession, path: str, payload: bool = True, version: str = VERSION) -> DataFrame:
    """The records of the archives below path: (file, offset, end, kind, record_id, refers_to, target, payload_bytes, payload_digest, payload).

    Only records that the chain from the start of their file meets. payload is null for revisits, and for all
    with ``payload=False``, which computes lengths and digests where the bytes are read. Files must be of one version,
    without compression. A chain that meets no record where one should be ends there: see broken(). A header
    line must not end with the magic; write() sees to that. Empty files have no records.
    """
    magic = f"WARC/{version}\r\n".encode()
    scratch = Scratch(spark)
    found = scratch.write(_scan(spark, path, magic, payload, False).drop("content"), "pieces")
    begun = F.coalesce(F.sum("total").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    summary = found.where("total is not null").select("file", "split", "starts", "succs", "total")
    splits = scratch.write(summary.select("*", begun.alias("start")), "splits")
    starts = splits.select("file", "split", "start")
    met = scratch.write(reachable(spark, splits), "met")
    pieces = found.where("total is null").join(starts, ["file", "split"]).withColumn("offset", F.col("rel") + F.col("start"))
    fields = ["kind", "record_id", "refers_to", "target", "payload_bytes", "payload_digest", "payload"]
    told = pieces.join(met, ["file", "offset"]).where("whole").select("file", "offset", "end", *fields)
    spread = scratch.write(pieces.join(met, ["file", "offset"]).where("not whole").select("file", "offset", "end"), "spread")
    if not spread.limit(1).count():
        return told
    return told.unionByName(_assembled(spark, path, magic, payload, spread, _owners(spark, pieces, met, splits), starts))


def _owners(spark: SparkSession, pieces: DataFrame, met: DataFrame, splits: DataFrame) -> DataFrame:
    """(file, offset, owner): the record that each piece belongs to, by pointer jumping from rejected pieces to the piece before."""
    scratch = Scratch(spark)
    follows = pieces.select("file", F.col("offset").alias("before"), (F.col("next_rel") + F.col("start")).alias("offset"))
    true = met.select("file", "offset", F.col("offset").alias("owner"))
    loose = pieces.select("file", "offset").join(met, ["file", "offset"], "left_anti").join(follows, ["file", "offset"])
    state = scratch.write(loose.select("file", "offset", F.col("before").alias("owner")), "loose")
    while True:
        ahead = state.select("file", F.col("offset").alias("owner"), F.col("owner").alias("far"))
        state = scratch.write(state.join(ahead, ["file", "owner"], "left").select("file", "offset", F.coalesce("far", "owner").alias("owner"), F.col("far").isNotNull().alias("goes")), "loose")
        if not state.where("goes").limit(1).count():
            return scratch.write(state.drop("goes").union(true), "owners")
        state = state.drop("goes")


def broken(spark: SparkSession, path: str, version: str = VERSION) -> DataFrame:
    """(file, offset): where the chain of a file ends before the file does, or 0 where it has no beginning."""
    got = read(spark, path, False, version).groupBy("file").agg(F.max("end").alias("offset"))
    sizes = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("size"))
    return sizes.join(got, "file", "left").select("file", F.coalesce("offset", F.lit(0)).alias("offset"), "size").where("offset < size").drop("size")


def page_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) per row of pages, as read back from archives written in the shared folder."""
    spark = pages.sparkSession
    path = Scratch(spark).path("warc")
    write(pages, path, page_id=page_id, url=url, html=html)
    kind = pages.schema[page_id].dataType
    plain = lambda c: F.nullif(F.url_decode(F.replace(F.regexp_extract(c, f"^{RECORD}(.*)>$", 1), F.lit("+"), F.lit("%2B"))), F.lit("")).cast(kind)
    return read(spark, path, payload=False).select(
        plain("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), plain("refers_to").alias("refers_to")
    )


#: DuckDB SQL of page_records.
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, body, sha1(body) AS sha, max(page_id) OVER (PARTITION BY body) AS last FROM p),
s AS (
  SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(sha, CAST(5 * i + 1 AS INTEGER), 5) AS BIGINT)) AS parts FROM d
)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(parts, lambda v: concat(
    {", ".join(f"substr('{BASE32}', CAST((v >> {n}) & 31 AS INTEGER) + 1, 1)" for n in (15, 10, 5, 0))})), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM s"""
