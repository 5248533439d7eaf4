"""Content addresses: SHA-256 of canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(*values: Column) -> Column:
    """A JSON array of strings and numbers without blanks; nulls as null."""
    parts = [F.coalesce(F.to_json(F.array(v)), F.lit("[null]")) for v in values]
    return F.concat(F.lit("["), F.concat_ws(",", *[F.substring(p, F.lit(2), F.length(p) - 2) for p in parts]), F.lit("]"))


def content_id(*values: Column) -> Column:
    """SHA-256 in hex of canonical()."""
    return F.sha2(canonical(*values).cast("binary"), 256)


def fingerprint(df, *keys: str) -> Column:
    """An order-free aggregate address of all rows' keys, for groupBy().agg: SHA-256 over the sorted rows' digests.

    Rows are reduced to a sum of digest halves before, so no task gathers the rows: equal multisets
    have equal fingerprints.
    """
    d = F.sha2(F.to_json(F.struct(*[F.col(k) for k in sorted(keys)]), {"ignoreNullFields": "false"}).cast("binary"), 256)
    half = lambda a: F.conv(F.substring(d, a, 15), 16, 10).cast("decimal(38,0)")
    return F.sha2(F.concat_ws(":", F.count("*"), *[F.sum(half(a)) for a in (1, 16, 31, 46)]).cast("binary"), 256)


def shard(x: Column, shards: int) -> Column:
    """First 8 bytes of SHA-256 as a big-endian number, modulo shards."""
    return (F.conv(F.substring(F.sha2(x.cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)") % shards).cast("long")
