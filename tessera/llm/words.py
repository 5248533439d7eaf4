"""Byte tables shared by the operators that cut text into words."""

from __future__ import annotations

import pyarrow as pa

#: Lower-cases A-Z and keeps every other byte.
LOWER = bytes(range(256)).translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))
#: Lower-cases A-Z and makes every ASCII byte but 0-9 and a-z a space: what splits on space is [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    if pa.types.is_null(column.type):
        return [b""] * len(column)
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
