"""Licence scans by canonical digest lookup, in DataFrame functions only.

A text is brought to a canonical form: lower case, no copyright lines, equivalent spellings made one,
everything but letters and digits made one blank. The SHA-256 of that form is hash-joined with the
digests of known licences. Whole texts are looked up, and so is every line that has a letter or a
digit, since documents state their licence in a line of its own.

The table of known digests is broadcast only if it is small (it is counted first), else shuffled.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import join_checked

#: Known digests that may be broadcast; some 100 bytes each.
BROADCAST_ROWS = 100_000
COPYRIGHT = "^[^a-z0-9©]*(copyright *(\\(c\\)|©|[0-9]{4}|by |$)|\\(c\\) *[0-9]{4}|©|all rights reserved[^a-z]*$)"
#: Equivalent spellings, applied in order to lower-case text.
SPELLINGS = (
    ("licence", "license"),
    ("sub-licens", "sublicens"),
    ("sub licens", "sublicens"),
    ("non-commercial", "noncommercial"),
    ("copyright owner", "copyright holder"),
    ("favour", "favor"),
    ("per cent", "percent"),
    ("http://", "https://"),
    ("&", " and "),
)
#: Lines that the SQL looks up; scan() looks up all.
TRIGGER = "licen[sc]e|permission|public domain"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_0BSD = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD3 = _BSD2.replace("THIS SOFTWARE IS PROVIDED", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\nTHIS SOFTWARE IS PROVIDED")
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org/>"""

#: Identifiers and texts of known licences, with and without their titles, and one-line notices.
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n" + _ISC),
    ("0BSD", _0BSD),
    ("0BSD", "BSD Zero Clause License\n" + _0BSD),
    ("BSD-2-Clause", _BSD2),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD2),
    ("BSD-3-Clause", _BSD3),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD3),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
)

#: Identifiers of the whole texts in the folder licence_texts, by file.
TEXTS = {
    "Apache-2.0": "Apache-2.0",
    "Artistic": "Artistic-1.0-Perl",
    "BSD": "BSD-3-Clause",
    "CC0-1.0": "CC0-1.0",
    "GFDL-1.2": "GFDL-1.2-only",
    "GFDL-1.3": "GFDL-1.3-only",
    "GPL-1": "GPL-1.0-only",
    "GPL-2": "GPL-2.0-only",
    "GPL-3": "GPL-3.0-only",
    "LGPL-2": "LGPL-2.0-only",
    "LGPL-2.1": "LGPL-2.1-only",
    "LGPL-3": "LGPL-3.0-only",
    "MPL-1.1": "MPL-1.1",
    "MPL-2.0": "MPL-2.0",
}
#: What ends the terms of a text; the advice on how to apply them that follows is often left out.
CLOSING = "END OF TERMS AND CONDITIONS"


def known_texts() -> list[tuple[str, str]]:
    """(license_id, text): KNOWN, and the texts of TEXTS, where they have a closing line also cut behind and before it."""
    out = [*KNOWN]
    for name, license_id in TEXTS.items():
        text = (Path(__file__).with_name("licence_texts") / name).read_text(encoding="utf-8")
        out.append((license_id, text))
        terms, closing, _ = text.partition(CLOSING)
        if closing:
            out += [(license_id, terms + closing), (license_id, terms)]
    return out


def canonical(text: Column) -> Column:
    """The canonical form of a text column."""
    kept = F.array_join(F.filter(F.split(F.lower(text), "\n"), lambda x: ~x.rlike(COPYRIGHT)), "\n")
    for was, to in SPELLINGS:
        kept = F.replace(kept, F.lit(was), F.lit(to))
    return F.trim(F.regexp_replace(kept, "[^\\p{L}\\p{N}]+", " "))


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form, null for texts without letters and digits."""
    return F.sha2(F.nullif(canonical(text), F.lit("")).cast("binary"), 256)


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """(digest, license_id), one row per digest: of a DataFrame (license_id, text), by default known_texts().

    Of several identifiers with one digest the least stays.
    """
    known = spark.createDataFrame(known_texts(), "license_id string, text string") if known is None else known
    rows = known.select(digest(F.col("text")).alias("digest"), "license_id").where("digest is not null and license_id is not null")
    return rows.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, license_id, n_license_lines, line_licenses) for every row of docs.

    digest is that of the whole text (null for a null text and for one without letters and digits),
    license_id the known licence it is, or null. n_license_lines counts the lines that are known
    licences or notices, line_licenses has their identifiers, distinct and sorted, joined by commas
    (empty if none).

    Rows are told apart by their id and the digest of their text as it is, so a task that runs again
    finds the same groups. Repeated rows stay: they make one group, which is written out as often as
    it has whole texts.
    """
    spark = docs.sparkSession
    units_type = "array<struct<w:boolean,d:string>>"
    table = known_digests(spark, known)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    lines = F.array_compact(F.transform(F.split("_text", "\n"), digest))
    whole = F.struct(F.lit(True).alias("w"), F.col("_digest").alias("d"))
    part = F.transform("_lines", lambda x: F.struct(F.lit(False).alias("w"), x.alias("d")))
    rows = rows.select("doc_id", F.sha2(F.col("_text").cast("binary"), 256).alias("_row"), digest(F.col("_text")).alias("_digest"), lines.alias("_lines"))
    units = rows.select("doc_id", "_row", "_digest", F.explode(F.concat(F.array(whole), F.coalesce(part, F.array().cast(units_type)))).alias("u"))
    units = units.select("doc_id", "_row", "_digest", F.col("u.w").alias("_is_whole"), F.col("u.d").alias("digest"))
    found = join_checked(spark, units, table, ["digest"], "left", BROADCAST_ROWS)
    line = ~F.col("_is_whole") & F.col("license_id").isNotNull()
    out = found.groupBy("doc_id", "_row", "_digest").agg(
        F.count_if("_is_whole").alias("_rows"),
        F.max(F.when(F.col("_is_whole"), F.col("license_id"))).alias("license_id"),
        F.count_if(line).alias("_n"),
        F.array_join(F.sort_array(F.collect_set(F.when(line, F.col("license_id")))), ",").alias("line_licenses"),
    )
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))))
    return out.select("doc_id", F.col("_digest").alias("digest"), "license_id", F.expr("_n div _rows").alias("n_license_lines"), "line_licenses")


def _sql_canonical(x: str) -> str:
    kept = f"array_to_string(list_filter(string_split(lower({x}), chr(10)), lambda y: NOT regexp_matches(y, '{COPYRIGHT}')), chr(10))"
    for was, to in SPELLINGS:
        kept = f"replace({kept}, '{was}', '{to}')"
    return f"trim(regexp_replace({kept}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


SQL = f"""
WITH known AS (SELECT sha256({_sql_canonical("t")}) AS digest, min(id) AS license_id FROM (VALUES {", ".join(f"({_sql_text(i)}, {_sql_text(t)})" for i, t in KNOWN)}) AS k(id, t) GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, text, {_sql_canonical("text")} AS c FROM documents),
w AS (SELECT r, doc_id, CASE WHEN c <> '' THEN sha256(c) END AS digest, text FROM d),
u AS (SELECT r, {_sql_canonical("x")} AS c FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM w) WHERE regexp_matches(lower(x), '{TRIGGER}')),
l AS (SELECT r, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids FROM u JOIN known ON known.digest = sha256(u.c) WHERE u.c <> '' GROUP BY r)
SELECT doc_id, w.digest, license_id, coalesce(n, 0)::BIGINT AS n_license_lines, coalesce(ids, '') AS line_licenses
FROM w LEFT JOIN known ON known.digest = w.digest LEFT JOIN l USING (r)
"""
