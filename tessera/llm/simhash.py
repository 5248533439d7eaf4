"""SimHash near-duplicates by pivot distance tables.

A fingerprint holds 64 majority bits of the XXH64 hashes of a document's word shingles.
Fingerprints that differ in at most ``RADIUS`` bits are linked, and linked documents, directly or
through others, form a component.

A table is written that holds, for each distinct fingerprint, its Hamming distances to 45 reference
fingerprints. Candidate pairs come from that table: most references have bits in one of four blocks
only, so that what these distances say about a block can be told apart, and two fingerprints within two bits
agree on what they say about some pair of blocks (see candidates()). A pair with any coordinate that differs by more
than the radius is discarded, and survivors are verified by their exact distance.

Pairing a key costs the square of its fingerprints, so the pairs of a key that holds more than
``CROWD`` are not made. The exact way for these: each of their fingerprints is within 1 of 65
reference fingerprints of its own (itself and what one flipped bit makes of it), and two fingerprints
lie within 2 exactly if they share such a reference. Those that share one are linked to the
least of them: no link is lost, and a fingerprint makes 65 rows however large the crowd is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.words import LOWER, as_bytes
from tessera.operators.graph import components
from tessera.session import Scratch, ship, join_checked

SEED = 42
RADIUS = 2
BLOCKS = 4
CROWD = 48
#: Rows of one fingerprint beyond which its rows are not dealt by fingerprint; there are fewer such fingerprints than rows by this factor.
HOT = 10_000
#: Hashes whose bits are unpacked at once; bounds memory for texts of any length.
SLICE = 1 << 19


def hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of words of the lower-cased text, repeats included."""
    w = text.translate(LOWER).split()
    if not w:
        return np.empty(0, np.uint64)
    if len(w) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)], np.uint64)
    rows = zip(*(w[i:] for i in range(shingle))) if shingle > 1 else zip(w)
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, rows), repeat(SEED)), np.uint64, len(w) - shingle + 1)


def fingerprints(texts: list[bytes], shingle: int) -> np.ndarray:
    """A fingerprint per text as int64; a bit is set if it is set in over half the hashes."""
    out = np.zeros(len(texts), np.int64)
    held: list[np.ndarray] = []
    at: list[int] = []

    def flush() -> None:
        if held:
            sizes = np.fromiter(map(len, held), np.int64, len(held))
            bits = np.unpackbits(np.concatenate(held).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, np.r_[0, np.cumsum(sizes)[:-1]], axis=0, dtype=np.int32)
            out[at] = np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view("<i8")[:, 0]
        held.clear()
        at.clear()

    room = 0
    for i, text in enumerate(texts):
        h = hashes(text, shingle)
        if not len(h):
            continue
        if len(h) > SLICE:
            ones = sum(np.unpackbits(h[k : k + SLICE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for k in range(0, len(h), SLICE))
            out[i] = np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0]
            continue
        if room + len(h) > SLICE:
            flush()
            room = 0
        held.append(h)
        at.append(i)
        room += len(h)
    flush()
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int = 3) -> DataFrame:
    """The columns ``keep`` and ``_fp``, the fingerprint as a signed long.

    Null and empty texts, and texts of white space only, get fingerprint 0.
    """
    ship(docs.sparkSession)
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text"))
    schema = src.drop("_text").withColumn("_fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints(as_bytes(b.column(len(keep))), shingle)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(fp)], [*keep, "_fp"])

    return src.mapInArrow(run, schema)


def references(blocks: int = BLOCKS, each: int = 8, others: int = 12) -> list[int]:
    """Reference fingerprints, as signed longs: the zero word, ``each`` per block that have half the block's bits and no other, and ``others`` of random bits.

    They are drawn from XXH64 of their own index, so they are the same in every run.
    """
    width, out = 64 // blocks, [0]
    for b in range(blocks):
        for k in range(each):
            bits = sorted(range(width), key=lambda i: xxhash.xxh64_intdigest(bytes([b, k, i]), 7))[: width // 2]  # noqa: B023
            out.append(sum(1 << (width * b + i) for i in bits))
    out += [xxhash.xxh64_intdigest(i.to_bytes(4, "little"), 7) for i in range(others)]
    return [x - (1 << 64) if x >> 63 else x for x in out]


def pivot_table(distinct: DataFrame, refs: list[int]) -> DataFrame:
    """(_fp, _d): each fingerprint of ``distinct`` with its Hamming distances to the references."""
    return distinct.select("_fp", F.array(*[F.bit_count(F.col("_fp").bitwiseXOR(F.lit(r))).cast("byte") for r in refs]).alias("_d"))


def candidates(spark: SparkSession, table: DataFrame, crowd: int = CROWD, each: int = 8) -> tuple[DataFrame, DataFrame]:
    """(pairs, many) of a written pivot table: candidate pairs (u, v, _du, _dv), and the fingerprints (_fp) of crowded keys.

    A block's reference differs from the zero word in that block alone, so the difference of the two
    distances depends on that block's bits alone, and two bits change those differences in two
    blocks at most. So the differences of some pair of blocks are equal, and each pair of blocks
    makes an equi-join key. A key of more than ``crowd`` fingerprints is not paired.
    """
    zero = F.element_at("_d", 1)
    block = [F.transform(F.slice("_d", 2 + each * b, each), lambda x: x - zero) for b in range(BLOCKS)]
    keys = [F.struct(F.lit(k).alias("c"), F.xxhash64(block[i], block[j]).alias("k")) for k, (i, j) in enumerate(combinations(range(BLOCKS), 2))]
    keyed = table.select("_fp", F.explode(F.array(*keys)).alias("key")).select("_fp", "key.c", "key.k")
    scratch = Scratch(spark)
    keyed = scratch.write(keyed, "keyed")
    shared = scratch.write(keyed.groupBy("c", "k").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    rows = scratch.write(join_checked(spark, keyed, shared, ["c", "k"], "inner"), "rows")
    few = rows.where(F.col("n") <= crowd).select("c", "k", "_fp")
    told = few.select("_fp").distinct().join(table, "_fp")
    few = few.join(told, "_fp")
    left, right = (few.select("c", "k", F.col("_fp").alias(x), F.col("_d").alias(f"_d{x}")) for x in ("u", "v"))
    pairs = left.join(right, ["c", "k"]).where(F.col("u") < F.col("v")).drop("c", "k")
    return pairs, rows.where(F.col("n") > crowd).select("_fp").distinct()


def apart(most: int):
    """Whether two rows of the table are more than ``most`` apart in some coordinate: then the fingerprints are, too, by the triangle inequality."""
    return F.array_max(F.zip_with("_du", "_dv", lambda x, y: F.abs(x - y))) > most


def links(spark: SparkSession, distinct: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """(u, v): links among the fingerprints of ``distinct`` (_fp) that make the components of all links within radius 0, 1 or 2."""
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    table = Scratch(spark).write(pivot_table(distinct, references()), "pivots")
    pairs, many = candidates(spark, table, crowd)
    verified = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius
    paired = pairs.where(~apart(radius)).where(verified).select("u", "v")
    flips = [F.col("_fp")] + [F.col("_fp").bitwiseXOR(F.lit(np.int64(np.uint64(1 << b)).item() if b < 63 else -(1 << 63))) for b in range(64)]
    if radius < 2:
        flips = flips[: 1 + 64 * radius]
    named = many.select("_fp", F.explode(F.array(*flips)).alias("hub"))
    if radius == 1:  # a common name would reach distance 2: link a fingerprint to the neighbours that exist
        hub = named.where("hub != _fp").join(many.select(F.col("_fp").alias("hub")), "hub").select(F.least("_fp", "hub").alias("u"), F.greatest("_fp", "hub").alias("v"))
    else:
        least = named.groupBy("hub").agg(F.min("_fp").alias("u"), F.count("*").alias("n")).where("n > 1")
        hub = named.join(least.select("hub", "u"), "hub").where("u != _fp").select("u", F.col("_fp").alias("v"))
    return paired.union(hub).distinct()


def _hexed(fp: str):
    """A fingerprint as 16 hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    component_id is the least doc_id that links reach, the row's own included. A null text counts
    as empty; texts without words share fingerprint zero and are linked like any other. A row whose
    doc_id is null takes part in links and gets the least id that is not null (null if there is
    none). Repeated rows stay. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = scratch.write(with_fingerprint(docs, text, (doc_id,), shingle).withColumnRenamed(doc_id, "doc_id"), "fingerprints")
    classes = scratch.write(rows.groupBy("_fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    comp = components(spark, links(spark, classes.select("_fp"), radius, crowd)).withColumnRenamed("node", "_fp")
    grouped = classes.join(comp, "_fp", "left").withColumn("component", F.coalesce("component", "_fp"))
    best = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = scratch.write(grouped.join(best, "component").select("_fp", "n", "component_id"), "ids")
    hot, rest = ids.where(F.col("n") > HOT).select("_fp", "component_id"), ids.where(F.col("n") <= HOT).select("_fp", "component_id")
    few = join_checked(spark, rows, hot.select("_fp"), ["_fp"], "left_anti")
    out = few.join(rest, "_fp").unionByName(join_checked(spark, rows, hot, ["_fp"], "inner"))
    return out.select("doc_id", _hexed("_fp").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component: the one with the least doc_id, of repeated rows one.

    All columns stay. A row without a doc_id goes if its component has a row with one; of those left,
    one per fingerprint stays.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    found = scratch.write(near_duplicates(docs, doc_id, text, shingle, radius), "components")
    gone = scratch.write(found.where("doc_id != component_id").select(F.col("doc_id").alias(doc_id)).distinct(), "dropped")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = join_checked(spark, docs, gone, [doc_id], "left_anti").select(*columns)
    if found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").limit(1).count():
        kept = kept.where(F.col(f"`{doc_id}`").isNull()).unionByName(kept.where(F.col(f"`{doc_id}`").isNotNull()).dropDuplicates([doc_id]))
    if found.where("doc_id is null").limit(1).count():
        packed = docs.where(F.col(f"`{doc_id}`").isNull()).select(F.struct(*columns).alias("row"), F.col(f"`{text}`").alias("body"))
        told = found.where("doc_id is null and component_id is not null").select("fingerprint").distinct()
        loose = with_fingerprint(packed, "body", ("row",), shingle).withColumn("fingerprint", _hexed("_fp"))
        loose = loose.join(told, "fingerprint", "left_anti").dropDuplicates(["fingerprint"])
        kept = kept.where(F.col(f"`{doc_id}`").isNotNull()).unionByName(loose.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]))
    return kept
