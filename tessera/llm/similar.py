"""Near-duplicate texts by SimHash, with a similarity of word shingles as the last word.

Texts of a similarity of 0.8 in shingles of five words lie some ten, and up to some twenty, of 64 bits apart, for which fingerprints
have no keys that would tell texts apart at scale. So candidates come from keys of least shingle hashes, and fingerprints
do what they are good at: the stored table of distances to reference fingerprints discards pairs by their greatest
coordinate difference, the exact Hamming distance discards more, and shingle sets verify what is left.

A text has ``BANDS`` keys of ``ROWS`` least hashes each: texts of similarity s share one with probability
1 - (1 - s**ROWS)**BANDS, 0.99997 at 0.8. Each text of a key is compared with the key's leader first. A key of up to CROWD texts
then has all pairs compared that are not in one component by that. In a key of more, a crowd, texts without a link are compared with two
other texts of the key, drawn anew each turn, as long as turns link some; the texts that remain in a crowd of copies fall by a factor a turn.
That is for speed only. The exact way for the rest: of each crowd, the texts outside its largest component meet all crowded texts with
which they share one of their rarest shingles, in waves: pairs are dealt by hash to waves, each several times the one before, and in a wave only texts
of different components meet. So a text that has its like among many meets some of them, and only one without meets all. Of two texts that similar, one has a common shingle among the first ninth of its shingles,
rarest first, and the other among its first fifth, so no pair of crowded texts is lost; texts that have a ninth or more of their own,
or that share a long passage only, meet nobody in a crowd.

The fingerprint here is that of the distinct shingles, as the similarity is: repeats would turn its bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.words import LOWER, as_bytes
from tessera.operators.graph import components
from tessera.session import Scratch, join_checked, ship, shuffled

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS, CROWD = 20, 4, 48
#: Turns of a crowd go on while they leave at most this share of the rows without a link.
LEFT = 0.95
#: Texts with a shingle that one task compares with the other texts with it.
BLOCK = 1_000
#: Texts of the largest crowd that a text meets in the first wave, about, and how much a wave grows.
MEET, GROWTH = 64, 8
#: Bits beyond which two fingerprints are not of similar texts: 64 acos(0.889) / pi = 9.7 are expected at a similarity of 0.8, with a deviation of 2.9.
REACH = 26
_FACTORS = np.array([xxhash.xxh64_intdigest(k.to_bytes(4, "little"), 11) | 1 for k in range(BANDS * ROWS)], np.uint64)


def text_key(text: bytes) -> str:
    """128 bits of the lower-cased words; equal for texts of equal words."""
    return xxhash.xxh3_128_hexdigest(b" ".join(text.translate(LOWER).split()))


def least_hashes(h: np.ndarray) -> np.ndarray:
    """The least of each of the hash families over the shingles; empty texts have all ones."""
    best = np.full(len(_FACTORS), np.iinfo(np.uint64).max)
    for k in range(0, len(h), 4096):
        best = np.minimum(best, (h[k : k + 4096, None] * _FACTORS[None]).min(0))
    return best


def fingerprint(h: np.ndarray) -> int:
    """64 bits, each set if it is set in over half of the distinct hashes; 0 if there are none."""
    h = np.unique(h).astype("<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), simhash.SLICE):
        ones += np.unpackbits(h[k : k + simhash.SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def signatures(docs: DataFrame, text: str, keep: tuple[str, ...], shingle: int) -> DataFrame:
    """The columns ``keep``, _t (key of the words), _fp and _bands."""
    ship(docs.sparkSession)
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text"))
    schema = src.drop("_text").selectExpr("*", "'' AS _t", "0L AS _fp", "array(0L) AS _bands").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column(len(keep)))
            bands, fps = [], []
            for t in texts:
                h = simhash.hashes(t, shingle)
                least = least_hashes(h)
                fps.append(fingerprint(h))
                bands.append([xxhash.xxh64_intdigest(least[k : k + ROWS].tobytes(), k) - (1 << 63) for k in range(0, BANDS * ROWS, ROWS)])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(map(text_key, texts), pa.string()), pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], schema.fieldNames())

    return src.mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, text: str, wanted: DataFrame, shingle: int, scratch: Scratch) -> DataFrame:
    """(_t, _set), written: the distinct shingle hashes of the wanted texts (_t)."""
    spark = docs.sparkSession
    src = docs.select(F.col(f"`{text}`").cast("string").alias("_text"))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(map(text_key, texts), pa.string()), pa.array(texts, pa.binary())], ["_t", "_text"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(simhash.hashes(t, shingle)).astype("<i8") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], ["_t", "_set"])

    # Written in between: two steps of Python in one stage would double the workers of an executor.
    between = Scratch(spark)
    named = between.write(join_checked(spark, src.mapInArrow(key, "_t string, _text binary"), wanted, ["_t"], "left_semi"), "texts")
    out = scratch.write(named.mapInArrow(sets, "_t string, _set array<long>").dropDuplicates(["_t"]), "sets")
    between.drop()
    return out


def _keyed(spark: SparkSession, classes: DataFrame) -> DataFrame:
    """(key, _t, n, leader) of keys that several texts share; n is how many, the leader one of them."""
    scratch = Scratch(spark)
    keyed = scratch.write(classes.select("_t", F.posexplode("_bands").alias("c", "k")).select(F.xxhash64("c", "k").alias("key"), "_t"), "keyed")
    shared = scratch.write(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min_by("_t", F.xxhash64("_t")).alias("leader")).where("n > 1"), "shared")
    return scratch.write(join_checked(spark, keyed, shared, ["key"], "inner"), "rows")


def _ordered(u: str, v: str) -> list:
    return [F.least(u, v).alias("u"), F.greatest(u, v).alias("v")]


def _between(spark: SparkSession, rows: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs (u, v) of a key of few texts that are neither in one component of ``found`` nor with the key's leader, which has met all; crowded texts (_t, component, rest); and links (u, v) of each text with its component.

    Those are the texts of the crowds that are not one component; rest tells those that are outside the largest one of a crowd.
    """
    scratch = Scratch(spark)
    comp = scratch.write(components(spark, found).withColumnRenamed("node", "_t"), "comp")
    inside = scratch.write(rows.where("n > 2").join(comp, "_t", "left").withColumn("component", F.coalesce("component", "_t")), "inside")
    few = inside.where(F.col("n") <= CROWD).where("_t <> leader")
    told = lambda c: few.select("key", F.col("_t").alias(c), F.col("component").alias(f"_c{c}"))
    pairs = told("u").join(told("v"), "key").where("u < v and _cu <> _cv").select("u", "v")
    many = inside.where(F.col("n") > CROWD)
    sizes = many.groupBy("key", "component").agg(F.count("*").alias("m"))
    keys = sizes.groupBy("key").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    crowded = many.join(shuffled(keys), "key").groupBy("_t").agg(F.any_value("component").alias("component"), F.bool_or(F.col("component") != F.col("main")).alias("rest"))
    return pairs, scratch.write(crowded, "crowded"), comp.select(F.col("_t").alias("u"), F.col("component").alias("v"))


def _beyond(spark: SparkSession, held: DataFrame, similarity: float, parts: int, begin: int, end: int) -> DataFrame:
    """(u, v) with all pairs of ``similarity`` among the texts of ``held`` (id, _t, component, rest, size, _set) that are in two components and not both in the largest of their crowds, and are dealt to the parts from ``begin`` to before ``end`` of ``parts``.

    Shingles are put in one order for all texts: those that no such pair can share, then the rarer first. Two texts of the similarity s have at
    least 2s / (1 + s) of the smaller's size, and s of the larger's, in common, so their first common shingle is among the first 1 - 2s / (1 + s) of the
    smaller and the first 1 - s of the larger, and what follows it must be enough. Texts that begin with a shingle of many are dealt to blocks.
    """
    scratch = Scratch(spark)
    said = held.select("id", "rest", F.explode("_set").alias("token"))
    known = said.groupBy("token").agg(F.count("*").alias("n"), F.bool_or("rest").alias("any")).where("n > 1 and any").select("token", "n")
    lists = said.join(shuffled(known), "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("_in"))
    share = 2 * similarity / (1 + similarity)
    first = lambda part: F.col("size") - F.ceil(F.col("size") * part - 1e-6) + 1
    own = F.col("size") - F.size("_in")
    begun = held.select("id", "component", "rest", "size", F.pmod(F.xxhash64("_t"), F.lit(parts)).alias("place")).join(shuffled(lists), "id").withColumn("own", own).where(own < first(similarity))
    begun = begun.select("id", "component", "rest", "size", "place", "own", F.posexplode(F.slice("_in", 1, (first(similarity) - F.col("own")).cast("int"))).alias("p", "s"))
    begun = begun.select("id", "component", "rest", "size", "place", (F.col("own") + F.col("p")).alias("at"), F.col("s.token").alias("token")).withColumn("short", F.col("at") < first(share))
    begun = scratch.write(begun, "begun")
    counted = begun.groupBy("token").agg(F.count_if("short").alias("n"), F.count("*").alias("all"), F.bool_or("rest").alias("any")).where("n > 0 and all > 1 and any")
    counted = scratch.write(counted.select("token", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "tokens")
    named = begun.join(shuffled(counted), "token")
    told = lambda c: [F.col(k).alias(f"_{k}{c}") for k in ("component", "size", "at", "place")]
    # Texts of the largest components need not meet each other: a short one of these meets the rest only.
    short = named.where("short").select("token", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.col("rest").alias("wide"), F.col("id").alias("a"), *told("a"))
    long_ = named.select("token", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.explode(F.when(F.col("rest"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))).alias("wide"), F.col("id").alias("b"), *told("b"))
    smaller = F.struct("_sizea", "a") < F.struct("_sizeb", "b")
    after = F.least(F.col("_sizea") - F.col("_ata"), F.col("_sizeb") - F.col("_atb"))
    enough = (F.col("_sizea") >= F.col("_sizeb") * similarity - 1e-6) & (after >= (F.col("_sizea") + F.col("_sizeb")) * (share / 2) - 1e-6)
    dealt = ((F.col("_placea") + F.col("_placeb")) % parts).between(begin, end - 1)
    pairs = short.join(shuffled(long_), ["token", "block", "wide"]).where("_componenta <> _componentb").where(smaller).where(dealt).where(enough)
    pairs = scratch.write(pairs.select("a", "b").distinct(), "beyond")
    name = lambda c, d: held.select(F.col("id").alias(c), F.col("_t").alias(d))
    return pairs.join(name("a", "x"), "a").join(name("b", "y"), "b").select(*_ordered("x", "y"))


def links(docs: DataFrame, classes: DataFrame, text: str, shingle: int, similarity: float) -> DataFrame:
    """(u, v): pairs of texts (_t) whose components are those of all pairs of distinct texts that reach ``similarity``."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    table = scratch.write(simhash.pivot_table(classes.select("_fp").distinct(), simhash.references()), "pivots")
    about = scratch.write(classes.select("_t", "_fp").join(table, "_fp"), "about")

    def near(pairs: DataFrame) -> DataFrame:
        told = lambda c: about.select(F.col("_t").alias(c), F.col("_fp").alias(f"_f{c}"), F.col("_d").alias(f"_d{c}"))
        kept = pairs.distinct().join(told("u"), "u").join(told("v"), "v").where(~simhash.apart(REACH)).where(F.bit_count(F.col("_fu").bitwiseXOR(F.col("_fv"))) <= REACH)
        return scratch.write(kept.select("u", "v"), "near")

    def sets_of(pairs: DataFrame, *more: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("u").alias("_t")).union(pairs.select("v"))
        for m in more:
            wanted = wanted.union(m.select("_t"))
        return shingle_sets(docs, text, scratch.write(wanted.distinct(), "wanted"), shingle, scratch)

    def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        named = lambda c: sets.select(F.col("_t").alias(c), F.col("_set").alias(f"_s{c}"))
        common = F.size(F.array_intersect("_su", "_sv"))
        enough = common >= similarity * (F.size("_su") + F.size("_sv") - common)
        return scratch.write(pairs.join(named("u"), "u").join(named("v"), "v").where(enough).select("u", "v"), "links")

    rows = _keyed(spark, classes)
    crowd = rows.where(F.col("n") > CROWD).select("key", "_t")
    led = near(rows.where("_t <> leader").select(*_ordered("_t", "leader")))
    sets = sets_of(led, crowd)
    found, turn, before = alike(led, sets), 0, None
    while True:
        turn += 1
        linked = found.select(F.col("u").alias("_t")).union(found.select("v")).distinct()
        alone = scratch.write(crowd.join(linked, "_t", "left_anti"), "alone")
        left = alone.count()
        if not left or before is not None and left > LEFT * before:
            break
        before, order = left, F.xxhash64("_t", F.lit(turn))
        leaders = crowd.groupBy("key").agg(F.min_by("_t", order).alias("a"), F.max_by("_t", order).alias("b")).select("key", F.explode(F.array("a", "b")).alias("v"))
        found = found.union(alike(near(alone.join(leaders, "key").where("_t <> v").select(*_ordered("_t", "v"))), sets))
    parts = -(-(rows.agg(F.max("n")).first()[0] or 0) // MEET)
    begin, end = 0, 1
    pairs, crowded, stars = _between(spark, rows, found)
    while begin < parts and crowded.limit(1).count():
        held = crowded.join(sets, "_t").select(F.monotonically_increasing_id().alias("id"), "_t", "component", "rest", F.size("_set").alias("size"), "_set")
        more = alike(near(_beyond(spark, scratch.write(held, "held"), similarity, parts, begin, end)), sets)
        begin, end = end, end * GROWTH
        pairs, crowded, stars = _between(spark, rows, stars.union(more))
    pairs = near(pairs)
    return stars.union(alike(pairs, sets_of(pairs)))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_key, component_id) for every row of docs; component_id is the least doc_id that links reach.

    Texts of equal words (lower-cased) are one text and linked. A null text counts as empty. Texts without words are one
    text, too. A text of fewer words than a shingle is one shingle. A row whose doc_id is null takes part in links and
    gets the least id that is not null (null if there is none). Repeated rows stay. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = scratch.write(signatures(docs, text, (doc_id,), shingle).withColumnRenamed(doc_id, "doc_id"), "signatures")
    classes = scratch.write(rows.groupBy("_t").agg(F.min("doc_id").alias("least"), *[F.any_value(c).alias(c) for c in ("_fp", "_bands")]), "classes")
    comp = components(spark, links(docs, classes, text, shingle, similarity)).withColumnRenamed("node", "_t")
    grouped = scratch.write(classes.select("_t", "least").join(comp, "_t", "left").withColumn("component", F.coalesce("component", "_t")), "grouped")
    best = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = scratch.write(grouped.join(best, "component").select("_t", "component_id"), "ids")
    return rows.select("doc_id", "_t").join(ids, "_t").select("doc_id", F.col("_t").alias("text_key"), "component_id")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each component: the one with the least doc_id, of repeated rows one.

    All columns stay. A row without a doc_id goes if its component has a row with one; of those left,
    one per text stays.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    found = scratch.write(near_duplicates(docs, doc_id, text, shingle, similarity), "components")
    gone = scratch.write(found.where("doc_id != component_id").select(F.col("doc_id").alias(doc_id)).distinct(), "dropped")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    own = F.col(f"`{doc_id}`")
    kept = join_checked(spark, docs.where(own.isNotNull()), gone, [doc_id], "left_anti").select(*columns)
    if found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates([doc_id])
    if found.where("doc_id is null and component_id is null").limit(1).count():
        packed = docs.where(own.isNull()).select(F.struct(*columns).alias("row"), F.col(f"`{text}`").alias("body"))
        told = found.where("doc_id is null and component_id is null").select(F.col("text_key").alias("_t")).distinct()
        loose = signatures(packed, "body", ("row",), shingle).join(told, "_t", "left_semi").dropDuplicates(["_t"])
        kept = kept.unionByName(loose.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]))
    return kept
