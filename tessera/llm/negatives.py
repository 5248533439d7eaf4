"""Hard negatives by a table of pivot distances.

A vector x gets one more component, sqrt(M - |x|^2), where M is the greatest squared norm, and an anchor
q gets zero there. Then the squared distance of q and x is |q|^2 + M - 2 q.x, so that the greatest inner product is the
least distance. A table is written that holds, for each row, its distances to some pivots; with those of the
anchor the triangle inequality brackets the distance, and so the score, of every pair. Rows whose bracket can't
reach what an anchor asks for are discarded, and the scores of survivors are computed exactly.

Anchors are a stated query set. They are dealt to chunks of bounded size and rows to slices; a task sees the anchors
of a chunk, then streams the rows of a slice past them, nearest pivot by nearest pivot, and keeps for each anchor the
best rows that it has met so far. Best rows of slices are merged by a window over a bounded number of rows an anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import Scratch, ship

#: Pivots, of how many rows (those of least hash of their id) they are chosen as the farthest from each other.
PIVOTS, SAMPLE = 16, 256
#: Anchors of a chunk; rows of a slice, as planned; rows compared at once.
CHUNK, SLICE, STEP = 4096, 65_536, 1024
#: Squared norms up to which inner products are exact in double precision.
REACH = float(1 << 52)
#: Brackets are widened by this part, which is more than rounding can take from them.
SLACK = 1e-9
NONE = np.int64(-(1 << 62))


def prepared(vectors: DataFrame, vec_id: str, label: str, embedding: str, scale: int) -> DataFrame:
    """(vec_id, label, v, norm): rows that take part, v being floor(scale * x) in doubles and norm the squared norm."""
    x = F.transform(F.col(f"`{embedding}`"), lambda e: F.lit(float(scale)) * e.cast("double"))
    finite = F.forall("x", lambda e: F.coalesce(F.abs(e) < REACH, F.lit(False)))
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite)
    rows = rows.select("vec_id", "label", F.transform("x", lambda e: F.floor(e).cast("double")).alias("v"))
    return rows.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e)).where(F.col("norm") <= REACH)


def chosen(sample: np.ndarray, many: int) -> np.ndarray:
    """``many`` rows of sample (all, if fewer), each the farthest from those before."""
    took, far = [], np.full(len(sample), np.inf)
    for _ in range(min(many, len(sample))):
        took.append(int(far.argmax()))
        far = np.minimum(far, np.square(sample - sample[took[-1]]).sum(1))
    return sample[took]


def dense(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of doubles as rows of ``dims`` components; missing ones are zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (size == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(size), dims))
    out[np.arange(dims) < size[:, None]] = flat
    return out


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of augmented points to augmented pivots, from exact differences."""
    return np.sqrt(np.stack([np.square(points - p).sum(1) for p in pivots], axis=1)) if len(pivots) else np.zeros((len(points), 0))


def augmented(points: np.ndarray, norm: np.ndarray, most: float, anchor: bool) -> np.ndarray:
    return np.column_stack([points, np.zeros(len(points)) if anchor else np.sqrt(np.maximum(most - norm, 0.0))])


def pivot_table(rows: DataFrame, pivots: np.ndarray, most: float, dims: int) -> DataFrame:
    """rows with uid, ``far`` (distances of the augmented vector to the pivots), ``asks`` (those of the vector as an anchor) and the nearest pivot."""
    ship(rows.sparkSession)
    src = rows.withColumn("uid", F.monotonically_increasing_id())
    schema = src.selectExpr("*", "array(0D) AS far", "array(0D) AS asks", "0 AS nearest").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, STEP):
                part = b.slice(k, STEP)
                points, norm = dense(part.column("v"), dims), part.column("norm").to_numpy()
                far, asks = (distances(augmented(points, norm, most, anchor), pivots) for anchor in (False, True))
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())) for x in (far, asks)]
                yield pa.RecordBatch.from_arrays([*part.columns, *lists, pa.array(far.argmin(1).astype(np.int32))], [f.name for f in schema])

    return src.mapInArrow(run, schema)


class Best:
    """The best rows of each window of a chunk's anchors, met so far: by score, then by the lesser vec_id."""

    def __init__(self, windows: int, most: int):
        self.most = most
        self.score = np.full((windows, most), NONE)
        self.vec = np.zeros((windows, most), np.int64)

    @property
    def least(self) -> np.ndarray:
        """What a score has to reach, for each window."""
        return self.score[:, -1]

    def meet(self, at: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        """Windows ``at`` meet rows ``vec`` (ascending) with scores, NONE where a row is not for a window."""
        if not score.size:
            return
        cut = np.maximum(self.least[at], -np.partition(-score, min(self.most, score.shape[1]) - 1, axis=1)[:, min(self.most, score.shape[1]) - 1])
        ties = (score == cut[:, None]) & (cut[:, None] > NONE)
        ties &= np.cumsum(ties, axis=1) <= self.most
        w, j = np.nonzero((score > cut[:, None]) | ties)
        if not len(w):
            return
        some = np.unique(w)
        kept, place = np.nonzero(self.score[at[some]] > NONE)
        rank_w = np.concatenate([at[w], at[some][kept]])
        values = np.concatenate([score[w, j], self.score[at[some][kept], place]])
        ids = np.concatenate([vec[j], self.vec[at[some][kept], place]])
        order = np.lexsort((ids, -values, rank_w))
        rank_w, values, ids = rank_w[order], values[order], ids[order]
        first = np.r_[True, rank_w[1:] != rank_w[:-1]]
        nth = np.arange(len(rank_w)) - np.maximum.accumulate(np.where(first, np.arange(len(rank_w)), 0))
        good = nth < self.most
        self.score[rank_w[good], nth[good]] = values[good]
        self.vec[rank_w[good], nth[good]] = ids[good]


class Chunk:
    """Anchors with their windows of asked scores, and the best rows of each."""

    def __init__(self, parts: list[pa.RecordBatch], dims: int, most: float, same: bool, keep: int):
        t = pa.Table.from_batches(parts).combine_chunks()
        self.uid, self.label = t.column("uid").to_numpy(), t.column("label").to_numpy()
        self.points, self.asks = dense(t.column("v"), dims), dense(t.column("far"), t.column("far").combine_chunks().value_lengths()[0].as_py())
        self.base = t.column("norm").to_numpy() + most
        asked = t.column("asked").combine_chunks()
        self.of = np.repeat(np.arange(len(self.uid)), asked.value_lengths().to_numpy())
        flat = asked.flatten()
        self.number, self.low, self.high = (flat.field(n).to_numpy() for n in ("number", "low", "high"))
        self.same, self.best = same, Best(len(self.of), keep)

    def needs(self) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor the least score that one of its windows can still use, and the greatest."""
        low, high = np.full(len(self.uid), np.iinfo(np.int64).max), np.full(len(self.uid), NONE)
        np.minimum.at(low, self.of, np.maximum(self.low, self.best.least))
        np.maximum.at(high, self.of, self.high)
        return low, high

    def bracket(self, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score by a lower and an upper bound of the distance."""
        with np.errstate(over="ignore"):
            return (self.base[:, None] * (1 - SLACK) - np.square(far * (1 + SLACK))) / 2 - 1, (self.base[:, None] * (1 + SLACK) - np.square(near * (1 - SLACK))) / 2 + 1

    def meet(self, uid: np.ndarray, vec: np.ndarray, label: np.ndarray, points: np.ndarray, far: np.ndarray) -> None:
        low, high = self.needs()
        near = np.zeros((len(self.uid), 1))
        for p in range(far.shape[1]):
            near[:, 0] = np.maximum(near[:, 0], np.maximum(self.asks[:, p] - far[:, p].max(), far[:, p].min() - self.asks[:, p]))
        _, top = self.bracket(near, near)
        anchors = np.flatnonzero(top[:, 0] >= low)
        if self.same:
            anchors = anchors[np.isin(self.label[anchors], label)]
        if not len(anchors):
            return
        near, away = np.zeros((len(anchors), len(vec))), np.full((len(anchors), len(vec)), np.inf)
        for p in range(far.shape[1]):
            a, x = self.asks[anchors, p][:, None], far[:, p][None]
            np.maximum(near, np.abs(a - x), out=near)
            np.minimum(away, a + x, out=away)
        whole = self.base
        self.base = whole[anchors]
        least, top = self.bracket(near, away)
        self.base = whole
        alive = ((self.label[anchors][:, None] == label[None]) == self.same) & (self.uid[anchors][:, None] != uid[None]) & (top >= low[anchors][:, None]) & (least <= high[anchors][:, None])
        rows, columns = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        if not len(rows):
            return
        exact = (self.points[anchors[rows]] @ points[columns].T).astype(np.int64)
        exact[~alive[np.ix_(rows, columns)]] = NONE
        place = np.full(len(self.uid), -1)
        place[anchors[rows]] = np.arange(len(rows))
        at = np.flatnonzero(place[self.of] >= 0)
        step = max(1, (1 << 22) // len(columns))
        for k in range(0, len(at), step):
            some = at[k : k + step]
            score = exact[place[self.of[some]]]
            score[(score < self.low[some][:, None]) | (score > self.high[some][:, None])] = NONE
            self.best.meet(some, score, vec[columns])

    def told(self) -> pa.RecordBatch:
        w, nth = np.nonzero(self.best.score > NONE)
        values = [self.uid[self.of[w]], self.number[w], self.best.vec[w, nth], self.best.score[w, nth]]
        return pa.RecordBatch.from_arrays(list(map(pa.array, values)), ["uid", "number", "vec_id", "score"])


def search(table: DataFrame, anchors: DataFrame, dims: int, most: float, same: bool, keep: int, slices: int, chunk: int, chunks: int) -> DataFrame:
    """(uid, number, vec_id, score): the best ``keep`` rows of each window of each anchor.

    ``anchors`` are rows of the table with ``asked``, an array of (number, low, high); a row is for a window if its label
    is the anchor's (or another, if not same), its score between low and high, and it isn't the anchor itself.
    """
    asked = F.lit(None).cast(anchors.schema["asked"].dataType)
    part = F.col("uid") % slices
    common = ["uid", "vec_id", "label", "v", "norm"]
    rows = table.select(*common, "far", "nearest", asked.alias("asked"), F.lit(1).alias("kind"), part.alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    ask = anchors.select(*common, F.col("asks").alias("far"), "nearest", "asked", F.lit(0).alias("kind"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice"), F.pmod(F.xxhash64("uid"), F.lit(chunks)).cast("int").alias("chunk"))
    dealt = ask.unionByName(rows).repartition("chunk", "slice").sortWithinPartitions("chunk", "slice", "kind", "nearest", F.col("far")[F.col("nearest")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, held = None, [], None
        for b in batches:
            groups = np.stack([b.column(n).to_numpy().astype(np.int64) for n in ("chunk", "slice", "kind")], axis=1)
            cuts = np.flatnonzero((groups[1:] != groups[:-1]).any(1)) + 1 if len(groups) else []
            for begin, end in zip([0, *cuts], [*cuts, len(groups)], strict=True):
                if begin == end:
                    continue
                key, run_of = tuple(groups[begin][:2]), b.slice(begin, end - begin)
                if key != at:
                    if held is not None:
                        yield held.told()
                    at, parts, held = key, [], None
                if groups[begin][2] == 0:
                    parts.append(run_of)
                    continue
                if not parts:
                    continue
                held = held or Chunk(parts, dims, most, same, keep)
                for k in range(0, run_of.num_rows, STEP):
                    some = run_of.slice(k, STEP)
                    vec = some.column("vec_id").to_numpy()
                    order = np.argsort(vec, kind="stable")
                    far = dense(some.column("far"), held.asks.shape[1])
                    held.meet(some.column("uid").to_numpy()[order], vec[order], some.column("label").to_numpy()[order], dense(some.column("v"), dims)[order], far[order])
        if held is not None:
            yield held.told()

    got = dealt.mapInArrow(run, "uid long, number int, vec_id long, score long")
    order = Window.partitionBy("uid", "number").orderBy(F.desc("score"), "vec_id")
    return got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    vec_id: str = "vec_id",
    label: str = "label",
    embedding: str = "embedding",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    pivots: int = PIVOTS,
    chunk: int = CHUNK,
    slice_rows: int = SLICE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    vec_id and label are integers, and ``anchor`` is a condition on them that picks the anchors. A row's score is its integer
    inner product with the anchor, of components floor(scale * x); higher scores come first, ties by the lesser vec_id. An
    anchor's positives are its first ``positives`` other rows of the same label, and for each the first
    ``negatives`` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score are
    returned. Rows with a null id or label, a null vector, a null or non-finite component, or a squared norm beyond 2**52 take
    no part. Missing components of shorter vectors count as zero, so an empty vector scores 0. Each of repeated rows is a row of
    its own: it can be anchor, and a positive of the other. No rows, or no anchors, give an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = prepared(vectors, vec_id, label, embedding, scale).withColumns({"vec_id": F.col("vec_id").cast("long"), "label": F.col("label").cast("long")})
    size = rows.agg(F.count("*").alias("n"), F.max("norm").alias("most"), F.max(F.size("v")).alias("dims")).first()
    most, dims = float(size.most or 0.0), int(size.dims or 0)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label", "v").limit(SAMPLE).select("v", "norm").collect()
    points = np.zeros((len(sample), dims))
    for i, r in enumerate(sample):
        points[i, : len(r.v)] = r.v
    table = pivot_table(rows, chosen(augmented(points, np.array([r.norm for r in sample]), most, False), pivots), most, dims)
    table = scratch.write(table, "pivots")
    slices = max(4 * spark.sparkContext.defaultParallelism, -(-size.n // slice_rows))
    asks = table.where(anchor)
    chunks = max(1, -(-asks.count() // chunk))
    first = asks.withColumn("asked", F.array(F.struct(F.lit(0).alias("number"), F.lit(-(1 << 61)).alias("low"), F.lit(1 << 61).alias("high"))))
    named = scratch.write(search(table, first, dims, most, True, positives, slices, chunk, chunks), "positives")
    bounds = F.struct(F.col("rank").alias("number"), F.ceil(F.col("score") * low / F.lit(100).cast("decimal(3,0)")).cast("long").alias("low"), F.floor(F.col("score") * high / F.lit(100).cast("decimal(3,0)")).cast("long").alias("high"))
    windows = named.select("uid", bounds.alias("w")).where("w.low <= w.high").groupBy("uid").agg(F.array_sort(F.collect_list("w")).alias("asked"))
    found = search(table, asks.join(windows, "uid"), dims, most, False, negatives, slices, chunk, chunks)
    found = found.select("uid", "number", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    about = named.join(asks.select("uid", F.col("vec_id").alias("anchor_id")), "uid").select("uid", F.col("rank").alias("number"), "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(about, ["uid", "number"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: DuckDB SQL of the query over the table of embeddings.
SQL = """
WITH k AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL),
v AS MATERIALIZED (
  SELECT row_number() OVER () AS uid, vec_id, label, list_transform(e, lambda y: floor(256 * y)) AS x FROM k
  WHERE len(list_filter(e, lambda y: y IS NOT NULL AND isfinite(y))) = len(e)
),
s AS MATERIALIZED (
  SELECT a.uid, a.vec_id AS anchor_id, b.uid AS other, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.uid <> b.uid
),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.uid, p.other ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.uid = p.uid AND NOT s.same AND 100 * s.score BETWEEN 30 * p.score AND 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.uid, p.other ORDER BY s.score DESC, s.vec_id) <= 10"""
