"""Lloyd's clustering by dual trees.

Vectors are cut into blocks, and each block gets a cover tree of its own, built once and written: a
node has one of its vectors as centre, the greatest distance of its vectors to it as radius, and children whose centres lie
further apart than the radius that their own points keep to, which shrinks from level to level. Each round a tree over the centroids is made
and sent to the tasks, which walk both: of a pair of nodes the distance of their centres, less and
plus both radii, bounds all distances between them; pairs that can't hold a nearest centroid go, a node of
vectors that is left with one centroid is assigned whole (by sums kept along the order of the tree), and where two leaves
meet vectors and centroids are compared exactly, in integers. A task returns a count and a sum for each centroid; the
driver gets one row per centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import Scratch, ship

BLOCK, LEAF, SHRINK = 1024, 16, 1.3
#: Components beyond this leave the range in which squared distances fit a long.
REACH = 1 << 26
#: Pairs of a vector and a centroid that are compared at once; bounds memory for any number of centroids.
PAIRS = 1 << 15
#: Bounds are widened by this part, which is more than rounding can take from them.
SLACK = 1e-9


class Tree:
    """A cover tree over integer vectors. ``order`` lists the vectors so that each node is a range of it."""

    FIELDS = ("order", "centre", "radius", "begin", "end", "child", "children")

    def __init__(self, *parts: np.ndarray):
        for name, part in zip(self.FIELDS, parts, strict=True):
            setattr(self, name, part)

    @classmethod
    def over(cls, points: np.ndarray, leaf: int) -> Tree:
        flat = points.astype(np.float64)

        def apart(some: np.ndarray, centre: int) -> np.ndarray:
            gap = flat[some] - flat[centre]
            return np.sqrt(np.einsum("ij,ij->i", gap, gap))

        nodes = [[0, 0.0, 0, len(points), -1, 0]]
        level = [(0, np.arange(len(points)), 0, 0)]
        placed = np.empty(len(points), np.int64)
        while level:
            deeper = []
            for node, some, centre, begin in level:
                gaps = apart(some, centre)
                radius = float(gaps.max(initial=0.0))
                nodes[node][:4] = [centre, radius, begin, begin + len(some)]
                if len(some) <= leaf or radius == 0.0:
                    placed[begin : begin + len(some)] = some
                    continue
                keep, parts = radius / SHRINK, []
                while len(some):
                    near = gaps <= keep
                    parts.append((centre, some[near]))
                    some = some[~near]
                    if len(some):
                        centre = int(some[0])
                        gaps = apart(some, centre)
                nodes[node][4:] = [len(nodes), len(parts)]
                for centre, part in parts:
                    deeper.append((len(nodes), part, centre, begin))
                    nodes.append([centre, 0.0, begin, begin + len(part), -1, 0])
                    begin += len(part)
            level = deeper
        columns = list(zip(*nodes, strict=True))
        return cls(placed, *(np.array(c, np.float64 if k == 1 else np.int64) for k, c in enumerate(columns)))

    def packed(self) -> dict[str, bytes]:
        return {name: getattr(self, name).astype("<f8" if name == "radius" else "<i8").tobytes() for name in self.FIELDS}

    @classmethod
    def unpacked(cls, row: dict[str, bytes]) -> Tree:
        return cls(*(np.frombuffer(row[name], "<f8" if name == "radius" else "<i8") for name in cls.FIELDS))


def _spread(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges laid end to end: which range each place is of, and the place itself."""
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + begin[which]


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return np.einsum("ij,ij->i", gap, gap)


def assign(points: np.ndarray, tree: Tree, centroids: np.ndarray, over: Tree) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """(vectors, their centroids, ranges): vectors compared one by one, and ranges (begin, end, centroid) of tree.order assigned whole.

    Of equally near centroids the least number is taken.
    """
    v, c = np.zeros(1, np.int64), np.zeros(1, np.int64)
    whole: list[tuple[int, int, int]] = []
    singles: list[np.ndarray] = []
    chosen: list[np.ndarray] = []
    flat, means = points.astype(np.float64), centroids.astype(np.float64)
    best = np.full(len(tree.centre), np.inf)
    while len(v):
        gap = np.concatenate([np.sqrt(_squares(flat[tree.centre[v[k : k + PAIRS]]], means[over.centre[c[k : k + PAIRS]]])) for k in range(0, len(v), PAIRS)])
        both = tree.radius[v] + over.radius[c]
        np.minimum.at(best, v, (gap + both) * (1 + SLACK))
        keep = (gap - both) * (1 - SLACK) - SLACK * both <= best[v]
        v, c = v[keep], c[keep]
        alone = (np.bincount(v, minlength=len(best))[v] == 1) & (over.child[c] < 0)
        for node, other in zip(v[alone].tolist(), c[alone].tolist(), strict=True):
            whole.append((int(tree.begin[node]), int(tree.end[node]), int(over.order[over.begin[other] : over.end[other]].min())))
        v, c = v[~alone], c[~alone]
        wide, deep = over.child[c] >= 0, tree.child[v] >= 0
        waits = np.isin(v, v[wide])
        leaves, down, stay = ~waits & ~deep, ~waits & deep, waits & ~wide
        if leaves.any():
            i, j = _nearest(points, tree, centroids, over, v[leaves], c[leaves])
            singles.append(i)
            chosen.append(j)
        a, kids = _spread(over.child[c[wide]], over.children[c[wide]])
        b, parts = _spread(tree.child[v[down]], tree.children[v[down]])
        v, c = np.concatenate([v[stay], v[wide][a], parts]), np.concatenate([c[stay], kids, c[down][b]])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *singles]), np.concatenate([none, *chosen]), whole


def _nearest(points: np.ndarray, tree: Tree, centroids: np.ndarray, over: Tree, v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector of the leaves v with its nearest centroid among the leaves c that are paired with its own."""
    w, place = _spread(over.begin[c], over.end[c] - over.begin[c])
    v, number = v[w], over.order[place]
    best = np.full(len(points), np.iinfo(np.int64).max)
    took = np.full(len(points), len(centroids))
    step = max(1, PAIRS // max(1, int((tree.end[v] - tree.begin[v]).max())))
    for k in range(0, len(v), step):
        which, place = _spread(tree.begin[v[k : k + step]], (tree.end - tree.begin)[v[k : k + step]])
        i, j = tree.order[place], number[k : k + step][which]
        d = _squares(points[i], centroids[j])
        rank = np.lexsort((j, d, i))
        i, j, d = i[rank], j[rank], d[rank]
        first = np.r_[True, i[1:] != i[:-1]]
        i, j, d = i[first], j[first], d[first]
        better = (d < best[i]) | ((d == best[i]) & (j < took[i]))
        best[i[better]], took[i[better]] = d[better], j[better]
    some = np.flatnonzero(took < len(centroids))
    return some, took[some]


def scaled(vectors: DataFrame, vec_id: str, embedding: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, v): vectors of exactly ``dims`` components, none null or non-finite, as floor(scale * x).

    Those with a component of 2**26 or more after scaling aren't kept either.
    """
    x = F.transform(F.col(f"`{embedding}`"), lambda e: F.lit(float(scale)) * e.cast("double"))
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), x.alias("x")).where((F.size("x") == dims) & F.forall("x", lambda e: F.coalesce(F.abs(e) < REACH, F.lit(False))))
    return rows.select("vec_id", F.transform("x", lambda e: F.floor(e)).alias("v"))


def blocks(rows: DataFrame, dims: int, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """A row per block of at most ``block`` vectors of (vec_id, v): ids, vectors and cover tree."""
    ship(rows.sparkSession)
    kind = T.StructType([T.StructField("ids", T.ArrayType(rows.schema["vec_id"].dataType)), T.StructField("vectors", T.BinaryType()), *(T.StructField(f, T.BinaryType()) for f in Tree.FIELDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def made() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            points = t.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
            ids = t.column(0).combine_chunks()
            packed = {"vectors": points.astype("<i4").tobytes()} | Tree.over(points, leaf).packed()
            listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([listed, *(pa.array([packed[f.name]], pa.binary()) for f in kind.fields[1:])], [f.name for f in kind.fields])

        for b in batches:
            while b.num_rows:
                part = b.slice(0, block - size)
                b = b.slice(part.num_rows)
                held.append(part)
                size += part.num_rows
                if size == block:
                    yield made()
                    held, size = [], 0
        if held:
            yield made()

    return rows.mapInArrow(run, kind)


def _opened(row: dict, dims: int) -> tuple[np.ndarray, Tree]:
    return np.frombuffer(row["vectors"], "<i4").astype(np.int64).reshape(-1, dims), Tree.unpacked(row)


def sums(forest: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Centroid -> (count, sum of its vectors) over all blocks."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over = Tree.over(centroids, 1)
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            for row in b.to_pylist():
                points, tree = _opened(row, dims)
                i, j, whole = assign(points, tree, centroids, over)
                count += np.bincount(j, minlength=k)
                np.add.at(total, j, points[i])
                if whole:
                    along = np.vstack([np.zeros(dims, np.int64), np.cumsum(points[tree.order], axis=0)])
                    for begin, end, c in whole:
                        count[c] += end - begin
                        total[c] += along[end] - along[begin]
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], ["c", "n", "s"])

    got = forest.drop("ids").mapInArrow(run, "c long, n long, s array<long>")
    summed = got.groupBy("c").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(dims)]).alias("s"))
    return {r.c: (r.n, r.s) for r in summed.collect()}


def assigned(forest: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector of the blocks."""
    dims = centroids.shape[1]
    kind = forest.schema["ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over = Tree.over(centroids, 1)
        for b in batches:
            for k, row in enumerate(b.select(b.schema.names[1:]).to_pylist()):
                points, tree = _opened(row, dims)
                i, j, whole = assign(points, tree, centroids, over)
                took = np.empty(len(points), np.int32)
                took[i] = j
                for begin, end, c in whole:
                    took[tree.order[begin:end]] = c
                ids = b.column(0).slice(k, 1).flatten()
                yield pa.RecordBatch.from_arrays([ids, pa.array(took), pa.array(_squares(points, centroids[took]))], ["vec_id", "cluster", "distance"])

    return forest.mapInArrow(run, T.StructType([T.StructField("vec_id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]))


def cluster(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, block: int = BLOCK, leaf: int = LEAF
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per kept vector.

    Vectors of exactly ``dims`` components, none null or non-finite, become integers floor(scale * x); all others,
    and those with a component of 2**26 or more after that, are left out. Centroids start as the k vectors with the least sha256 of
    ``seed:vec_id`` (equal ids: the lesser vector first; a null id last); if there are fewer vectors, there
    are fewer centroids. Each of ``rounds`` rounds assigns each vector to the nearest centroid, of equally near ones
    that with the least number, and puts floor(sum / count) in place of each centroid that has vectors. Distances are
    squared. Repeated rows count and are returned as often as they occur; no vector gives an empty result. An inertia beyond
    a long is null.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = scaled(vectors, vec_id, embedding, dims, scale)
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.orderBy(rank.asc_nulls_last(), F.col("v")).limit(k).select("v").collect()
    forest = scratch.write(blocks(rows, dims, block, leaf), "forest")
    centroids = np.array([r.v for r in first], np.int64).reshape(-1, dims)
    if not len(centroids):
        empty = rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0)
        return empty.withColumns({"cluster_inertia": F.lit(0).cast("long"), "inertia": F.lit(0).cast("long"), "centroid_sha256": F.lit("")})
    for _ in range(rounds):
        for c, (n, s) in sums(forest, centroids).items():
            centroids[c] = [x // n for x in s]
    found = scratch.write(assigned(forest, centroids), "assigned")
    spent = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    told = [(c, fits(spent[c]), fits(sum(spent.values())), digest[c]) for c in sorted(spent)]
    about = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(rounds: int = 10) -> str:
    """DuckDB SQL of cluster(), a chain of rounds."""
    near = "SELECT v.id, v.vec_id, v.x, c.cluster, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, {c} c QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY d, c.cluster) = 1"
    steps = []
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(c=f'c{r}')})")
        steps.append(
            f"""s{r} AS (SELECT cluster, i, sum(CAST(x[i] AS HUGEINT)) AS s, CAST(count(*) AS HUGEINT) AS n FROM a{r}, range(1, 65) t(i) GROUP BY cluster, i),
c{r + 1} AS MATERIALIZED (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{r} GROUP BY cluster
  UNION ALL SELECT cluster, x FROM c{r} WHERE cluster NOT IN (SELECT cluster FROM s{r}))"""
        )
    return f"""
WITH k AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) = 64),
g AS (SELECT * FROM k WHERE len(list_filter(e, lambda y: y IS NOT NULL AND isfinite(y))) = 64),
v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(e, lambda y: CAST(floor(1024 * y) AS BIGINT)) AS x FROM g),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS INTEGER) AS cluster, x FROM v ORDER BY sha256('3:' || vec_id) LIMIT 8),
{", ".join(steps)},
f AS MATERIALIZED ({near.format(c=f"c{rounds}")})
SELECT vec_id, f.cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY f.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256
FROM f JOIN c{rounds} ON f.cluster = c{rounds}.cluster"""


SQL = _sql()
