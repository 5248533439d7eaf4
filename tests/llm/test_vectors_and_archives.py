"""Clusters, hard negatives and archives against brute force, on odd values, ties, repeats, empty tables and clashing columns."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import dualtree, negatives, warc
from tests.conftest import DATA

MAGIC = "WARC/1.1\r\n"
INNER = MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:x-page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


@pytest.mark.parametrize("trial", range(12))
def test_dual_trees_find_the_nearest(trial):
    r = np.random.default_rng(trial)
    n, d, k = int(r.integers(1, 400)), int(r.integers(1, 6)), int(r.integers(1, 40))
    points = r.integers(-30, 30, (n, d)) if trial % 3 else np.repeat(r.integers(-3, 3, (1 + n // 20, d)), 20, axis=0)
    centroids = r.integers(-30, 30, (k, d)) if trial % 2 else points[r.integers(0, len(points), k)]
    tree, over = dualtree.Tree.over(points, int(r.integers(1, 20))), dualtree.Tree.over(centroids, 1)
    assert sorted(tree.order) == list(range(len(points)))
    for c, radius, b, e in zip(tree.centre, tree.radius, tree.begin, tree.end, strict=True):
        assert c in tree.order[b:e] and np.sqrt(np.square(points[tree.order[b:e]] - points[c]).sum(1)).max() <= radius + 1e-9
    i, j, whole = dualtree.assign(points, tree, centroids, over)
    got = np.full(len(points), -1)
    got[i] = j
    for b, e, c in whole:
        assert (got[tree.order[b:e]] == -1).all()
        got[tree.order[b:e]] = c
    assert (got == np.square(points[:, None] - centroids[None]).sum(-1).argmin(1)).all()


def test_subtrees_are_assigned_whole():
    r = np.random.default_rng(1)
    points = np.vstack([r.integers(-5, 5, (500, 8)) + 1000 * k for k in range(4)])
    i, _, whole = dualtree.assign(points, dualtree.Tree.over(points, 16), points[::500], dualtree.Tree.over(points[::500], 1))
    assert not len(i) and len(whole) < 40


def lloyd(rows, k, rounds, dims, scale, seed):
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and np.isfinite(x) for x in e)]
    kept = [(i, v) for i, v in kept if max(map(abs, v)) < dualtree.REACH]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    means = [v for _, v in first]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((square(v, m), c) for c, m in enumerate(means))
    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        means = [[sum(x) // at.count(c) for x in zip(*(v for (_, v), a in zip(kept, at, strict=True) if a == c), strict=True)] if c in at else m for c, m in enumerate(means)]
    out = [(i, c, d) for i, v in kept for d, c in [nearest(v)]]
    return sorted(((i, c, d, sum(x[2] for x in out if x[1] == c), sum(x[2] for x in out), hashlib.sha256(",".join(map(str, means[c])).encode()).hexdigest()) for i, c, d in out), key=repr)


def test_clusters_equal_brute_force(spark):
    r = random.Random(2)
    rows = [(r.choice([None, *range(80)]), [r.choice([-1.5, -0.001, 0.0, 0.25, 1.0]) for _ in range(r.choice([3, 3, 3, 2, 4]))]) for _ in range(150)]
    rows += [(1, None), (2, []), (3, [float("nan"), 1.0, 1.0]), (4, [float("inf"), 0.0, 0.0]), (5, [None, 0.0, 0.0]), (6, [1e30, 0.0, 0.0]), (7, [0.5, 0.5, 0.5]), (7, [0.5, 0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"cluster": F.lit(9), "v": F.lit(8), "ids": F.lit(7)})
    for block, leaf in ((1024, 16), (7, 2)):
        got = dualtree.cluster(df, k=5, rounds=4, dims=3, block=block, leaf=leaf).collect()
        assert sorted(map(tuple, got), key=repr) == lloyd(rows, 5, 4, 3, 1024, 3)
    assert sorted(map(tuple, dualtree.cluster(df, k=500, rounds=1, dims=3).collect()), key=repr) == lloyd(rows, 500, 1, 3, 1024, 3)
    none = dualtree.cluster(df.where("vec_id > 1000"), dims=3)
    assert none.collect() == [] and none.dtypes == dualtree.cluster(df, dims=3, rounds=0).dtypes


def mined(rows):
    kept = []
    for i, label, e in rows:
        if i is None or label is None or e is None or any(x is None or not np.isfinite(x) for x in e):
            continue
        v = [int(np.floor(256 * float(np.float32(x)))) for x in e] + [0] * (3 - len(e))
        if sum(x * x for x in v) <= negatives.REACH:
            kept.append((i, label, v))
    out = []
    for a, (i, label, v) in enumerate(kept):
        if i % 100:
            continue
        scored = [(-sum(p * q for p, q in zip(v, w, strict=True)), j, m) for b, (j, m, w) in enumerate(kept) if b != a]
        for s, j, _ in sorted(x for x in scored if x[2] == label)[:5]:
            some = sorted(x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s)[:10]
            out += [(i, j, n + 1, x[1], -s, -x[0]) for n, x in enumerate(some)]
    return sorted(out)


def test_hard_negatives_equal_brute_force(spark):
    r = random.Random(3)
    rows = [(r.randrange(400) if k % 9 else r.randrange(4) * 100, r.choice([0, 1, 2, None]), [r.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(r.choice([3, 3, 3, 2, 0]))]) for k in range(400)]
    rows += [(100, 1, None), (None, 1, [1.0] * 3), (200, 1, [float("nan"), 1.0, 1.0]), (200, 0, [float("inf"), 1.0, 1.0]), (300, 0, [None, 1.0, 1.0]), (1, 1, [1e30, 1.0, 1.0]), (100, 1, [1.0] * 3), (100, 1, [1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({"uid": F.lit(1), "far": F.lit(2), "slice": F.lit(3)})
    for odd in ({}, {"chunk": 2, "slice_rows": 10}, {"pivots": 1}):
        assert sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, **odd).collect())) == mined(rows)
    assert negatives.hard_negatives(df, F.col("vec_id") < 0).collect() == []
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_brackets_hold_every_score_and_discard_some():
    r = np.random.default_rng(4)
    points = np.vstack([r.integers(-9, 9, (300, 6)) + 200 * np.eye(6)[k] for k in range(3)])
    norm = np.square(points).sum(1)
    most = norm.max()
    far, asks = (distances for distances in (negatives.distances(negatives.augmented(points, norm, most, a), negatives.chosen(negatives.augmented(points, norm, most, False), 8)) for a in (False, True)))
    near, away = np.abs(asks[:, None] - far[None]).max(2), (asks[:, None] + far[None]).min(2)
    base = (norm + most)[:, None]
    low, high, exact = (base - away**2) / 2 - 1, (base - near**2) / 2 + 1, points @ points.T
    assert (low <= exact).all() and (exact <= high).all()
    assert (high < 0.5 * exact.diagonal()[:, None]).mean() > 0.5


def told(rows):
    out = []
    for i, _, b in rows:
        last = max((j for j, _, c in rows if (c or "") == (b or "") and j is not None), default=None)
        digest = base64.b32encode(hashlib.sha1((b or "").encode()).digest()).decode()
        out.append((i, len((b or "").encode()), digest, "response" if i == last else "revisit", None if i == last else last))
    return sorted(out, key=repr)


def hostile():
    r = random.Random(5)
    bodies = ["", None, "\r\n", "\r\n\r\n", MAGIC, MAGIC * 50, INNER, "a" + INNER * 3 + "b", "x" + MAGIC + "Content-Length: 99999\r\n\r\n", INNER * 300, "é日本" * 100, "A" * 5000]
    bodies += ["".join(r.choice([MAGIC, "\r\n", "z" * 37, INNER, "q"]) for _ in range(r.randrange(40))) for _ in range(40)]
    rows = [(i, "http://x/WARC/1.1\r\n%20 " if i % 3 else None, b) for i, b in enumerate(bodies)]
    return rows + [(500, "u", "dup"), (501, "u", "dup"), (502, "u", "dup"), (502, "u", "dup"), (None, "u", "dup"), (None, None, None)]


@pytest.mark.parametrize("split", ["64m", "777b"])
def test_archives_give_back_every_page(spark, split):
    rows = hostile()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"sha": F.lit(1), "bytes": F.lit(2), "first": F.lit("x")}).coalesce(2)
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        assert sorted(map(tuple, warc.page_records(df).collect()), key=repr) == told(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def test_archives_hold_payloads_and_headers(spark, tmp_path):
    rows = [r for r in hostile() if r[0] is not None and r[2]]
    path = f"file://{tmp_path}/warc"
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = warc.read(spark, path).where("kind = 'response'").collect()
    assert {bytes(r.payload).decode() for r in got} == {b for _, _, b in rows} and all(r.end > r.offset for r in got)
    assert {r.target for r in got} == {"http://x/WARC%2F1.1%0D%0A%2520%20", "u", None}
    assert warc.broken(spark, path).count() == 0


def test_broken_chains_are_reported(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes((INNER + "junk" + INNER).encode())
    (tmp_path / "b.warc").write_bytes(b"no archive")
    (tmp_path / "c.warc").write_bytes((INNER * 3).encode())
    got = {r.file.rsplit("/", 1)[1]: r.offset for r in warc.broken(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.warc": len(INNER), "b.warc": 0}
    assert warc.read(spark, f"file://{tmp_path}").count() == 4


def test_archives_of_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.page_records(df).collect() == []


@pytest.mark.parametrize("name", ["op11_dual_tree_lloyd", "op12_warc_chain", "op13_hard_negatives"])
def test_queries_equal_their_sql(spark, duck, name):
    from tessera.llm import registry

    df = registry.queries()[name](spark, DATA)
    q = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(q.fetchall(), key=repr)
