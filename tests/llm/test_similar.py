"""Near duplicates by similarity: components against brute force over all pairs, crowds, odd rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import similar
from tests.conftest import DATA

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t, size=5):
    w = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute(rows, similarity=0.8):
    """doc_id -> least doc_id, by all pairs of rows."""
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] == sets[j] or common >= similarity * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return sorted(((i, least[find(k)]) for k, (i, _) in enumerate(rows)), key=repr)


def variants(seed, n, base=200):
    """Texts that each differ from one text by a few words."""
    r = random.Random(seed)
    words = [f"w{seed}x{k}" for k in range(base)]
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(r.randrange(4)):
            w[r.randrange(base)] = f"z{r.random()}"
        out.append(" ".join(w))
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_t": F.lit(1), "_fp": F.lit(2), "text_key": F.lit(3), "key": F.lit(4)})
    return similar.near_duplicates(df), df


def test_components_equal_brute_force(spark):
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    rows = real + [(1000 + 100 * s + k, t) for s in range(3) for k, t in enumerate(variants(s, 12))]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "a b"), (2004, "A  b"), (2005, "a b c"), (None, "a b"), (None, "x y z"), (2003, "a b")]
    got, _ = run(spark, rows)
    assert sorted(((r.doc_id, r.component_id) for r in got.collect()), key=repr) == brute(rows)


def test_crowds_are_not_paired_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(similar, "CROWD", 6)
    rows = [(100 * s + k, t) for s in range(2) for k, t in enumerate(variants(s + 10, 60))]
    shared = " ".join(f"passage{k}" for k in range(40))
    rows += [(1000 + k, shared + " " + " ".join(f"own{k}x{j}" for j in range(60))) for k in range(40)]
    got, _ = run(spark, rows)
    assert sorted(((r.doc_id, r.component_id) for r in got.collect()), key=repr) == brute(rows)


def test_a_crowd_loses_no_link_between_its_groups(spark, monkeypatch):
    """Pairs of texts that are alike, among many that only have a passage in common with them; no turn draws them together."""
    monkeypatch.setattr(similar, "CROWD", 6)
    monkeypatch.setattr(similar, "BLOCK", 7)
    shared = " ".join(f"passage{k}" for k in range(400))
    rows = []
    for k in range(30):
        own = [f"own{k}x{j}" for j in range(120)]
        rows += [(10 * k, shared + " " + " ".join(own)), (10 * k + 1, shared + " " + " ".join([*own[:117], "a", f"b{k}", "c"])), (10 * k + 2, shared + " " + " ".join([*own[:20], f"d{k}", *own[21:]]))]
    got, _ = run(spark, rows)
    assert sorted(((r.doc_id, r.component_id) for r in got.collect()), key=repr) == brute(rows)


def test_repeats_do_not_part_equal_sets(spark):
    """Texts of the same shingles, one of which says one of them hundreds of times."""
    rows = []
    for k in range(12):
        rest = " ".join(f"r{k}x{j}" for j in range(60))
        rows += [(2 * k, rest + f" again{k}" * 6), (2 * k + 1, rest + f" again{k}" * 400)]
    got, _ = run(spark, rows)
    assert {r.doc_id: r.component_id for r in got.collect()} == dict(brute(rows)) == {i: i - i % 2 for i, _ in rows}


def test_one_row_of_each_component_stays(spark):
    a = variants(5, 6)
    rows = [(k, t) for k, t in enumerate(a)] + [(50, "other text of its own here"), (50, "other text of its own here"), (None, a[0]), (None, "free"), (None, "free"), (60, None)]
    _, df = run(spark, rows)
    kept = similar.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(0, a[0]), (50, "other text of its own here"), (None, "free"), (60, None)], key=repr)
    assert similar.deduplicate(df.limit(0)).collect() == []


@pytest.mark.parametrize("similarity", [0.75, 0.8, 0.9])
def test_keys_find_pairs_of_the_similarity(similarity):
    assert 1 - (1 - similarity**similar.ROWS) ** similar.BANDS > 0.999


def test_a_crowd_of_unlike_texts_makes_no_pairs(spark, monkeypatch):
    """Texts that share a long passage, and so their keys, but not enough to be alike: the pairs that are compared grow with the texts."""
    monkeypatch.setattr(similar, "CROWD", 6)
    compared, write = [], similar.Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        if name == "near":
            compared.append(out.count())
        return out

    monkeypatch.setattr(similar.Scratch, "write", counted)
    shared = " ".join(f"passage{k}" for k in range(400))
    rows = [(k, shared + " " + " ".join(f"own{k}x{j}" for j in range(150))) for k in range(100)] + [(200, shared + " " + " ".join(f"own7x{j}" for j in range(148)))]
    got, _ = run(spark, rows)
    assert sorted(((r.doc_id, r.component_id) for r in got.collect()), key=repr) == brute(rows)
    assert sum(compared) < 20 * len(rows)


def test_a_text_that_has_its_like_in_a_crowd_does_not_meet_all_of_it(spark, monkeypatch):
    """Texts two words off a base, few one word off, and some three words off, which are like the few only. Such a text, once it has met one of these, meets no more of their component."""
    monkeypatch.setattr(similar, "CROWD", 6)
    monkeypatch.setattr(similar, "LEFT", 0)
    compared, write = [], similar.Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        if name == "beyond":
            compared.append(out.count())
        return out

    monkeypatch.setattr(similar.Scratch, "write", counted)
    r, rows = random.Random(3), []
    for i, off in enumerate([2] * 600 + [1] * 8 + [3] * 150):
        w = [f"w{k}" for k in range(200)]
        for k in r.sample(range(5, 195), off):
            w[k] = f"z{i}x{k}"
        rows.append((i, " ".join(w)))
    got, _ = run(spark, rows)
    assert {r.doc_id: r.component_id for r in got.collect()} == dict(brute(rows))
    assert 0 < sum(compared) < 2_500, compared
