"""Benchmark decontamination by a generalised suffix automaton of the test items.

The automaton is built over the word ids of all items of a block (one path per item, states shared
between items). A document's words are streamed through it; the state and the length reached say
which is the longest suffix of the words read so far that occurs in some item. A window of an item
(``window`` consecutive words, or the whole of a shorter item) occurs in the document wherever that
length reaches the window's.

Streaming restarts exactly where it has to: between two neighbouring words that are neighbours in no
item, the longest match falls to one word at most. So the words are mapped to ids and neighbour
pairs are looked up for a whole batch at once, and only runs of neighbours long enough to hold a
window, or with a word that begins a shorter item, go through the automaton.

Items are cut into words by tasks; an item longer than ``SEGMENT`` words becomes segments that overlap
by a window less one word, which have the same windows. If all segments together have at most
``BLOCK_WORDS`` words, their automaton is a broadcast of that bounded size and documents pass once.
Beyond that the segments are dealt to blocks of about that size, and documents are joined with blocks:
each window of a segment has an anchor, its pair of neighbours with the longest words (a single word
has itself); a document that holds the window holds the anchor. Documents meet the anchors through a
bitmap of fixed size first, and what passes is joined with them, which gives the pairs of document
and block. A block's documents are split into parts of at most about ``PART_CHARS`` characters, and
each part is streamed through the block's automaton, which its task builds. No broadcast and nothing on
the driver grows with the items.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import ALNUM, as_bytes
from tessera.session import Scratch, ship, slices

WINDOW = 10
#: Words of items in one automaton: at some 300 bytes a state, under 200 MB.
BLOCK_WORDS = 300_000
#: Words of a segment of a long item.
SEGMENT = 50_000
#: Bytes of texts that pass the one automaton at once; their words are Python objects.
BATCH = 1_000_000
#: Bits of the bitmap of anchors (16 MB), and characters of documents that one task streams through a block's automaton.
ANCHOR_BITS, PART_CHARS = 1 << 27, 64_000_000
#: Slots of the table of neighbour pairs, a power of two.
PAIR_SLOTS = 1 << 24
#: A document is dropped by clean() if benchmark spans cover more than this share of its words.
COVERAGE = 0.5
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with the items that own each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.len = [0]
        self.names = [name for name, _ in items]
        coded = [[self.vocab.setdefault(w, len(self.vocab)) for w in ws] for _, ws in items]
        for ws in coded:
            last = 0
            for c in ws:
                last = self._extend(last, c)
        self._index(coded)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        q = nxt[last].get(c)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = self._state(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.len.append(length)
        return len(self.len) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        made = self._state(self.len[p] + 1)
        self.next[made] = dict(self.next[q])
        self.link[made], self.link[q] = self.link[q], made
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = made
            p = self.link[p]
        return made

    def _index(self, coded: list[list[int]]) -> None:
        """Which items own the window of a state; which shorter items end at a state; neighbour pairs."""
        self.owners: dict[int, list[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        first = np.zeros(max(1, len(self.vocab)), bool)
        pairs = []
        for i, ws in enumerate(coded):
            if not ws:
                continue
            pairs.append(np.array(ws, np.int64))
            state = 0
            if len(ws) < self.window:
                for c in ws:
                    state = self.next[state][c]
                self.short.setdefault(state, []).append((len(ws), i))
                first[ws[0]] = True
                continue
            for k, c in enumerate(ws):
                state = self.next[state][c]
                if k + 1 >= self.window:
                    own = self.owners.setdefault(self.window_state(state), [])
                    if not own or own[-1] != i:
                        own.append(i)
        self.first = first
        # The nearest state on the suffix path, itself included, at which shorter items end.
        self.short_at = [-1] * len(self.len)
        if self.short:
            for s in sorted(range(len(self.len)), key=self.len.__getitem__):
                self.short_at[s] = s if s in self.short else self.short_at[self.link[s]] if s else -1
        size = len(self.vocab)
        self.slots = min(PAIR_SLOTS, 1 << max(10, (size * size - 1).bit_length()))
        self.pair = np.zeros(self.slots, bool)
        for ws in pairs:
            self.pair[self.slot(ws[:-1], ws[1:])] = True

    def slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where the pair (a, b) is kept: exact if all pairs fit, else shared, which lets through too much and never too little."""
        return (a * len(self.vocab) + b) & (self.slots - 1)

    def window_state(self, state: int) -> int:
        """The state that holds the last ``window`` words of what leads to ``state``."""
        while self.len[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def run(self, ids: list[int], base: int, spans: list[tuple[int, int]], found: set[int]) -> None:
        """Stream ids; add (start, end) of windows that occur, offset by base, and the items that own them."""
        nxt, link, length, window = self.next, self.link, self.len, self.window
        state = size = 0
        for k, c in enumerate(ids):
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = nxt[state].get(c)
            if to is None:
                continue
            state, size = to, size + 1
            end = base + k + 1
            if size >= window:
                own = self.window_state(state)
                spans.append((end - window, end))
                found.update(self.owners[own])
            s = self.short_at[state]
            while s > 0:
                for n, i in self.short[s]:
                    if n <= size:
                        spans.append((end - n, end))
                        found.add(i)
                s = self.short_at[link[s]]

    def batch(self, docs: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[int]]]:
        """Per document: the spans of words that windows cover, unmerged, and the items found."""
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        out: list[tuple[list[tuple[int, int]], set[int]]] = [([], set()) for _ in docs]
        total = int(sizes.sum())
        if not total or not self.vocab:
            return out
        get, ids = self.vocab.get, np.empty(total + 1, np.int64)
        at = 0
        for ws in docs:
            ids[at : at + len(ws)] = np.fromiter(map(get, ws, repeat(-1)), np.int64, len(ws))
            at += len(ws)
        ids[total] = -1
        ends = np.cumsum(sizes)
        known = ids[:-1] >= 0
        joined = np.zeros(total, bool)  # whether word k and word k + 1 are neighbours in an item
        both = np.flatnonzero(known & (ids[1:] >= 0))
        joined[both[self.pair[self.slot(ids[both], ids[both + 1])]]] = True
        joined[ends[sizes > 0] - 1] = False
        last = np.flatnonzero(~joined)
        start = np.r_[0, last[:-1] + 1]
        take = last + 1 - start >= self.window
        if self.short:
            opens = np.flatnonzero(known & self.first[np.where(known, ids[:-1], 0)])
            take[np.searchsorted(last, opens)] = True
        for k in np.flatnonzero(take).tolist():
            a, b = int(start[k]), int(last[k]) + 1
            d = int(np.searchsorted(ends, a, side="right"))
            self.run(ids[a:b].tolist(), a - int(ends[d] - sizes[d]), *out[d])
        return out


def segments(items: DataFrame, item_id: str, text: str, window: int = WINDOW, most: int | None = None) -> DataFrame:
    """(item, n, words): items with an id and words, cut into segments; words are joined by blanks."""
    most = most or SEGMENT
    src = items.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{text}`").cast("string").alias("_text")).where("item is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for name, t in zip(b.column(0).to_pylist(), as_bytes(b.column(1))):
                ws = words(t)
                for k in range(0, max(1, len(ws) - window + 1), most):
                    part = ws[k : k + most + window - 1]
                    if part:
                        out.append((name, len(part), b" ".join(part).decode("utf-8", "surrogatepass")))
            kinds = (pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(3)], ["item", "n", "words"])

    return src.mapInArrow(run, "item string, n long, words string")


def _listed(rows) -> list[tuple[str, list[bytes]]]:
    return [(name, t.encode("utf-8", "surrogatepass").split(b" ")) for name, t in rows]


def _hashed(ws: list[bytes]) -> np.ndarray:
    """A hash for each word, as signed 64-bit integers."""
    return np.fromiter(map(xxhash.xxh64_intdigest, ws), np.uint64, len(ws)).view(np.int64)


def _pairs(h: np.ndarray) -> np.ndarray:
    """A hash for each pair of neighbours."""
    return h[:-1] * np.int64(0x5851F42D4C957F2D) ^ (h[1:] + np.int64(0x14057B7EF767814F))


def anchors(ws: list[bytes], window: int = WINDOW) -> np.ndarray:
    """The anchors of all windows of a segment: the pair with the longest words of each, or the only word."""
    h = _hashed(ws)
    if len(ws) == 1:
        return h
    pairs = _pairs(h)
    size = np.fromiter(map(len, ws), np.int64, len(ws))
    # Longer pairs first, then the greater hash, so that a pair's rank does not depend on its place.
    rank = ((size[:-1] + size[1:]) << np.int64(40)) | (pairs.view(np.uint64) >> np.uint64(24)).astype(np.int64)
    wide = min(window - 1, len(pairs))
    seen = np.lib.stride_tricks.sliding_window_view(rank, wide)
    return np.unique(pairs[np.arange(len(seen)) + seen.argmax(axis=1)])


def _bitmap(spark, found: DataFrame) -> np.ndarray:
    """The slots of the anchors (a) as bits; at most ANCHOR_BITS / 64 rows come to the driver."""
    slot = F.col("a").bitwiseAND(F.lit(ANCHOR_BITS - 1))
    rows = found.select(F.shiftright(slot, 6).alias("w"), F.expr(f"shiftleft(1L, cast(a & {63} as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    got = rows.toArrow()
    bits = np.zeros(ANCHOR_BITS // 64, np.int64)
    bits[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return bits


def _through_blocks(docs: DataFrame, cut: DataFrame, total: int, text: str, window: int, most: int) -> DataFrame:
    """(_row, _spans, _items) of the rows of ``docs`` (with _row) in which windows occur, block by block."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    count = -(-total // most)
    dealt = scratch.write(cut.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(count)).cast("int")), "segments")

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [anchors(ws, window) for _, ws in _listed(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))]
            at = np.repeat(np.array(b.column(2).to_pylist(), np.int32), [len(x) for x in got])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got) if got else np.empty(0, np.int64)), pa.array(at)], ["a", "block"])

    marks = scratch.write(dealt.select("item", "words", "block").mapInArrow(anchored, "a long, block int").distinct(), "anchors")
    bits = spark.sparkContext.broadcast(_bitmap(spark, marks.select("a")))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for b in slices(batches, 1):
            names, rows = [], []
            for row, t in zip(b.column(0).to_pylist(), as_bytes(b.column(1))):
                ws = words(t)
                if not ws:
                    continue
                h = _hashed(ws)
                every = np.unique(np.concatenate([h, _pairs(h)]))
                slot = every & (ANCHOR_BITS - 1)
                names.append(every[(table[slot >> 6] >> (every & 63)) & 1 == 1])
                rows.append(row)
            sizes = [len(x) for x in names]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(rows, np.int64), sizes)), pa.array(np.concatenate(names) if names else np.empty(0, np.int64))], ["_row", "a"])

    seen = docs.select("_row", F.col(f"`{text}`").cast("string").alias("_text"))
    pairs = scratch.write(seen.mapInArrow(met, "_row long, a long").join(marks, "a").select("_row", "block").distinct(), "pairs")
    each = pairs.join(seen.select("_row", F.length("_text").alias("_size")), "_row")
    parts = each.groupBy("block").agg(F.ceil(F.sum("_size") / PART_CHARS).cast("int").alias("parts"))
    parts = scratch.write(parts.withColumn("parts", F.greatest("parts", F.lit(1))), "parts")
    left = pairs.join(F.broadcast(parts), "block").withColumn("part", F.pmod(F.xxhash64("_row"), F.col("parts")).cast("int")).join(seen, "_row").select("block", "part", "_row", "_text")
    right = dealt.join(F.broadcast(parts), "block").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "item", "words")

    def matched(rows: pa.Table, own: pa.Table) -> pa.Table:
        out = ([], [], [])
        auto = SuffixAutomaton(_listed(zip(own.column("item").to_pylist(), own.column("words").to_pylist())), window)
        for b in slices(rows.combine_chunks().to_batches(), 3):
            ids = b.column(2).to_pylist()
            for row, (spans, found) in zip(ids, auto.batch([words(t) for t in as_bytes(b.column(3))])):
                if spans:
                    out[0].append(row)
                    out[1].append([x for pair in spans for x in pair])
                    out[2].append([auto.names[x] for x in found])
        return pa.table([pa.array(v, k) for v, k in zip(out, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())))], ["_row", "_spans", "_items"])

    hits = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(matched, "_row long, _spans array<long>, _items array<string>")
    return hits.groupBy("_row").agg(F.flatten(F.collect_list("_spans")).alias("_spans"), F.flatten(F.collect_list("_items")).alias("_items"))


def _through(docs: DataFrame, items: DataFrame, text: str, item_id: str, item_text: str, window: int, finish, schema) -> DataFrame:
    """Find the items' windows in docs and let finish(batch, words, spans, items) make the result.

    spans has a list (start, end, start, ...) of windows per row, items the ids found.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    cut = scratch.write(segments(items, item_id, item_text, window), "items")
    total = cut.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    at = docs.columns.index(text)
    if total <= BLOCK_WORDS:
        shared = spark.sparkContext.broadcast(SuffixAutomaton(_listed(cut.select("item", "words").collect()), window))

        def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            auto = shared.value
            for b in slices(batches, at, BATCH):
                docs_words = [words(t) for t in as_bytes(b.column(at))]
                spans, names = [], []
                for s, i in auto.batch(docs_words):
                    spans.append([x for pair in s for x in pair])
                    names.append([auto.names[x] for x in i])
                yield finish(b, docs_words, spans, names)

        return docs.mapInArrow(once, schema)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = scratch.write(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*columns).alias("_doc")), "documents")
    flat = rows.select("_row", F.col(f"_doc.`{text}`").alias("_body"))
    hits = scratch.write(_through_blocks(flat, cut, total, "_body", window, BLOCK_WORDS), "hits")
    none = lambda kind: F.array().cast(kind)
    joined = rows.join(hits, "_row", "left").select("_doc", F.coalesce("_spans", none("array<long>")).alias("_spans"), F.coalesce("_items", none("array<string>")).alias("_items"))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc = b.column(0)
            own = pa.RecordBatch.from_arrays(doc.flatten(), [f.name for f in doc.type])
            yield finish(own, [words(t) for t in as_bytes(own.column(at))], b.column(1).to_pylist(), b.column(2).to_pylist())

    return joined.mapInArrow(last, schema)


def merged(flat: list[int]) -> list[tuple[int, int]]:
    """Disjoint spans in order, from (start, end, start, ...)."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(flat[::2], flat[1::2])):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def report(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of docs.

    A null text has no words; items without words or id match nothing; equal items both count.
    items_sha256 is the digest of the item ids found, sorted as strings and joined by commas (of
    the empty string if there are none).
    """
    src = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    schema = src.select("doc_id", *[F.lit(0).cast("long").alias(c) for c in ("n_words", "n_hit", "n_items")], F.lit("").alias("items_sha256"), F.lit(True).alias("contaminated")).schema

    def finish(b, docs_words, spans, names):
        hit = [sum(y - x for x, y in merged(s)) if s else 0 for s in spans]
        names = [sorted(set(x)) for x in names]
        digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(map(len, docs_words), pa.int64()), pa.array(hit, pa.int64()), pa.array(map(len, names), pa.int64()), pa.array(digest, pa.string()), pa.array([x > 0 for x in hit], pa.bool_())],
            schema.names,
        )

    return _through(src, items, "_text", item_id, item_text, window, finish, schema)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of spans, from the first's start to the last's end, and the blank that follows."""
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    rest = text[at:]
    if out and (not out[-1] or out[-1][-1].isspace()):
        rest = rest.lstrip(" ")
    return "".join(out) + rest


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, coverage: float = COVERAGE, n_chars: str | None = "n_chars") -> DataFrame:
    """docs without benchmark passages: spans of words in a window go; rows covered beyond ``coverage`` go.

    The columns of docs stay, the column ``n_chars``, if there is one, counts the text that is left.
    Rows with a null text stay.
    """
    at, count = docs.columns.index(text), docs.columns.index(n_chars) if n_chars in docs.columns else None

    def finish(b, docs_words, spans, names):
        if not any(spans):
            return b
        texts, keep = b.column(at).to_pylist(), []
        counts = b.column(count).to_pylist() if count is not None else None
        for k, flat in enumerate(spans):
            if flat:
                own = merged(flat)
                if sum(y - x for x, y in own) > coverage * len(docs_words[k]):
                    continue
                texts[k] = cut(texts[k], own)
                if counts is not None:
                    counts[k] = len(texts[k])
            keep.append(k)
        cols = list(b.columns)
        cols[at] = pa.array(texts, b.schema.field(at).type)
        if counts is not None:
            cols[count] = pa.array(counts, b.schema.field(count).type)
        return pa.RecordBatch.from_arrays(cols, b.schema.names).take(pa.array(keep, pa.int64()))

    return _through(docs, items, text, item_id, item_text, window, finish, docs.schema)


_SQL_WORDS = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
b AS (SELECT row_number() OVER () AS k, item_id::VARCHAR AS item, {_SQL_WORDS.format("coalesce(text, '')")} AS ws FROM benchmark),
win AS (SELECT DISTINCT item, least(len(ws), {WINDOW}) AS n, array_to_string(ws[i : i + least(len(ws), {WINDOW}) - 1], chr(32)) AS g
  FROM b, unnest(range(1, greatest(len(ws) - {WINDOW} + 1, 1) + 1)) AS t(i) WHERE len(ws) > 0 AND item IS NOT NULL),
dw AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
dg AS (SELECT r, i, w AS first, n, string_agg(w, chr(32)) OVER (PARTITION BY r, n ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS g10 FROM dw, (SELECT DISTINCT n FROM win)),
dn AS (SELECT r, i, n, CASE WHEN n = {WINDOW} THEN g10 ELSE array_to_string(string_split(g10, chr(32))[1:n], chr(32)) END AS g FROM dg),
hit AS (SELECT r, i, win.n, item FROM dn JOIN win ON dn.n = win.n AND dn.g = win.g),
words AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM hit, unnest(range(0, n)) AS t(j) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hit GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
