"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three transducers make it up:

  N  the normaliser: the file's map of characters, its rules for white space, blanks as U+2581
     (pieces.Normaliser);
  L  the lexicon: a trie of pieces whose last arc writes the piece's id with weight -score and
     returns to the start state;
  B  the fallback: from the start state and back, for any character, a path that writes the ids of
     its UTF-8 bytes (or the unknown id) with the penalty of an unknown character.

T = N o closure(L | B). L | B is a deterministic trie over characters whose final arcs carry (weight,
ids); the paths of B for a character are put into it when an input first has that character, since
there are as many as characters. Composing an input with N gives a chain of characters, and
composing that with closure(L | B) is done on the fly: the arcs out of a position are found by one
walk of the trie. The chain has no cycle, so the shortest path in the tropical semiring (min, +) is
one pass over positions in order.

For a unigram file the weight of an arc is its piece's negative score and the states of the
composition are positions; of equal weights the arc that starts first wins, see pieces.py.

For a merge (BPE) file no sum of weights gives the merges' result, but a local condition does: a
sequence of pieces is the encoding of its text exactly if merging each piece's characters gives the
piece and merging those of each two neighbours gives the two back. (Merges across a border depend on
its two sides only, and the first merge that would cross a border of the sequence would cross it in
that pair as well.) So T gets a state for the last piece written and an arc from a to b only if the
pair is stable; each arc weighs 1. Every prefix of the input then has one path, that of its own
encoding, so a state per position is enough and the weights have nothing to decide: the path of a chunk is looked for from
its start, the longest arc first, and a position from which the end wasn't reached isn't entered again. (A character that is no piece
is next to anything, so chunks with one take the weighted pass over all positions.)

No piece holds a blank after another character. So each chunk of a text (a word with the blank
before it) starts at a state of every path, the shortest path of a text is the chain of those of
its chunks, and a chunk seen before need not be composed again: workers keep a bounded cache.
Decoding composes ids with the inverse of T: piece and byte outputs are joined as bytes, U+2581
becomes a blank and the leading blank goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.pieces import BLANK, BYTE, CONTROL, UNKNOWN, Pieces, chunks
from tessera.session import released, ship, slices

#: Bytes of chunks with their ids that a worker keeps, and characters of the longest such chunk.
CACHE_BYTES, LONGEST = 90_000_000, 64
#: Bytes of texts that are encoded at once.
BATCH = 1_000_000
#: Pairs of pieces that a worker keeps with their stability.
PAIRS = 400_000
_held: dict[int, "Transducer"] = {}


class Transducer:
    """T for one model: encode() composes and takes the shortest path, decode() runs the inverse."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.arcs: dict = {}
        self.stable: dict[int, bool] = {}
        self.covered: set[str] = set()
        self.unknown: set[str] = set()
        for name, score in pieces.score.items():
            if pieces.merges and len(pieces.merged(name)) > 1:
                continue  # no merge makes this piece
            node = self.arcs
            for ch in name:
                node = node.setdefault(ch, {})
            node[""] = (-score, pieces.id[name], (pieces.id[name],))
        self.penalty = -pieces.unknown_score
        self.cache: dict[str, bytes] = {}
        self.held, self.room = 0, CACHE_BYTES
        self.text: list[bytes] = []
        for i, (name, kind) in enumerate(zip(pieces.names, pieces.types)):
            if kind == BYTE:
                self.text.append(bytes([int(name[1:-1], 16)]))
            elif kind == CONTROL:
                self.text.append(b"")
            elif kind == UNKNOWN:
                self.text.append(" ⁇ ".encode())
            else:
                self.text.append(name.replace(BLANK, " ").encode())

    def add_fallback(self, text: str) -> None:
        """Put the paths of B for the characters of ``text`` into the machine; single pieces need none, being lighter than any."""
        for ch in set(text) - self.covered:
            self.covered.add(ch)
            node = self.arcs.setdefault(ch, {})
            if "" not in node:
                p = self.pieces
                ids = tuple(p.bytes[b] for b in ch.encode("utf-8", "surrogatepass")) if p.fallback else (p.unknown,)
                node[""] = (self.penalty, -1, ids)
                self.unknown.add(ch)

    def pair(self, a: int, b: int) -> bool:
        """Whether pieces a and b may stand side by side; unknown characters (-1) are next to anything."""
        if a < 0 or b < 0:
            return True
        key = a << 32 | b
        got = self.stable.get(key)
        if got is None:
            names = self.pieces.names
            if len(self.stable) >= PAIRS:
                self.stable.clear()
            got = self.stable[key] = self.pieces.merged(names[a] + names[b]) == [names[a], names[b]]
        return got

    def stable_path(self, chunk: str) -> list[int]:
        """The one path of a chunk whose characters are all pieces."""
        n, start, pair, known = len(chunk), self.arcs, self.pair, self.stable
        out: list[int] = []
        at, before, dead = 0, -1, set()
        levels: list = []
        while True:
            node, k, arcs = start, at, []
            while k < n:
                node = node.get(chunk[k])
                if node is None:
                    break
                k += 1
                if "" in node:
                    arcs.append((k, node[""][1]))
            while True:
                while arcs:
                    k, piece = arcs.pop()
                    if k in dead:
                        continue
                    ok = True if before < 0 else known.get(before << 32 | piece)
                    if pair(before, piece) if ok is None else ok:
                        break
                else:
                    dead.add(at)
                    at, before, arcs = levels.pop()
                    out.pop()
                    continue
                break
            out.append(piece)
            if k == n:
                return out
            levels.append((at, before, arcs))
            at, before = k, piece

    def merge_path(self, chunk: str) -> list[int]:
        """The shortest path through states (position, last piece); each position has one."""
        n, start, pair = len(chunk), self.arcs, self.pair
        weight: list[float] = [0.0] + [float("inf")] * n
        last: list = [(0.0, -1, ())] + [None] * n
        back: list[int] = [-1] * (n + 1)
        for i in range(n):
            here = weight[i] + 1.0
            if here == float("inf"):
                continue  # no path ends here
            node, k, before = start, i, last[i][1]
            while k < n:
                node = node.get(chunk[k])
                if node is None:
                    break
                k += 1
                out = node.get("")
                if out is not None and here < weight[k] and pair(before, out[1]):
                    weight[k], last[k], back[k] = here, out, i
        return self._trace(last, back)

    @staticmethod
    def _trace(last: list, back: list[int]) -> list[int]:
        """The ids that a path writes, from where it ends."""
        out: list[tuple[int, ...]] = []
        k = len(back) - 1
        while k:
            out.append(last[k][2])
            k = back[k]
        return [i for ids in reversed(out) for i in ids]

    def path(self, chunk: str) -> list[int]:
        """Output ids of the shortest path of T composed with one chunk."""
        self.add_fallback(chunk)
        if self.pieces.merges:
            return self.stable_path(chunk) if chunk and self.unknown.isdisjoint(chunk) else self.merge_path(chunk)
        n, start = len(chunk), self.arcs
        best: list[float] = [0.0] + [float("inf")] * n
        last: list = [None] * (n + 1)
        back: list[int] = [-1] * (n + 1)
        for i in range(n):
            here, node, k = best[i], start, i
            while k < n:
                node = node.get(chunk[k])
                if node is None:
                    break
                k += 1
                out = node.get("")
                if out is not None:
                    w = here + out[0]
                    if w < best[k]:
                        best[k], last[k], back[k] = w, out, i
        return self._trace(last, back)

    def coded(self, chunk: str) -> bytes:
        """path() as little-endian 32-bit ids, through the cache."""
        got = self.cache.get(chunk)
        if got is None:
            got = np.array(self.path(chunk), "<i4").tobytes()
            cost = 180 + 2 * len(chunk) + len(got)
            if self.held + cost <= self.room and len(chunk) <= LONGEST:  # a full cache stays as it is: frequent chunks come early
                self.held += cost
                self.cache[chunk] = got
        return got

    def encode(self, text: str) -> np.ndarray:
        parts = chunks(self.pieces.normalised(text))
        try:
            raw = b"".join(map(self.cache.__getitem__, parts))
        except KeyError:
            raw = b"".join([self.coded(p) for p in parts])
        ids = np.frombuffer(raw, "<i4")
        if not self.pieces.fallback and len(ids):  # a run of unknown characters is one unknown piece
            ids = ids[np.r_[True, (ids[1:] != self.pieces.unknown) | (ids[:-1] != self.pieces.unknown)]]
        return ids

    def decode(self, ids) -> str:
        raw = b"".join(map(self.text.__getitem__, ids))
        if self.pieces.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def loaded(key: int, data: bytes) -> Transducer:
    """The worker's own transducer for a model, compiled once and kept with its cache."""
    got = _held.get(key)
    if got is None:
        _held.clear()
        got = _held[key] = Transducer(Pieces(data))
    return got


def model_bytes(spark, path: str) -> bytes:
    """The model file: any path that Spark reads, or a local one on the driver."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """(doc_id, n_chars, n_tokens, ids array<int>, round_trip) for every row of docs.

    round_trip tells whether decoding the ids gives the text back; it does for every text with byte
    fallback and no map of characters (the leading blank is put on and taken off), but for text that
    itself holds U+2581, which decodes to a blank. A null text counts as empty: no ids. Repeated rows stay.
    A worker keeps up to ``cache_bytes`` of encoded chunks; fewer cost time only.
    """
    spark = docs.sparkSession
    ship(spark)
    data = model_bytes(spark, model)
    key = hash(data)
    shared = spark.sparkContext.broadcast(data)
    src = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    zero = F.lit(0).cast("long")
    schema = src.select("doc_id", zero.alias("n_chars"), zero.alias("n_tokens"), F.array().cast("array<int>").alias("ids"), F.lit(True).alias("round_trip")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        t = loaded(key, shared.value)
        t.room = cache_bytes
        for b in slices(batches, 1, BATCH):
            texts = [x or "" for x in b.column(1).to_pylist()]
            ids = [t.encode(x) for x in texts]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            back = [t.decode(i.tolist()) == x for i, x in zip(ids, texts)]
            values = np.concatenate(ids) if ids else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(sizes), lists, pa.array(back, pa.bool_())], schema.names)

    return src.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """encoded with the column ``out``: the text of its ids (null for null ids)."""
    spark = encoded.sparkSession
    ship(spark)
    data = model_bytes(spark, model)
    key = hash(data)
    shared = spark.sparkContext.broadcast(data)
    src = encoded.withColumn(out, F.lit("").cast("string"))
    at, to = encoded.columns.index(ids), src.columns.index(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = loaded(key, shared.value)
        for b in batches:
            cols = list(b.columns)
            cols[to] = pa.array([None if x is None else t.decode(x) for x in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    return src.mapInArrow(run, src.schema)
