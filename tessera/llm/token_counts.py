"""Token counts of a unigram vocabulary without making tokens.

An Aho-Corasick automaton over the pieces reports every match in a text, by end position. Dynamic
programming over those ends carries two numbers per position: the best score and the number of
tokens on the path that has it. No back pointers are kept and no ids are made. An unknown character
counts as many tokens as it has UTF-8 bytes where the model has byte fallback, else one.

Ties are the tokenizer's: among equal scores at an end, the longest piece wins (pieces.py). The
automaton reports matches of an end from the longest to the shortest, and only a strictly better
score replaces one, so no sorting is needed.

As in transducer.py no piece crosses into a chunk, so scores and counts of chunks add up and each
worker keeps a bounded cache of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.pieces import Pieces, chunks
from tessera.llm.transducer import model_bytes
from tessera.session import ship, slices

#: Bytes of chunks with their counts that a worker keeps, and characters of the longest such chunk.
CACHE_BYTES, LONGEST = 120_000_000, 64
_held: dict[int, "Counter"] = {}


class Counter:
    """Counts for one model."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.auto = ahocorasick.Automaton()
        for name, score in pieces.score.items():
            self.auto.add_word(name, (len(name), score))
        self.auto.make_automaton()
        self.cache: dict[str, tuple[int, float]] = {}
        self.held = 0

    def chunk(self, s: str) -> tuple[int, float]:
        """(tokens, score) of the best segmentation of s."""
        n, low = len(s), float("-inf")
        score, count = [0.0] + [low] * n, [0] * (n + 1)
        known = [False] * (n + 1)  # whether the character before a position is a piece by itself
        unknown, fallback = self.pieces.unknown_score, self.pieces.fallback
        at, best, made = 0, low, 0  # the end being gathered

        def close(end: int) -> None:
            """Settle the ends up to ``end``, in which a character may be unknown."""
            nonlocal at, best, made
            while at < end:
                if at:
                    # The path through an unknown character starts last, so it only wins by a better score.
                    if not known[at] and score[at - 1] + unknown > best:
                        best, made = score[at - 1] + unknown, count[at - 1] + (len(s[at - 1].encode("utf-8", "surrogatepass")) if fallback else 1)
                    score[at], count[at] = best, made
                at, best, made = at + 1, low, 0

        for last, (length, weight) in self.auto.iter(s):
            end = last + 1
            if end > at:
                close(end)
            if length == 1:
                known[end] = True
            w = score[end - length] + weight
            if w > best:
                best, made = w, count[end - length] + 1
        close(n + 1)
        return count[n], score[n]

    def of(self, s: str) -> tuple[int, float]:
        got = self.cache.get(s)
        if got is None:
            got = self.chunk(s)
            cost = 240 + 2 * len(s)
            if self.held + cost <= CACHE_BYTES and len(s) <= LONGEST:  # a full cache stays as it is: frequent chunks come early
                self.held += cost
                self.cache[s] = got
        return got

    def text(self, text: str) -> tuple[int, float]:
        """(tokens, score) of a whole text."""
        parts = chunks(self.pieces.normalised(text))
        try:
            got = list(map(self.cache.__getitem__, parts))
        except KeyError:
            got = [self.of(p) for p in parts]
        return sum(x for x, _ in got), sum(x for _, x in got)


def count(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, n_tokens, score) for every row of docs.

    score is the total of the best segmentation. A null text counts as empty: 0 tokens, score 0.
    Repeated rows stay.
    """
    spark = docs.sparkSession
    ship(spark)
    data = model_bytes(spark, model)
    key = hash(data)
    shared = spark.sparkContext.broadcast(data)
    src = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    zero = F.lit(0).cast("long")
    schema = src.select("doc_id", zero.alias("n_chars"), zero.alias("n_tokens"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _held.get(key)
        if c is None:
            _held.clear()
            c = _held[key] = Counter(Pieces(shared.value))
        for b in slices(batches, 1):
            texts = [x or "" for x in b.column(1).to_pylist()]
            got = [c.text(x) for x in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array([x for x, _ in got], pa.int64()), pa.array([x for _, x in got], pa.float64())], schema.names)

    return src.mapInArrow(run, schema)
