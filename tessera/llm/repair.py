"""Token-id files compressed by Re-Pair grammars.

Texts are encoded, ordered by id over the whole table and cut into shards of some ``SHARD`` tokens.
In a shard the most frequent pairs of neighbouring symbols are replaced by new symbols, round after
round, until no pair occurs so often that a rule for it would make the shard smaller. A round counts
all pairs exactly, takes those at least a twentieth (``SHARE``) as frequent as the most frequent, and where
chosen pairs overlap the more frequent one goes first; rules that would not pay are taken back and
counted anew in the next round. Symbols outgrow 16 bits if that makes the shard smaller. The end id
closes every document and takes part in no pair, so documents begin at symbol borders.

A shard is one binary value:

  header   8 unsigned 32-bit numbers: magic, base (first rule's symbol), rules, symbols, documents,
           tokens, bytes per symbol, 0
  ids      the id of each symbol below base: those that the shard has, so that few bits do
  rules    two unsigned 32-bit symbols each, those of earlier rounds first
  lengths  the expansion length of each rule, unsigned 32-bit
  docs     symbols of each document, unsigned 32-bit
  symbols  little-endian, 2, 3 or 4 bytes each

All numbers are little-endian. The lengths let a reader find a document, or a token of one, by adding
lengths, and expand nothing but what it needs. Shards are rows of a Parquet table, which any Spark
file system takes and whose writer commits a task's output as a whole, so that a lost executor
leaves no half file behind.

Encoding is the tokenizer's own on parts of the text: its pattern always starts a new part at a
blank that no white space follows, and makes a part of a line feed between other characters. So the
distinct parts of some texts are encoded one by one and kept in a cache of a bounded size in bytes.
Texts with other white space, or with an added token of the file, are encoded whole, and so are all
texts where the file's rules are others.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import Scratch, gathered, ship

MAGIC = 0x52507231
END = 0
SHARD = 1 << 21
#: A round takes pairs of at least this share of the highest count.
SHARE = 0.05
#: Bytes of a rule: two symbols and its length.
RULE = 12
#: Bytes of parts with their ids that a worker keeps, and characters of the longest such part.
CACHE_BYTES, LONGEST = 260_000_000, 64
#: Characters of texts that are encoded at once; a longer text is by itself.
SLICE = 8_000_000
#: Letters of one part, and marks that make another when they follow letters.
LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: White space that parts do not provide for: other than blanks and line feeds, a blank beside white space or at the end, three line feeds or two at the end.
UNUSUAL = r"[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|  | \n|\n |\n\n\n|\n\n\z| \z"
#: The character that stands for a byte in a byte-level vocabulary: itself if it can be printed, else those from U+0100 on.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in PRINTED)}
_held: dict[tuple, "Encoder"] = {}


class Encoder:
    """Exact ids of a tokenizer file, part by part where the file's rules allow it.

    ``special_as_text`` takes the strings of special tokens in a text for ordinary text; otherwise they
    are special tokens, as they are to the library by default.
    """

    def __init__(self, data: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data)
        self.tokenizer.encode_special_tokens = special_as_text
        self.model = self.tokenizer.model
        spec = json.loads(data)
        added = [t["content"] for t in spec.get("added_tokens") or [] if not (special_as_text and t.get("special"))]
        #: Texts that are encoded whole.
        self.whole = "|".join([UNUSUAL, *map(_literal, added)]) if self._by_parts(spec) else ""
        self.cache: dict[str, bytes] = {"": self._plain([" "])[0]}
        self.marks: dict[str, bytes] = {}
        self.held = 0

    @staticmethod
    def _by_parts(spec: dict) -> bool:
        """Whether the file's rules are those that parts rely on: byte-level merges, cut by the usual pattern, nothing else."""
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        usual = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        odd = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "ignore_merges"))
        return usual and spec.get("normalizer") is None and model.get("type", "BPE") == "BPE" and not odd

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _marks(self, x: str) -> bytes:
        got = self.marks.get(x)
        if got is None:
            if len(self.marks) > 10_000:
                self.marks.clear()
            got = self._plain([x])[0]
            if len(x) <= LONGEST:
                self.marks[x] = got
        return got

    def _keep(self, part: str, ids: bytes) -> None:
        """A full cache stays as it is: frequent parts come early. Long parts are not kept."""
        cost = 180 + len(part) + len(ids)
        if self.held + cost <= CACHE_BYTES and len(part) <= LONGEST:
            self.held += cost
            self.cache[part] = ids

    def _merged(self, letters: str, feed: bool) -> bytes:
        """Letters behind a blank or a line feed go to the library's merges directly: they are one part to it, with the blank."""
        raw = letters if letters.isascii() else letters.encode().decode("latin-1").translate(BYTE_CHARS)
        ids = array("I", [t.id for t in self.model.tokenize(raw if feed else "Ġ" + raw)]).tobytes()
        return self._marks("\n") + ids if feed else ids

    def parts(self, parts: list[str]) -> list[bytes]:
        """Ids of parts, each with the blank before it; one that begins with a line feed has none."""
        cache, keep = self.cache, self._keep
        out = list(map(cache.get, parts))
        lost = []
        for k, ids in enumerate(out):
            if ids is not None:
                continue
            p = parts[k]
            feed = p[0] == "\n"  # the empty part is always in the cache
            core = p.rstrip(MARKS)
            word = core[1:] if feed else core
            if not (word.isalpha() and (word.isascii() or LETTERS.fullmatch(word))):
                lost.append(k)
                continue
            if len(core) == len(p):
                ids = self._merged(word, feed)
            else:
                ids = cache.get(core)
                if ids is None:
                    ids = self._merged(word, feed)
                    keep(core, ids)
                ids += self._marks(p[len(core) :])
            keep(p, ids)
            out[k] = ids
        for k, ids in zip(lost, self._plain([parts[k] if parts[k][0] == "\n" else " " + parts[k] for k in lost])):
            out[k] = ids
            keep(parts[k], ids)
        return out

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text (null: none), without an end id."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        whole = np.flatnonzero(odd).tolist()
        for i, ids in zip(whole, self._plain(texts.take(pa.array(whole, pa.int64())).to_pylist())):
            out[i] = np.frombuffer(ids, "<u4")
        simple = np.flatnonzero(~odd)
        if not len(simple):
            return out
        split = pc.split_pattern(pc.replace_substring(texts.take(pa.array(simple)), "\n", " \n"), " ")
        borders = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        number = coded.indices.to_numpy().astype(np.int64)
        ids = self.parts(coded.dictionary.to_pylist())
        heads = split.flatten().take(pa.array(borders[:-1])).to_pylist()  # no blank before these
        number[borders[:-1]] = np.arange(len(ids), len(ids) + len(heads))
        at = [k for k, p in enumerate(heads) if p]
        first = [b""] * len(heads)
        for k, x in zip(at, self._plain([heads[k] for k in at])):
            first[k] = x
        ids += first
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        begin, wide = (np.cumsum(size) - size)[number], size[number]
        ends = np.cumsum(wide)
        got = flat[np.repeat(begin - (ends - wide), wide) + np.arange(ends[-1])]
        cuts = np.r_[0, ends][borders]
        for i, a, b in zip(simple.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
            out[i] = got[a:b]
        return out


def _literal(text: str) -> str:
    """A pattern for exactly this text."""
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in text)


def replace_pairs(seq: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): seq with frequent pairs replaced; rule k makes symbol base + k. END is never in a pair.

    Ends when no pair can be replaced so often that the bytes saved exceed those of its rule. As long
    as all symbols fit in 16 bits, a pair is one 32-bit number, which halves the work of counting.
    When these run out the replacement goes on with wider ones, and the smaller outcome stays.

    A count of a pair never grows unless one of its symbols is new. So once a round has taken all
    pairs that pay, the next one only counts pairs with a symbol that is newer than that round.
    """
    seq = seq.astype(np.uint32)
    rules = np.empty((0, 2), np.int64)
    kept = None
    fresh = 0  # pairs of older symbols only are known not to pay
    while len(seq) > 1:
        symbols = base + len(rules)
        room = (1 << 16) - symbols
        if kept is None and 0 <= base <= 1 << 16 and room <= 0:
            kept, fresh = (seq.copy(), rules), 0
        narrow = room > 0
        width = _width(symbols + 1)
        least = RULE // width + 1
        wide, shift = (np.uint32, 16) if narrow else (np.uint64, 32)
        low = wide((1 << shift) - 1)
        at = None
        if fresh:
            new = seq >= fresh
            at = np.flatnonzero(new[:-1] | new[1:])
            code = (seq[at].astype(wide) << wide(shift)) | seq[at + 1]
        else:
            code = (seq[:-1].astype(wide) << wide(shift)) | seq[1:]  # pairs with END are 0 in one half
        values, count = _counts(code, least)
        good = (values >> wide(shift) != END) & (values & low != END)
        values, count = values[good], count[good]
        twin = np.flatnonzero(values >> wide(shift) == values & low)
        if len(twin):
            count[twin] = _twin_counts(seq, symbols)[(values[twin] & low).astype(np.int64)]
        top = count.max(initial=0)
        if top < least:
            break
        floor = max(least, int(top * SHARE))
        good = np.flatnonzero(count >= floor)
        good = good[np.argsort(-count[good], kind="stable")]
        chosen = values[good[:room] if narrow else good]  # by rank
        place, rank, whole = _matches(code, chosen)
        if at is not None:
            place = at[place]
        every = place, rank
        while True:  # the first rank has all its matches, so that some rule remains
            take = _settle(place, rank)
            used = np.bincount(rank[take], minlength=len(chosen))
            live = used[rank] >= least
            if live.all():
                break
            place, rank = place[live], rank[live]
        live = np.flatnonzero(used)
        symbol = np.zeros(len(chosen), np.uint32)
        symbol[live] = symbols + np.arange(len(live))
        rules = np.concatenate([rules, np.stack([chosen[live] >> wide(shift), chosen[live] & low], axis=1).astype(np.int64)])
        keep = np.ones(len(seq) + 1, bool)
        keep[place[take] + 1] = False
        lost = len(rank) < len(every[1]) and _still_pays(*every, keep, used, least)
        seq[place[take]] = symbol[rank[take]]
        seq = seq[keep[:-1]]
        if floor == least and whole and len(chosen) == len(good) and not lost:
            fresh = symbols
    if kept is not None and _size(*kept, base) <= _size(seq, rules, base):
        seq, rules = kept
    return seq.astype(np.int64), rules


def _still_pays(place: np.ndarray, rank: np.ndarray, keep: np.ndarray, used: np.ndarray, least: int) -> bool:
    """Whether a pair without a rule has so many matches left that it may pay yet: what overlapped them was taken back as well."""
    free = (used[rank] == 0) & keep[place] & keep[place + 1] & keep[np.minimum(place + 2, len(keep) - 1)]
    return bool((np.bincount(rank[free]) >= least).any())


def _counts(code: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, counts) of the codes that occur ``least`` times or more, in order."""
    ordered = np.sort(code)
    if len(ordered) < least:
        return ordered[:0], np.empty(0, np.int64)
    often = np.flatnonzero(ordered[least - 1 :] == ordered[: len(ordered) - least + 1])  # starts of such runs, and places inside them
    values = ordered[often]
    first = np.flatnonzero(np.r_[len(values) > 0, values[1:] != values[:-1]])
    return values[first], np.diff(first, append=len(values)) + (least - 1)


def _twin_counts(seq: np.ndarray, symbols: int) -> np.ndarray:
    """Per symbol, how many pairs of it beside itself can be replaced: a run of n places overlaps itself."""
    place = np.flatnonzero(seq[1:] == seq[:-1])
    first = np.flatnonzero(np.r_[True, place[1:] - place[:-1] != 1]) if len(place) else place
    size = np.diff(first, append=len(place))
    return np.bincount(seq[place[first]], (size + 1) // 2, symbols).astype(np.int64)


def _width(symbols: int) -> int:
    """Bytes of a symbol, of so many different ones."""
    return 2 if symbols <= 1 << 16 else 3 if symbols <= 1 << 24 else 4


def _size(seq: np.ndarray, rules: np.ndarray, base: int) -> int:
    return RULE * len(rules) + _width(base + len(rules)) * len(seq)


def _matches(code: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """(places, ranks) of the chosen pairs in code by a table of slots, and whether it has them all: of two pairs in a slot the first stays."""
    bits = 18
    kind = code.dtype.type
    factor, shift = (2654435761, 32 - bits) if kind is np.uint32 else (0x9E3779B97F4A7C15, 64 - bits)
    mix = lambda x: (x * kind(factor)) >> kind(shift)
    table = np.full(1 << bits, -1, np.int32)
    slots = mix(chosen)
    table[slots[::-1]] = np.arange(len(chosen), dtype=np.int32)[::-1]
    whole = bool((table[slots] == np.arange(len(chosen))).all())
    rank = table[mix(code)]
    place = np.flatnonzero(rank >= 0)
    rank = rank[place]
    same = chosen[rank] == code[place]
    return place[same], rank[same], whole


def _settle(place: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the matches are replaced: no two overlap, and of neighbours the lower rank goes first.

    A match is left out only if it overlaps one that is replaced. In a run of one pair (a symbol
    repeated) every second match from the run's first free one is meant.
    """
    good = np.zeros(len(place), bool)
    left = np.arange(len(place))
    while len(left):
        p, r = place[left], rank[left]
        near = p[1:] - p[:-1] == 1  # match k and k + 1 overlap
        same = near & (r[1:] == r[:-1])
        start = np.flatnonzero(np.concatenate([[True], ~same]))
        size = np.diff(start, append=len(left))
        waits = np.concatenate([[False], near & (r[1:] > r[:-1])])  # for the match before
        pick = np.repeat(~waits[start], size) & ((np.arange(len(left)) - np.repeat(start, size)) % 2 == 0)
        pick[:-1] &= ~(near & (r[1:] < r[:-1]))
        good[left[pick]] = True
        gone = pick.copy()
        gone[1:] |= near & pick[:-1]
        gone[:-1] |= near & pick[1:]
        left = left[~gone]
    return np.flatnonzero(good)


def rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Tokens that each rule expands to."""
    out = np.ones(len(rules), np.int64)
    done = 0
    while done < len(rules):  # the rules of a round refer to earlier rounds only
        width = lambda s: np.where(s < base, 1, out[np.maximum(s - base, 0)])
        ready = done + int(np.argmax(np.r_[(rules[done:] >= base + done).any(axis=1), True]))
        out[done:ready] = width(rules[done:ready, 0]) + width(rules[done:ready, 1])
        done = ready
    return out


def pack(ids: np.ndarray, tokens_per_doc: np.ndarray) -> bytes:
    """A shard of documents that each close with END."""
    used = np.zeros(int(ids.max(initial=0)) + 1, bool)
    used[END] = True  # END is the least id and so stays symbol 0
    used[ids] = True
    own = np.flatnonzero(used)
    base = len(own)
    number = np.zeros(len(used), np.uint32)
    number[own] = np.arange(base)
    symbols, rules = replace_pairs(number[ids], base)
    lengths = rule_lengths(rules, base)
    ends = np.flatnonzero(symbols == END)
    if len(ends) != len(tokens_per_doc):  # END is also an ordinary id of the vocabulary: find the borders by length
        ends = np.searchsorted(np.cumsum(np.r_[np.ones(base, np.int64), lengths][symbols]), np.cumsum(tokens_per_doc))
    per_doc = np.diff(np.r_[-1, ends])
    width = _width(base + len(rules))
    head = np.array([MAGIC, base, len(rules), len(symbols), len(per_doc), len(ids), width, 0], "<u4")
    body = symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]
    return b"".join([*(x.astype("<u4").tobytes() for x in (head, own, rules, lengths, per_doc)), np.ascontiguousarray(body).tobytes()])


class Shard:
    """A packed shard: documents and tokens by place."""

    def __init__(self, raw: bytes):
        head = np.frombuffer(raw, "<u4", 8).astype(np.int64)
        if head[0] != MAGIC:
            raise ValueError("not a shard")
        _, self.base, n_rules, n_symbols, self.docs, self.tokens, width, _ = head.tolist()
        at = 32
        self.own = np.frombuffer(raw, "<u4", self.base, at).astype(np.int64)
        at += 4 * self.base
        self.rules = np.frombuffer(raw, "<u4", 2 * n_rules, at).reshape(-1, 2).astype(np.int64)
        at += 8 * n_rules
        self.lengths = np.frombuffer(raw, "<u4", n_rules, at).astype(np.int64)
        at += 4 * n_rules
        self.per_doc = np.frombuffer(raw, "<u4", self.docs, at).astype(np.int64)
        at += 4 * self.docs
        body = np.zeros((n_symbols, 4), np.uint8)
        body[:, :width] = np.frombuffer(raw, np.uint8, n_symbols * width, at).reshape(-1, width)
        self.symbols = body.view("<u4")[:, 0].astype(np.int64)
        self.borders = np.r_[0, np.cumsum(self.per_doc)]
        self._flat: np.ndarray | None = None

    def _width(self, s: np.ndarray) -> np.ndarray:
        return np.where(s < self.base, 1, self.lengths[np.maximum(s - self.base, 0)]) if len(self.lengths) else np.ones(len(s), np.int64)

    def _expanded(self) -> tuple[np.ndarray, np.ndarray]:
        """All rules written out one after another, and where each starts."""
        if self._flat is None:
            start = np.r_[0, np.cumsum(self.lengths)]
            flat = np.empty(int(start[-1]), np.int64)
            done = 0
            while done < len(self.rules):
                ready = done + int(np.argmax(np.r_[(self.rules[done:] >= self.base + done).any(axis=1), True]))
                flat[start[done] : start[ready]] = self._expand(self.rules[done:ready].ravel(), flat, start)
                done = ready
            self._flat, self._start = flat, start
        return self._flat, self._start

    def _expand(self, s: np.ndarray, flat: np.ndarray, start: np.ndarray) -> np.ndarray:
        width = self._width(s)
        total = int(width.sum())
        within = np.arange(total) - np.repeat(np.cumsum(width) - width, width)
        rule = np.repeat(s >= self.base, width)
        out = np.repeat(s, width)
        if rule.any():
            out[rule] = flat[np.repeat(start[np.maximum(s - self.base, 0)], width)[rule] + within[rule]]
        return out

    def ids(self) -> np.ndarray:
        """All ids of the shard."""
        return self.own[self._expand(self.symbols, *self._expanded())]

    def doc(self, k: int) -> np.ndarray:
        """The ids of one document, its end id included; only its symbols are expanded."""
        return self.own[self._expand(self.symbols[self.borders[k] : self.borders[k + 1]], *self._expanded())]

    def token(self, k: int, place: int) -> int:
        """One id of document k: lengths are added up to its symbol, which is then walked down."""
        s = self.symbols[self.borders[k] : self.borders[k + 1]]
        ends = np.cumsum(self._width(s))
        i = int(np.searchsorted(ends, place, side="right"))
        symbol, place = int(s[i]), place - int(ends[i - 1] if i else 0)
        while symbol >= self.base:
            left, right = self.rules[symbol - self.base].tolist()
            wide = int(self._width(np.array([left]))[0])
            symbol, place = (left, place) if place < wide else (right, place - wide)
        return int(self.own[symbol])

    def doc_tokens(self) -> np.ndarray:
        """Tokens of each document, from the lengths alone."""
        total = np.r_[0, np.cumsum(self._width(self.symbols))]
        return np.diff(total[self.borders])


def write(docs: DataFrame, tokenizer: str, path: str, doc_id: str = "doc_id", text: str = "text", parts: int | None = None, shard: int = SHARD, special_as_text: bool = False) -> None:
    """Write docs as shards to ``path``, ordered by doc_id over all parts.

    The table has a row per shard: part, seq (of the shard in its part), start (tokens of the part
    before it), tokens, first_doc, doc_ids (array) and data. A null text counts as empty, a null id
    comes first; rows of equal id are ordered by their text. A shard ends with the document that
    takes it to ``shard`` tokens or more, so a document is never split.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer, encoding="utf-8") as f:
        data = f.read()
    key = (hash(data), special_as_text)
    shared = spark.sparkContext.broadcast(data)
    n = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    src = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    ordered = src.repartitionByRange(n, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    schema = "part int, seq int, start long, tokens long, first_doc long, doc_ids array<long>, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        e = _held.get(key)
        if e is None:
            _held.clear()
            e = _held[key] = Encoder(shared.value, special_as_text)
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        names: list = []
        sizes: list[int] = []
        end = np.array([END], "<u4")

        def made() -> pa.RecordBatch:
            nonlocal seq, start
            flat = np.concatenate(ids)
            row = [[part], [seq], [start], [len(flat)], [names[0]], [list(names)], [pack(flat, np.array(sizes, np.int64))]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            seq, start = seq + 1, start + len(flat)
            for x in (ids, names, sizes):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["part", "seq", "start", "tokens", "first_doc", "doc_ids", "data"])

        held = 0
        for b in gathered(batches, 1, SLICE):
            for name, own in zip(b.column(0).to_pylist(), e.batch(b.column(1))):
                ids += (own, end)
                names.append(name)
                sizes.append(len(own) + 1)
                held += sizes[-1]
                if held >= shard:
                    yield made()
                    held = 0
        if names:
            yield made()

    ordered.mapInArrow(run, schema).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the shards at ``path``.

    start counts the ids of all documents before it. Totals per part, of which there are as many
    as the writer had tasks, are added up on the driver.
    """
    table = spark.read.parquet(path)
    totals = table.groupBy("part").agg(F.sum("tokens").alias("tokens")).orderBy("part").collect()
    before, at = {}, 0
    for part, tokens in totals:
        before[part] = at
        at += tokens
    ship(spark)
    shared = spark.sparkContext.broadcast(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, start, names, raw in zip(*(b.column(k).to_pylist() for k in range(4))):
                s = Shard(raw)
                ids = s.ids().astype("<u4")
                ends = np.cumsum(s.doc_tokens())
                begins = np.r_[0, ends[:-1]]
                crc = [zlib.crc32(ids[x:y].data) for x, y in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(begins + start + shared.value[part]), pa.array(ends - begins), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return table.select("part", "start", "doc_ids", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """write() to the shared folder, then read()."""
    spark = docs.sparkSession
    path = Scratch(spark).path("tokens")
    write(docs, tokenizer, path, doc_id, text)
    return read(spark, path)
