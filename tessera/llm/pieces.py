"""The piece vocabulary of a SentencePiece model file.

Read as a unigram model, a piece's score is its log weight and encoding is the segmentation of the
greatest total score. Ties are settled as SentencePiece's unigram encoder settles them: at each end
position the piece that starts first wins, which is the longest. Sums are kept in 64-bit floats
(exact for whole-number scores), so long texts do not meet the rounding of 32-bit sums.

Read as a merge (BPE) model, of which kind the file says it is, neighbours whose union is a piece are
merged, the union of the greatest score first and the leftmost of equals.

Normalisation is that of the file: its map of characters, white space that is removed, an optional
leading blank, blanks as U+2581. See Normaliser.
"""

from __future__ import annotations

import re
from array import array

#: U+2581, which stands for a blank.
BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: An unknown character scores this much less than the least piece.
PENALTY = 10.0


class Normaliser:
    """The normaliser of a model file as a transducer: at each place the longest source of the map is read and its target written.

    A file keeps its map as a double array: units of 32 bits, which hold a label, whether a source
    ends there, and the offset to what follows. Sources are walked byte by byte. Composed with a text
    the transducer has one path, so its output is a text again.
    """

    def __init__(self, spec):
        self.dummy_prefix, self.escape, self.squeeze = spec.add_dummy_prefix, spec.escape_whitespaces, spec.remove_extra_whitespaces
        raw = bytes(spec.precompiled_charsmap)
        self.units: array = array("I")
        self.targets = b""
        if raw:
            size = int.from_bytes(raw[:4], "little")
            self.units.frombytes(raw[4 : 4 + size])
            self.targets = raw[4 + size :]
        self.known: dict[str, str] = {}

    def step(self, raw: bytes, at: int) -> tuple[int, str | None]:
        """(bytes read, target) of the longest source that begins at ``at``; (0, None) if there is none."""
        units = self.units
        unit = units[0]
        node = (unit >> 10) << ((unit & (1 << 9)) >> 6)
        found = (0, None)
        for k in range(at, len(raw)):
            node ^= raw[k]
            unit = units[node]
            if unit & ((1 << 31) | 0xFF) != raw[k]:
                break
            node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
            if unit >> 8 & 1:
                begin = units[node] & ((1 << 31) - 1)
                found = (k + 1 - at, self.targets[begin : self.targets.index(b"\0", begin)].decode())
        return found

    def mapped(self, text: str) -> str:
        """The text after the map of characters."""
        if not self.units:
            return text
        raw, out, at = text.encode("utf-8", "surrogatepass"), [], 0
        while at < len(raw):
            n, target = self.step(raw, at)
            if not n:
                lead = raw[at]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                target = raw[at : at + n].decode("utf-8", "surrogatepass")
            out.append(target)
            at += n
        return "".join(out)

    def __call__(self, text: str) -> str:
        """The text as pieces see it; what has nothing left has no leading blank."""
        t = self.mapped(text)
        if self.squeeze:
            t = re.sub(" +", " ", t).strip(" ")
        if not t:
            return ""
        t = (" " if self.dummy_prefix else "") + t
        return t.replace(" ", BLANK) if self.escape else t


class Pieces:
    """Pieces, scores and byte ids of a model file; loads in any worker that can read ``data``."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(data)
        self.normalised = Normaliser(m.normalizer_spec)
        if not m.normalizer_spec.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that write blanks as U+2581, before words, are supported")
        if any(p.type == USER for p in m.pieces) and m.normalizer_spec.precompiled_charsmap:
            raise ValueError("a model with symbols that its map must not touch is not supported")
        self.dummy_prefix = m.normalizer_spec.add_dummy_prefix
        self.names = [p.piece for p in m.pieces]
        self.types = [p.type for p in m.pieces]
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        self.unknown = 0
        for i, p in enumerate(m.pieces):
            if p.type == NORMAL or p.type == USER:
                self.score[p.piece], self.id[p.piece] = p.score, i
            elif p.type == BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
            elif p.type == UNKNOWN:
                self.unknown = i
        if m.trainer_spec.byte_fallback and len(self.bytes) != 256:
            raise ValueError("byte fallback needs all 256 bytes")
        self.fallback = bool(m.trainer_spec.byte_fallback)
        self.merges = m.trainer_spec.model_type == pb.TrainerSpec.BPE
        self.unknown_score = min(self.score.values()) - PENALTY
        self.longest = max(map(len, self.score))
        if any(BLANK in p.lstrip(BLANK) for p in self.score):
            raise ValueError("a piece joins two words: chunks would not be independent")

    def merged(self, text: str) -> list[str]:
        """The merge encoding of a short text, by carrying out the merges."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts


#: A chunk is a run of blanks with what follows up to the next blank: no piece has a blank after another character, so no piece crosses into a chunk.
CHUNK = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")


def chunks(normalised: str) -> list[str]:
    """Parts that can be segmented one by one: every piece of the whole lies in one of them."""
    if BLANK + BLANK in normalised:
        return CHUNK.findall(normalised)
    parts = normalised.split(BLANK)
    return parts[:1] * bool(parts[0]) + [BLANK + p for p in parts[1:]]
