"""Chat formatting by incremental black-box rendering.

A template is any function from a list of messages (and whether to open the assistant's turn) to a
text. Nothing is known of its inside: the turns of a conversation are rendered as prefixes of growing
length and consecutive outputs are compared. Where an output begins with the one before it, what was
added is the span of the new turn; where it does not, the template rewrote history, which is reported
and leaves that conversation without spans. Inside a turn's span the text is located the same way: the
opening that the template writes for the assistant, and the closing that is left when the turn is
rendered with an empty text, enclose it.

Every prefix is rendered, whatever the length: a template may do otherwise at any turn, so fewer
renderings could not tell. That costs the square of a conversation's length, of which the built-in
template keeps the larger part low by holding on to the turns it has just written.

The built-in template marks turns with control strings and escapes them, and other templates' control
strings, inside texts and roles, so that texts can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import ship

OPEN, CLOSE, GAP = "<|turn|>", "<|end|>\n", "\n"
#: Strings that a text must not hold as they are: this template's and common ones of others.
CONTROL = (OPEN, "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Marks escapes: it is put after the first character of a control string, and doubled where it stands in a text.
ESCAPE = "\\"
#: Turns that the built-in template holds on to, and characters of the longest of them.
HELD, LONGEST = 4096, 4096
_CONTROL = re.compile("|".join(re.escape(ESCAPE) if c is None else re.escape(c) for c in (None, *sorted(CONTROL, key=len, reverse=True))))
_ESCAPED = re.compile("|".join([re.escape(ESCAPE + ESCAPE), *(re.escape(c[0] + ESCAPE + c[1:]) for c in sorted(CONTROL, key=len, reverse=True))]))
_TURN = re.compile(re.escape(OPEN) + "(.*?)" + GAP + "(.*?)" + re.escape(CLOSE), re.S)

Message = tuple[str, str]
Template = Callable[[list[Message], bool], str]


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: ESCAPE + ESCAPE if m[0] == ESCAPE else m[0][0] + ESCAPE + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: ESCAPE if m[0] == ESCAPE + ESCAPE else m[0].replace(ESCAPE, "", 1), text)


def _role(role: str) -> str:
    """A role as one line."""
    return escape(role).replace("\n", ESCAPE + "n")


def _role_back(role: str) -> str:
    out, at = [], 0
    for m in re.finditer(re.escape(ESCAPE) + "n|" + _ESCAPED.pattern, role):
        out += [role[at : m.start()], "\n" if m[0] == ESCAPE + "n" else unescape(m[0])]
        at = m.end()
    return "".join(out) + role[at:]


def _turn(role: str, text: str) -> str:
    return f"{OPEN}{_role(role)}{GAP}{escape(text)}{CLOSE}"


_held_turn = lru_cache(HELD)(_turn)


def turns_template(messages: list[Message], open_assistant: bool = False) -> str:
    """The built-in template."""
    out = [_held_turn(r, t) if len(t) + len(r) <= LONGEST else _turn(r, t) for r, t in messages]
    if open_assistant:
        out.append(f"{OPEN}assistant{GAP}")
    return "".join(out)


def parse(formatted: str) -> list[Message]:
    """The messages of a text that turns_template made."""
    return [(_role_back(r), unescape(t)) for r, t in _TURN.findall(formatted)]


class Rendered:
    """A conversation's text with the spans of its turns and of the texts under the loss."""

    def __init__(self, messages: list[Message], template: Template = turns_template, learn: frozenset[str] = frozenset({"assistant"})):
        self.turns: list[tuple[int, int]] = []
        self.loss: list[tuple[int, int]] = []
        self.rewrites = False
        self.text = template(messages, False)
        added = self._prefixes(messages, template)
        if added is None:
            self.rewrites = True
            return
        at = 0
        for k, part in enumerate(added):
            self.turns.append((at, at + len(part)))
            if messages[k][0] in learn:
                span = self._inside(messages, k, part, template)
                if span is None:
                    self.rewrites, self.loss = True, []
                    return
                self.loss.append((at + span[0], at + span[1]))
            at += len(part)

    @staticmethod
    def _step(before: str, after: str) -> str | None:
        return after[len(before) :] if after.startswith(before) else None

    def _prefixes(self, messages: list[Message], template: Template) -> list[str] | None:
        """What each turn adds, from the renderings of all prefixes; None if one rewrites another."""
        out, before = [], template([], False)
        if before:
            return None
        for k in range(len(messages)):
            after = template(messages[: k + 1], False)
            part = self._step(before, after)
            if part is None:
                return None
            out.append(part)
            before = after
        return out

    @staticmethod
    def _inside(messages: list[Message], k: int, part: str, template: Template) -> tuple[int, int] | None:
        """Where the text lies in what turn k adds."""
        context = messages[:k]
        before = template(context, False)
        opened = template(context, True)
        empty = Rendered._step(before, template([*context, (messages[k][0], "")], False))
        if empty is None or not opened.startswith(before):
            return None
        head = opened[len(before) :]
        if not part.startswith(head) or not empty.startswith(head):
            return None
        tail = empty[len(head) :]
        return (len(head), len(part) - len(tail)) if part.endswith(tail) else None


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: Template = turns_template) -> DataFrame:
    """(conv_id, n_turns, formatted, turn_spans, loss_spans, rewrites) per conversation.

    Spans are arrays start, end, start, ... of code points of ``formatted``; those under the loss
    are the assistant's texts. Null roles and texts count as empty. Rows of a conversation are ordered by
    turn (null first), then role and text, so that ties and repeated rows have one order; repeated
    rows are turns of their own. Rows without a conv_id make up one conversation.

    Rows are dealt by conversation and sorted; a worker holds one conversation at a time.
    """
    spark = turns.sparkSession
    ship(spark)
    src = turns.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = src.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    spans = F.array().cast("array<long>")
    schema = src.select("conv_id", F.lit(0).cast("long").alias("n_turns"), F.lit("").alias("formatted"), spans.alias("turn_spans"), spans.alias("loss_spans"), F.lit(True).alias("rewrites")).schema
    width = 256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        kind = None

        def one(name, messages) -> None:
            r = Rendered(messages, template)
            rows.append((name, len(messages), r.text, [x for s in r.turns for x in s], [x for s in r.loss for x in s], r.rewrites))

        def made() -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_()]
            b = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], schema.names)
            rows.clear()
            return b

        name, messages = None, []
        for b in batches:
            kind = b.schema.field(0).type
            for c, r, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if messages and c != name:
                    one(name, messages)
                    messages = []
                    if len(rows) >= width:
                        yield made()
                name = c
                messages.append((r, t))
        if messages:
            one(name, messages)
        if rows:
            yield made()

    return dealt.mapInArrow(run, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrites), read back from format_chats().

    Turns are parsed from the formatted text, the texts under the loss are cut out by their spans.
    """
    zero = F.lit(0).cast("long")
    src = formatted.select("conv_id", "formatted", "loss_spans", "rewrites")
    schema = src.select("conv_id", zero.alias("n_turns"), F.lit("").alias("turns_sha256"), zero.alias("loss_chars"), F.lit("").alias("loss_sha256"), zero.alias("formatted_chars"), F.lit(True).alias("rewrites")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for text, loss in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                messages = parse(text)
                learned = "".join(unescape(text[x:y]) for x, y in zip(loss[::2], loss[1::2]))
                sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
                for o, v in zip(out, (len(messages), sha("".join(f"{r}\n{t}\n" for r, t in messages)), len(learned), sha(learned), len(text))):
                    o.append(v)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(v, k) for v, k in zip(out, kinds)], b.column(3)], schema.names)

    return src.mapInArrow(run, schema)


def _sql_escape(x: str) -> str:
    out = f"replace({x}, '{ESCAPE}', '{ESCAPE}{ESCAPE}')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}{ESCAPE}{c[1:]}')"
    return out


SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(OPEN) + len(GAP) + len(CLOSE)} + length({_sql_escape("role")}) + length({_sql_escape("text")}))::BIGINT AS formatted_chars, false AS rewrites
FROM t GROUP BY conv_id
"""
