"""Chat formatting by token-level assembly.

A turn is ``<open of its role> text <close>``. Each text is encoded on its own;
the marks are not encoded but spliced as reserved ids above the vocabulary, so
no text can produce one. Strings of marks that occur in a text are escaped all
the same, so that the plain rendering is unambiguous too: the escape character
is put after a mark's first character, and escape characters in the text are
doubled. Runs of escape characters are then even, or one that was put there, so
the text can be read back.

A loss mask is the prefix sum of +1 where a learnt text begins and -1 where it
ends. Output comes turn by turn with its token offset in the conversation (a
running sum), so a conversation of any length streams through in bounded
memory; rows are dealt by conversation and sorted by turn.

Edge cases: null text and role are empty; null turns come first and ties are
ordered by role, then text; a null conversation id is a conversation of its
own; repeated rows are turns of their own; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import text_column

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to this vocabulary: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ESCAPE = "␛"
#: What opens and closes a turn of each role; other roles are named in the text after OTHER.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("<|role|>", "<|/role|>", "<|end|>")
CONTROLS = [m.strip() for pair in MARKS.values() for m in pair] + [*OTHER]
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))
_ESCAPED = re.compile(f"{ESCAPE}+")


def escape(text: str) -> str:
    doubled = text.replace(ESCAPE, ESCAPE * 2)
    return _CONTROL.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], doubled)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][: len(m[0]) // 2], text)


class Template:
    """Encodes with a public byte-level vocabulary; reserved ids lie above it."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.codec = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.first = max(ranks.values()) + 2
        names = [m for pair in MARKS.values() for m in pair] + [*OTHER]
        self.mark = {m: self.first + n for n, m in enumerate(names)}
        self.name = {n: m for m, n in self.mark.items()}

    def turn(self, role: str, text: str, learn: bool) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of a turn and its loss mask."""
        body = self.codec.encode_ordinary(escape(text))
        if role in MARKS:
            head, tail = [self.mark[MARKS[role][0]]], [self.mark[MARKS[role][1]]]
        else:
            head, tail = [self.mark[OTHER[0]], *self.codec.encode_ordinary(escape(role)), self.mark[OTHER[1]]], [self.mark[OTHER[2]]]
        ids = np.array(head + body + tail, dtype=np.int32)
        step = np.zeros(len(ids) + 1, dtype=np.int8)
        if learn:
            step[len(head)] += 1
            step[len(head) + len(body)] -= 1
        return ids, np.cumsum(step[:-1]).astype(bool)

    def rendered(self, ids: np.ndarray) -> str:
        """Marks and texts as one string."""
        return "".join(self.name[p[0]] if p[0] >= self.first else self.text(p) for p in self._parts(ids))

    def text(self, ids: np.ndarray) -> str:
        return self.codec.decode_bytes(ids.tolist()).decode() if len(ids) else ""

    def _parts(self, ids: np.ndarray):
        marks = np.flatnonzero(ids >= self.first)
        edges = np.unique(np.concatenate([[0], marks, marks + 1, [len(ids)]]))
        return [ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def read(self, ids: np.ndarray) -> tuple[str, str]:
        """Role and text of an assembled turn."""
        opened = self.name[int(ids[0])]
        for role, (start, _) in MARKS.items():
            if start == opened:
                return role, unescape(self.text(ids[1:-1]))
        end = int(np.flatnonzero(ids == self.mark[OTHER[1]])[0])
        return unescape(self.text(ids[1:end])), unescape(self.text(ids[end + 1 : -1]))


_templates: dict[str, Template] = {}


def template(path: str) -> Template:
    if path not in _templates:
        _templates[path] = Template(path)
    return _templates[path]


def format_chats(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", tokenizer: str = TOKENIZER, learn_role: str = "assistant") -> DataFrame:
    """One row per turn, in order within each partition: ``conv_id, place, offset, ids, mask``."""
    rows = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), text_column(role).alias("role"), text_column(text).alias("text"))
    kind = rows.schema["conv_id"].dataType.simpleString()

    def assemble(batches):
        chat, at, place, offset = template(tokenizer), object(), 0, 0
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for conv, r, t in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if conv != at:
                    at, place, offset = conv, 0, 0
                ids, mask = chat.turn(r, t, r == learn_role)
                for pile, value in zip(out, (place, offset, ids, mask), strict=True):
                    pile.append(value)
                place, offset = place + 1, offset + len(ids)
            types = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(v, k) for v, k in zip(out, types, strict=True))], ["conv_id", "place", "offset", "ids", "mask"])

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(assemble, f"conv_id {kind}, place long, offset long, ids array<int>, mask array<boolean>")


def digests(formatted: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """What is read back from :func:`format_chats`, one row per conversation.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
    n_tokens, n_loss_tokens``. Turns stream in order, so no conversation is held
    in memory; the input must be in the order that :func:`format_chats` gives.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_loss_tokens"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def read(batches):
        chat, at, state = template(tokenizer), None, None
        id_type = None

        def done(rows):
            out = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(list(out[0]), id_type), *(pa.array(list(c), t) for c, t in zip(out[1:], types, strict=True))], names)

        def row():
            turns, loss, chars = state[0], state[1], state[2]
            return (at, chars[0], turns.hexdigest(), chars[1], loss.hexdigest(), chars[2], chars[3], chars[4])

        for batch in batches:
            id_type, rows = batch.column("conv_id").type, []
            for conv, place, ids, mask in zip(batch.column("conv_id").to_pylist(), batch.column("place").to_pylist(), _lists(batch.column("ids")), _lists(batch.column("mask")), strict=True):
                if place == 0:
                    if state is not None:
                        rows.append(row())
                    at, state = conv, (hashlib.sha256(), hashlib.sha256(), [0, 0, 0, 0, 0])
                role, text = chat.read(ids)
                state[0].update(f"{role}\n{text}\n".encode())
                learnt = unescape(chat.text(ids[mask]))
                state[1].update(learnt.encode())
                for n, more in enumerate((1, len(learnt), len(chat.rendered(ids)), len(ids), int(mask.sum()))):
                    state[2][n] += more
            yield done(rows)
        if state is not None:
            yield done([row()])

    return formatted.mapInArrow(read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long")


def _lists(column: pa.Array):
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        yield values[a:b]
