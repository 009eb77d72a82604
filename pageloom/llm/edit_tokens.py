"""Token counts that follow edits.

A text is cut into *segments* at places where the splitting pattern of the
vocabulary cuts in any case: before a single space that stands between two
characters that are no white space. Tokens never cross such a place, so the
counts of segments add up to the count of the text, and a segment's count
depends on nothing outside it. Segments have about ``LEAF`` characters.

Each document keeps its segments' lengths and token counts in a sum tree (a
binary tree laid out in an array, some of whose leaves are empty). An edit finds
the segments it touches by descending the length sums, takes one segment more on
each side as boundary context, cuts that stretch anew and encodes only it. The
new segments take the leaves of the old ones; if they are more, the smallest
subtree that has room is spread out evenly, and only it and the sums above it are
changed (log squared of the leaves for each added segment, on average). A tree
without room gets twice the leaves.

Edge cases: a null text is empty; an edit beyond the end is moved to the end; a
null replacement is empty; edits are applied in order of ``seq``, each to the
text that the one before left; documents without edits keep their counts; an
edit of an unknown document has no effect; edits with equal ``seq`` are ordered by
their places; repeated rows are counted alike; a very long text is held whole, with
its tree; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.chat import TOKENIZER, template
from pageloom.llm.common import text_column

LEAF = 128
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def segments(text: str, leaf: int = LEAF) -> list[str]:
    """Pieces that begin at safe places, about ``leaf`` characters or more each."""
    out, at = [], 0
    while at < len(text):
        found = _SAFE.search(text, at + leaf) if at + leaf < len(text) else None
        to = found.start() if found else len(text)
        out.append(text[at:to])
        at = to
    return out


class SumTree:
    """Sums of length, tokens and occupied leaves; node ``i`` has the children ``2i`` and ``2i + 1``."""

    def __init__(self, lengths: list[int], tokens: list[int]):
        self.width = 1 << max(0, len(lengths) - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 3), dtype=np.int64)
        self.put(0, lengths, tokens, [1] * len(lengths))
        self.above(0, self.width)

    @property
    def length(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def put(self, at: int, *columns) -> None:
        to = self.width + at + len(columns[0])
        for i, c in enumerate(columns):
            self.sums[self.width + at : to, i] = c

    def above(self, lo: int, hi: int) -> None:
        """Sum up anew over the leaves from ``lo`` to ``hi``."""
        left, right = self.width + lo, self.width + hi - 1
        while left > 1:
            left, right = left // 2, right // 2
            pairs = self.sums[2 * left : 2 * right + 2]
            self.sums[left : right + 1] = pairs[::2] + pairs[1::2]

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds ``place`` (beyond the end: the last) and the length before it."""
        place, i, before = min(place, self.length - 1), 1, 0
        while i < self.width:
            i *= 2
            if place - before >= self.sums[i, 0]:
                before += int(self.sums[i, 0])
                i += 1
        return i - self.width, before

    def used(self, lo: int, hi: int) -> int:
        """Occupied leaves from ``lo`` to ``hi``."""
        return int(self.sums[self.width + lo : self.width + hi, 2].sum())


class CountedText:
    """A text with its segments and their sum tree; an empty leaf has no segment."""

    def __init__(self, text: str, count, leaf: int = LEAF):
        self.count, self.leaf, self.encoded, self.moved = count, leaf, 0, 0
        parts = segments(text, leaf)
        self.tree = SumTree([len(p) for p in parts], self._counts(parts))
        self.parts = parts + [""] * (self.tree.width - len(parts))

    def _counts(self, parts: list[str]) -> list[int]:
        self.encoded += sum(map(len, parts))
        return self.count(parts)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters from ``start`` to ``end``."""
        size = self.tree.length
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        if not size:
            self._replace(0, 0, new)
            return
        first, before = self.tree.find(start)
        last, last_before = self.tree.find(max(start, end - 1))
        after = last_before + len(self.parts[last])
        lo = self.tree.find(before - 1)[0] if before else first
        hi = (self.tree.find(after)[0] if after < size else last) + 1
        touched = "".join(self.parts[lo:first]) + self.parts[first][: start - before] + new + self.parts[last][end - last_before :] + "".join(self.parts[last + 1 : hi])
        self._replace(lo, hi, touched)

    def _replace(self, lo: int, hi: int, text: str) -> None:
        """Segments of ``text`` instead of the leaves from ``lo`` to ``hi``."""
        new = segments(text, self.leaf)
        counts, tree = self._counts(new), self.tree
        size, levels, more = 1, max(1, tree.width.bit_length() - 1), len(new) - tree.used(lo, hi)

        def room() -> bool:
            base, most = lo // size * size, size * (1 - min(levels, size.bit_length() - 1) / levels / 2)  # the larger a subtree, the emptier it must be
            return hi <= base + size and tree.used(base, min(tree.width, base + size)) + more <= most

        while len(new) > hi - lo and not room():
            size *= 2
        base = lo // size * size
        to = min(tree.width, base + size)
        if len(new) <= hi - lo:
            base, to, size = lo, hi, hi - lo
            entries = [(p, len(p), c) for p, c in zip(new, counts, strict=True)]
            slots = list(range(len(new)))
        else:
            old = lambda a, b: [(self.parts[i], *tree.sums[tree.width + i, :2].tolist()) for i in range(a, b) if tree.sums[tree.width + i, 2]]
            entries = old(base, lo) + [(p, len(p), c) for p, c in zip(new, counts, strict=True)] + old(hi, to)
            slots = [i * size // len(entries) for i in range(len(entries))]
        self.moved += len(entries)
        if size > tree.width:  # no room: more leaves
            self.tree = tree = SumTree([], [])
            tree.width, tree.sums, self.parts = size, np.zeros((2 * size, 3), dtype=np.int64), [""] * size
            to = size
        columns = np.zeros((3, to - base), dtype=np.int64)
        placed = [""] * (to - base)
        for slot, (p, n, c) in zip(slots, entries, strict=True):
            placed[slot] = p
            columns[:, slot] = n, c, 1
        self.parts[base:to] = placed
        tree.put(base, *columns)
        if to > base:
            tree.above(base, to)

    @property
    def text(self) -> str:
        return "".join(self.parts)


def counter(tokenizer: str = TOKENIZER):
    """Counts of tokens for a list of segments."""
    encode = template(tokenizer).codec.encode_ordinary
    return lambda parts: [len(encode(p)) for p in parts]


def count_with_edits(docs: DataFrame, edits: str = "edits", doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, leaf: int = LEAF) -> DataFrame:
    """Count every whole text, apply its edits, and count again by the touched regions.

    ``edits`` names a column of arrays of ``(start, end, new)`` in order (see
    :func:`with_edits`). ``doc_id, n_chars, n_tokens, n_edits, edited_chars,
    edited_tokens, reencoded_chars, n_segments, edited_sha256``; no shuffle.
    """
    import hashlib

    docs = docs.select(F.col(doc_id).alias("doc_id"), text_column(text).alias("text"), F.col(edits).alias("edits"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["n_chars", "n_tokens", "n_edits", "edited_chars", "edited_tokens", "reencoded_chars", "n_segments"]

    def run(batches):
        count = counter(tokenizer)
        for batch in batches:
            out: list[list[int]] = [[] for _ in names]
            digest = []
            for body, changes in zip(batch.column("text"), batch.column("edits"), strict=True):
                tree = CountedText(body.as_py(), count, leaf)
                row = [tree.tree.length, tree.tree.tokens]
                before = tree.encoded
                steps = changes.as_py() or []
                for s in steps:
                    tree.edit(s["start"] or 0, s["end"] or 0, s["new"] or "")
                row += [len(steps), tree.tree.length, tree.tree.tokens, tree.encoded - before, tree.tree.used(0, tree.tree.width)]
                digest.append(hashlib.sha256(tree.text.encode()).hexdigest())
                for pile, value in zip(out, row, strict=True):
                    pile.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in out), pa.array(digest, pa.string())], ["doc_id", *names, "edited_sha256"])

    return docs.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names) + ", edited_sha256 string")


def with_edits(docs: DataFrame, edits: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Join a table of edits ``(doc_id, seq, start, end, new)`` to their documents as an ordered array column."""
    listed = edits.groupBy(F.col(doc_id).alias("_of")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "new"))), lambda e: F.struct(e["start"].cast("long").alias("start"), e["end"].cast("long").alias("end"), e["new"].alias("new"))).alias("edits")
    )
    return docs.join(listed, F.col(doc_id) == F.col("_of"), "left").drop("_of")
