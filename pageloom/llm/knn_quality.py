"""Quality classifier: votes of the nearest labelled neighbours in a latent space.

*Features.* A document is a bag of hashed byte pairs, of runs of four byte
classes (how letters, capitals, digits, marks and space follow each other) and
of a few counts on words (repeats of the word before, words per thousand bytes,
distinct words, counted anew every 512 words so that the share does not depend
on the length, over the whole text). Counts are taken per thousand bytes and damped by a logarithm.

*Latent space.* The labelled sample (at most ``sample`` rows, those with the
smallest hash of the id, so the choice doesn't depend on order) is weighted by inverse document frequency, centred and reduced by a singular value
decomposition to ``rank`` dimensions.

*Votes.* The labelled vectors (at most ``sample * rank`` numbers) are sent to
executors. Every document is compared with all of them by exact cosine, in
blocks; of the ``k`` nearest each votes with its similarity to a power, and the
share of good votes, with a little of the overall share mixed in, is the score.

Edge cases: null and empty texts have no features; their vector is that of the
centre's mirror and is compared like any other, so they get a score too. Labels
that are null are not learnt from; several labels of one id all count, and so do
several texts (of the labelled texts at most ``2 * sample``, those with the smallest
hashes). Repeated rows get equal scores: similarities are compared to the fifth
digit, and of equally near neighbours those come first that come first in order
of their features. A very long text is one row of features. With no labelled row,
or one class only, the score is the share of good labels (0.5 without any); an
empty table gives an empty result; extra columns are ignored, by :func:`accepted` carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import Words, byte_class, crc_of, doc_slices, text_bytes, text_column

PAIRS, SHAPES, COUNTS = 1024, 512, 4
SIZE = PAIRS + SHAPES + COUNTS
#: A few counts on words stand against many pairs and shapes.
COUNT_WEIGHT = np.array([6, 2, 3, 1], dtype=np.float32)
SAMPLE, RANK, NEIGHBOURS, POWER = 4096, 48, 15, 4.0


def _hash16(n: int, to: int) -> np.ndarray:
    return ((np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % to


def _classes() -> np.ndarray:
    """Sixteen byte classes: space, line end, digit, capital, small, high byte, and marks by kind."""
    out = np.full(256, 15, dtype=np.int64)
    out[[32, 9]] = 0
    out[[10, 13]] = 1
    out[48:58] = 2
    out[65:91] = 3
    out[97:123] = 4
    out[128:] = 5
    for n, marks in enumerate((".", ",;:", "!?", "'\"`", "|", "()[]{}", "&%$#*@^~", "-_/\\", "<>="), 6):
        out[[ord(c) for c in marks]] = n
    return out


_PAIR, _SHAPE, _CLASS = _hash16(1 << 16, PAIRS), _hash16(1 << 16, SHAPES) + PAIRS, _classes()


def _distinct(h: np.ndarray, block: int = 512) -> int:
    """Distinct words of each block of the whole text, added up."""
    return sum(len(np.unique(h[at : at + block])) for at in range(0, len(h), block))


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One damped row of features for each document."""
    n = len(off) - 1
    b = buf[off[0] : off[-1]].astype(np.int64)
    edges = off - off[0]
    home = np.repeat(np.arange(n), np.diff(edges))
    out = np.zeros((n, SIZE), dtype=np.float32)
    if len(b):
        flat = out.reshape(-1)
        for width, names, code in ((2, _PAIR, b), (4, _SHAPE, _CLASS[b])):
            if len(b) < width:
                continue
            run = code[: len(b) - width + 1].copy()
            for j in range(1, width):
                run = (run << (8 if width == 2 else 4)) | code[j : len(b) - width + 1 + j]
            whole = home[: len(run)] == home[width - 1 :]
            flat += np.bincount((home[: len(run)] * SIZE + names[run])[whole], minlength=n * SIZE).astype(np.float32)
    words = Words(buf, off, byte_class("solid"))
    for d in range(n):
        h = words.hash[words.bound[d] : words.bound[d + 1]]
        if len(h):
            size = edges[d + 1] - edges[d]
            out[d, SIZE - COUNTS :] = size * np.array([np.mean(h[1:] == h[:-1]) if len(h) > 1 else 0, len(h) / size, _distinct(h) / len(h), 1 / (1 + len(h))]) / 10
    out /= np.maximum(1, np.diff(edges))[:, None] / 1000
    np.log1p(out, out=out)
    out[:, SIZE - COUNTS :] *= COUNT_WEIGHT
    return out


class Model:
    """The latent space and the labelled vectors in it."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, rank: int, k: int, power: float):
        self.prior = float((labels.sum() + 1) / (len(labels) + 2)) if len(labels) else 0.5
        self.k, self.power = k, power
        self.trained = len(labels) > 1 and 0 < labels.sum() < len(labels)
        if self.trained:
            seen = (rows > 0).sum(axis=0)
            self.weight = np.log((1 + len(rows)) / (1 + seen)).astype(np.float32) + 1
            weighted = rows * self.weight
            self.centre = weighted.mean(axis=0)
            weighted -= self.centre
            values, vectors = np.linalg.eigh((weighted.T @ weighted).astype(np.float64))
            top = np.argsort(values)[::-1][:rank]
            sign = np.sign(vectors[np.abs(vectors[:, top]).argmax(axis=0), top])
            self.basis = (vectors[:, top] * np.where(sign == 0, 1, sign)).astype(np.float32)
            self.vectors = self.unit(rows)
            self.labels = labels.astype(np.float32)

    def unit(self, rows: np.ndarray) -> np.ndarray:
        x = (rows * self.weight - self.centre) @ self.basis
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def score(self, rows: np.ndarray, block: int = 256) -> np.ndarray:
        out = np.full(len(rows), self.prior)
        if self.trained:
            k = min(self.k, len(self.labels))
            for at in range(0, len(rows), block):
                near = np.rint(self.unit(rows[at : at + block]) @ self.vectors.T * 1e5).astype(np.int64)
                rank = np.arange(len(self.labels)) - near * len(self.labels)  # different for all, so the order has no ties
                best = np.sort(np.argpartition(rank, k - 1, axis=1)[:, :k], axis=1)
                vote = (np.maximum(np.take_along_axis(near, best, axis=1), 0) / 1e5) ** self.power
                out[at : at + block] = ((vote * self.labels[best]).sum(axis=1) + 0.01 * self.prior) / (vote.sum(axis=1) + 0.01)
        return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, rank: int = RANK, k: int = NEIGHBOURS, power: float = POWER) -> Model:
    """Learn from the labelled rows; the caller withholds those that are not to be seen."""
    chosen = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id is not null and label is not null")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_column(text).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most `sample` short rows

    def extract(batches):
        for batch in batches:
            buf, off = text_bytes(batch.column("text"))
            at = 0
            for lo, hi in doc_slices(off, 1 << 20):
                x = features(buf, off[lo : hi + 1]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], ["label", "row"])
                at = hi

    found = rows.select("label", "text").mapInArrow(extract, "label int, row binary").orderBy(F.xxhash64("row"), "row", "label").limit(2 * sample)  # the bound matters only where ids repeat
    got = sorted(((r, lab) for lab, r in found.collect()), key=lambda x: (bytes(x[0]), x[1]))
    x = np.array([np.frombuffer(r, np.float16) for r, _ in got], dtype=np.float32).reshape(-1, SIZE)
    return Model(x, np.array([lab for _, lab in got], dtype=np.float32), rank, k, power)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` for every row; no shuffle."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), text_column(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(shared.value, batch.column("text")), pa.float64())], ["doc_id", "score"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def _scores(model: Model, column) -> np.ndarray:
    buf, off = text_bytes(column)
    return np.concatenate([np.zeros(0), *(model.score(features(buf, off[lo : min(hi, lo + n) + 1])) for lo, hi, n in _pieces(off))])


def _pieces(off: np.ndarray, most: int = 256):
    """Ranges of documents bounded in bytes and in number."""
    for lo, hi in doc_slices(off, 1 << 20):
        for at in range(lo, hi, most):
            yield at, min(hi, at + most), most


def accepted(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that score ``threshold`` or more, with all their columns; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores(shared.value, batch.column(text)) >= threshold))

    return docs.mapInArrow(keep, docs.schema)


def training_labels(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The labels that may be learnt from: crc32 of the id is not 1 modulo 3."""
    return labels.filter(F.pmod(crc_of(doc_id), F.lit(3)) != 1)


def quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Fit on the labels that may be learnt from and score all: ``doc_id, held_out, score, predicted``."""
    scored = score(docs, fit(docs, training_labels(labels), **options))
    return scored.select("doc_id", (F.pmod(crc_of(), F.lit(3)) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
