"""Benchmark decontamination by a prefix-filtered join of windows.

Every run of ``window`` consecutive words of a benchmark item is a record (an
item with fewer words is one record); equal runs are one, whatever items have
them. The words of a record are put in order of rarity, counted over all
documents. As a record must be contained whole, its necessary prefix is one word,
the rarest; documents meet records only at occurrences of that word. The word's
place in the record then fixes where the record would lie (a record of ten words
has ten such places, so an occurrence is tried at most that often for each length,
however many records have the word): the length and positional bounds drop
placings that stick out of the document, and what is left is looked up as a whole
and compared word by word.

The benchmark is read in blocks of at most ``block_bytes`` of text, so what is
sent to executors has a fixed bound whatever the benchmark's size. Words are
counted in one scan; each block is one more. What blocks find is put together by
the text alone, on which alone it depends.

Edge cases: a null or empty text has no words and is never hit; an item without
words has no record; equal items are all reported; repeated documents, other
texts under one id and rows without an id each get their own row; ties of rarity go to
the first word of the record; a very long text is probed in place, with no rows made of it;
an empty table of documents gives an empty result, one of items hits nothing; extra
columns are ignored, by :func:`clean_documents` carried.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import Words, byte_class, doc_slices, forget, mix, settle, text_bytes, text_column

WINDOW = 10
BLOCK_BYTES = 16 << 20


class _Records:
    """The different windows of one block of items."""

    def __init__(self, items: list[tuple[object, str]], window: int):
        buf, off = text_bytes(pa.array([t for _, t in items], pa.string()))
        words = Words(buf, off, byte_class("letters"))
        self.words, self.items = words, [str(i) for i, _ in items]
        size = np.diff(words.bound)
        many = np.where(size > 0, np.maximum(1, size - window + 1), 0)
        owner = np.repeat(np.arange(len(items)), many)
        first = words.bound[owner] + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        length = np.minimum(window, size)[owner]
        whole = np.zeros(len(first), dtype=np.uint64)
        for n in np.unique(length):
            whole[length == n] = _window_hashes(words.hash, first[length == n], n)
        self.whole, one, of = np.unique(whole, return_index=True, return_inverse=True)
        self.first, self.length = first[one], length[one]
        pairs = np.unique(of * max(1, len(items)) + owner)  # which items have a record
        self.owner, self.owner_at = pairs % max(1, len(items)), np.searchsorted(pairs // max(1, len(items)), np.arange(len(one) + 1))
        self.vocabulary = np.unique(words.hash)

    def order(self, counts: np.ndarray) -> None:
        """Choose each record's rarest word (the first of ties) and note at which places of records of which length a word is that."""
        window = int(self.length.max(initial=1))
        count_of = counts[np.searchsorted(self.vocabulary, self.words.hash)]
        at = np.minimum(self.first[:, None] + np.arange(window), max(0, len(count_of) - 1))
        rarity = np.where(np.arange(window) < self.length[:, None], count_of[at] if len(count_of) else 0, np.iinfo(np.int64).max)
        shift = rarity.argmin(axis=1) if len(rarity) else np.zeros(0, np.int64)
        self.keys, key_of = np.unique(self.words.hash[self.first + shift] if len(shift) else np.zeros(0, np.uint64), return_inverse=True)
        self.places = {}
        for n, s in set(zip(self.length.tolist(), shift.tolist(), strict=True)):
            has = np.zeros(len(self.keys), dtype=bool)
            has[key_of[(self.length == n) & (shift == s)]] = True
            self.places[n, s] = has

    def hits(self, doc: Words) -> tuple[np.ndarray, np.ndarray]:
        """Placings (record, first word) of all records in the documents."""
        maybe = np.zeros(1 << 16, dtype=bool)
        maybe[self.keys & np.uint64(0xFFFF)] = True
        place = np.flatnonzero(maybe[doc.hash & np.uint64(0xFFFF)])
        slot = np.searchsorted(self.keys, doc.hash[place])
        slot[slot == len(self.keys)] = 0
        keep = self.keys[slot] == doc.hash[place] if len(self.keys) else np.zeros(len(place), bool)
        place, slot = place[keep], slot[keep]
        home = np.searchsorted(doc.bound, place, "right") - 1
        records, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for (n, s), has in sorted(self.places.items()) if len(place) else ():
            fits = has[slot] & (place - s >= doc.bound[home]) & (place - s + n <= doc.bound[home + 1])
            start = place[fits] - s
            got = _window_hashes(doc.hash, start, n)
            at = np.searchsorted(self.whole, got)
            at[at == len(self.whole)] = 0
            same = (self.whole[at] == got) & (self.length[at] == n)
            at, start = at[same], start[same]
            for j in range(n):
                same = doc.hash[start + j] == self.words.hash[self.first[at] + j]
                at, start = at[same], start[same]
            records.append(at)
            starts.append(start)
        record, start = np.concatenate(records), np.concatenate(starts)
        right = np.ones(len(record), dtype=bool)  # the letters themselves, once for each record
        for r, i in zip(*np.unique(record, return_index=True), strict=True):
            if any(doc.text(start[i] + j) != self.words.text(self.first[r] + j) for j in range(self.length[r])):
                right[record == r] = [all(doc.text(s + j) == self.words.text(self.first[r] + j) for j in range(self.length[r])) for s in start[record == r]]
        return record[right], start[right]

    def names(self, records: np.ndarray) -> list[str]:
        """The items that have any of the records."""
        return sorted({self.items[o] for r in np.unique(records) for o in self.owner[self.owner_at[r] : self.owner_at[r + 1]]})


def _window_hashes(h: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words that begin at ``start``."""
    out = np.full(len(start), n, dtype=np.uint64)
    for j in range(n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[start + j]
    return mix(out)


def _word_counts(docs: DataFrame) -> DataFrame:
    """``word, n``: all words of all documents, counted in each task before they are shuffled."""

    def count(batches):
        keys, counts, kept = [], [], 0
        kind = byte_class("letters")

        def merged():
            k, at = np.unique(np.concatenate(keys), return_inverse=True)
            return k, np.bincount(at, np.concatenate(counts), len(k)).astype(np.int64)

        def handed(k, c):
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], ["word", "n"])

        for batch in batches:
            buf, off = text_bytes(batch.column("text"))
            for lo, hi in doc_slices(off):
                k, c = np.unique(Words(buf, off[lo : hi + 1], kind).hash, return_counts=True)
                keys.append(k)
                counts.append(c)
                if sum(map(len, keys)) > max(2 * kept, 1 << 18):
                    k, c = merged()
                    if len(k) > 1 << 21:  # bounded memory: hand over and start anew
                        yield handed(k, c)
                        k, c = k[:0], c[:0]
                    keys, counts, kept = [k], [c], len(k)
        if keys:
            yield handed(*merged())

    return docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counts(docs: DataFrame, words: np.ndarray) -> np.ndarray:
    """Occurrences of the given words (those of one block) over all documents, in a scan with no shuffle of words."""
    kind = byte_class("letters")

    def count(batches):
        total = np.zeros(len(words), dtype=np.int64)
        for batch in batches:
            buf, off = text_bytes(batch.column("text"))
            for lo, hi in doc_slices(off):
                h = Words(buf, off[lo : hi + 1], kind).hash
                at = np.searchsorted(words, h)
                at[at == len(words)] = 0
                total += np.bincount(at[words[at] == h], minlength=len(words))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["at", "n"])

    out = np.zeros(len(words), dtype=np.int64)
    if len(words):
        for at, n in docs.select("text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n")).collect():  # at most one row for each word of the block
            out[at] = n
    return out


def _indexes(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int):
    """The records of each block, ordered and broadcast; what a block has is bounded by ``block_bytes``."""
    spark = docs.sparkSession
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    if n == 1:
        records = _Records([tuple(r) for r in benchmark.select("item_id", "text").collect()], window)
        records.order(_counts(docs, records.vocabulary))
        yield spark.sparkContext.broadcast(records)
        return
    dealt = settle(benchmark.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), "items")
    item_words = _block_words(dealt)
    counted = settle(item_words.join(_word_counts(docs), "word").select("block", "word", "n"), "counts")  # words of the benchmark only
    for b in range(n):
        records = _Records([tuple(r) for r in dealt.filter(F.col("block") == b).select("item_id", "text").collect()], window)
        counts = np.zeros(len(records.vocabulary), dtype=np.int64)
        for word, count in counted.filter(F.col("block") == b).select("word", "n").collect():  # at most one row for each word of the block
            counts[np.searchsorted(records.vocabulary, np.uint64(word & (2**64 - 1)))] = count
        records.order(counts)
        yield spark.sparkContext.broadcast(records)
    forget(dealt, counted)


def _block_words(dealt: DataFrame) -> DataFrame:
    def words(batches):
        kind = byte_class("letters")
        for batch in batches:
            block = batch.column("block").to_numpy()
            buf, off = text_bytes(batch.column("text"))
            for lo, hi in doc_slices(off):
                w = Words(buf, off[lo : hi + 1], kind)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(block[lo:hi], np.diff(w.bound))), pa.array(w.hash.view(np.int64))], ["block", "word"])

    return dealt.select("block", "text").mapInArrow(words, "block long, word long").distinct()


_TEXT = "__text_of_decontam"


def _text_key(text):
    """Stands for a text: 128 bits."""
    return F.struct(F.xxhash64(text), F.xxhash64(text, F.lit(1)))


def _probe(docs: DataFrame, shared, only_hit: bool) -> DataFrame:
    """``doc_id, key, n_words, spans, items`` of the documents, or of those that are hit."""
    span = pa.struct([("first", pa.int64()), ("n", pa.int64())])
    kept = [c for c in docs.columns if c != "text"]

    def probe(batches):
        records, kind = shared.value, byte_class("letters")
        for batch in batches:
            buf, off = text_bytes(batch.column("text"))
            n_words, spans, items = [], [], []
            for lo, hi in doc_slices(off):
                doc = Words(buf, off[lo : hi + 1], kind)
                n_words.append(np.diff(doc.bound))
                record, start = records.hits(doc)
                found = [[] for _ in range(hi - lo)], [[] for _ in range(hi - lo)]
                home = np.searchsorted(doc.bound, start, "right") - 1
                for d in np.unique(home):
                    mine = home == d
                    s, e = start[mine] - doc.bound[d], start[mine] - doc.bound[d] + records.length[record[mine]]
                    rank = np.argsort(s, kind="stable")
                    s, e = s[rank], np.maximum.accumulate(e[rank])
                    new = np.append(True, s[1:] > e[:-1])
                    found[0][d] = [{"first": int(a), "n": int(b - a)} for a, b in zip(s[new], e[np.append(new[1:], True)], strict=True)]
                    found[1][d] = records.names(record[mine])
                spans += found[0]
                items += found[1]
            out = pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(np.concatenate(n_words) if n_words else [], pa.int64()), pa.array(spans, pa.list_(span)), pa.array(items, pa.list_(pa.string()))],
                [*kept, "n_words", "spans", "items"],
            )
            yield out.filter(pa.array([bool(x) for x in spans], pa.bool_())) if only_hit else out

    known = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.mapInArrow(probe, f"{known}, n_words long, spans array<struct<first:long,n:long>>, items array<string>")


def hit_spans(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document: ``doc_id, n_words, spans, items``.

    ``spans`` are disjoint runs of hit words (first word, number of words),
    ``items`` the items (as strings) that have an occurring window.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), text_column(text).alias("text"))
    benchmark = benchmark.select(F.col(item_id).alias("item_id"), text_column(item_text).alias("text"))
    first, *others = _indexes(docs, benchmark, window, block_bytes)
    if not others:
        return _probe(docs, first, False)
    keyed = docs.withColumn("key", _text_key(F.col("text")))
    more = reduce(DataFrame.unionAll, [_probe(keyed, b, True) for b in others])
    more = more.groupBy("key", "n_words").agg(F.flatten(F.collect_set("spans")).alias("more_spans"), F.flatten(F.collect_set("items")).alias("more_items"))  # a set for each block at most
    joined = _probe(keyed, first, False).join(more, ["key", "n_words"], "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    spans = F.concat("spans", none("more_spans", "array<struct<first:long,n:long>>"))
    return joined.select("doc_id", "n_words", spans.alias("spans"), F.array_distinct(F.concat("items", none("more_items", "array<string>"))).alias("items")).withColumn("spans", _merged("spans"))


def _merged(spans: str):
    """Disjoint runs from overlapping ones."""
    end = lambda s: s["first"] + s["n"]
    last = lambda acc: F.element_at(acc, -1)
    joined = lambda acc, s: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["first"].alias("first"), (F.greatest(end(last(acc)), end(s)) - last(acc)["first"]).alias("n"))))
    return F.aggregate(
        F.array_sort(F.col(spans)),
        F.array().cast("array<struct<first:long,n:long>>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (end(F.try_element_at(acc, F.lit(-1))) >= s["first"]), joined(acc, s)).otherwise(F.concat(acc, F.array(s))),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """:func:`hit_spans` as counts: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    spans = hit_spans(docs, benchmark, **options)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["n"])
    return spans.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without any benchmark window, with all their columns; no shuffle if the benchmark is one block."""
    plain = docs.select(text_column(text).alias("text"))
    items_of = benchmark.select(F.col(item_id).alias("item_id"), text_column(item_text).alias("text"))
    first, *others = _indexes(plain, items_of, window, block_bytes)

    def drop(batches):
        records, kind = first.value, byte_class("letters")
        for batch in batches:
            buf, off = text_bytes(batch.column(text))
            clean = np.ones(batch.num_rows, dtype=bool)
            for lo, hi in doc_slices(off):
                doc = Words(buf, off[lo : hi + 1], kind)
                start = records.hits(doc)[1]
                clean[lo + np.searchsorted(doc.bound, start, "right") - 1] = False
            yield batch.filter(pa.array(clean))

    kept = docs.mapInArrow(drop, docs.schema)
    if not others:
        return kept
    keyed = plain.withColumn("key", _text_key(F.col("text")))
    hit = reduce(DataFrame.unionAll, [_probe(keyed, b, True) for b in others]).select(F.col("key").alias(_TEXT)).distinct()
    return kept.join(hit.hint("merge"), _text_key(text_column(text)) == F.col(_TEXT), "left_anti")
