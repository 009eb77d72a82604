"""Substring dedup: shared seeds, collinear chains, alignment.

1. *Seeds.* Words are hashed; of all runs of ``k`` words in every window of
   ``w`` runs the one with the smallest hash is kept, so two documents that
   share ``w + k - 1`` words in a row share a seed. Three such runs that follow
   each other make a long seed (some 20 words), of which in turn the smallest of
   every ``LONG_W`` in a row are kept: common phrases shadow short seeds the more,
   the larger the corpus is, and long ones not.
2. *Join.* The first place of a seed, by (document, word), is its reference. A
   grouped minimum finds it, so a seed that a third of all documents have is
   pre-aggregated before the shuffle; other documents' places of the seed are
   then joined to that one place. No two places are paired otherwise.
3. *Chains.* Per document and reference, matches are chained in order of both
   texts. With linear gap costs the best predecessor is a prefix maximum, which
   a Fenwick tree over the reference positions gives.
4. *Alignment.* The words of both sides around a chain are fetched (only of
   documents that take part, as 24-bit codes) and aligned by extending matches
   along diagonals across edits. What is repeated is the union over references.
   A passage is lost only if its short seeds and also its long ones first stand
   in other documents that hold parts of it and together cover too little of it.
5. A repeated passage has at least ``min_words`` words, of which ``identity``
   or more match.

A seed's first place is never a repeat of another, so every passage survives
once. Repeats within one document are not looked for.

Edge cases: null or empty texts have no words; a document is an id and a text:
repeated rows share their places and count as one, other texts under the same
id (or without an id, which come last) are documents of their own; ties of
chains go to the one that begins first; a very long text is chained and aligned
in its own group of matches; an empty table gives an empty result; extra columns
are ignored or, in :func:`cut_repeats`, carried.
"""

from __future__ import annotations

import bisect
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import Words, byte_class, doc_slices, forget, settle, shingle_hashes, text_bytes, text_column

K, W = 5, 16
LONG_K, LONG_W = 3, 3
CODE = 3
MIN_WORDS, IDENTITY = 50, 0.8
MAX_GAP = 40
GAP_COST = 0.25
_OF, _SPANS = "__document_of_chaining", "__spans_of_chaining"
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def minimizers(h: np.ndarray, bound: np.ndarray, k: int, w: int) -> np.ndarray:
    """First words of the seeds of consecutive documents (``bound``: their word ranges)."""
    n_docs = len(bound) - 1
    if not len(h):
        return np.zeros(0, np.int64)
    runs = np.full(len(h), _TOP, dtype=np.uint64)
    inner = shingle_hashes(h, k)
    runs[: len(inner)] = inner
    home = np.repeat(np.arange(n_docs), np.diff(bound))
    runs[np.arange(len(h)) + k > bound[home + 1]] = _TOP  # would cross into the next document
    spread = np.full(len(h) + (n_docs + 1) * w, _TOP, dtype=np.uint64)  # w places between documents
    at = np.arange(len(h)) + (home + 1) * w
    spread[at] = runs
    low, width = spread.copy(), 1  # minimum over the w places from here on, by doubling
    while width < w:
        step = min(width, w - width)
        low[: len(low) - step] = np.minimum(low[: len(low) - step], low[step:])
        width += step
    high, width = low.copy(), 1  # largest of these minima over the windows that hold a place
    while width < w:
        step = min(width, w - width)
        np.maximum(high[step:], high[: len(high) - step].copy(), out=high[step:])
        width += step
    chosen = (runs == high[at]) & (runs != _TOP)
    same = np.zeros(len(h), dtype=bool)  # a run of one repeated word has one seed
    same[1:] = (runs[1:] == runs[:-1]) & (home[1:] == home[:-1])
    return np.flatnonzero(chosen & ~same)


def chains(d: list[int], r: list[int], k: int = K, gap_cost: float = GAP_COST, max_gap: int = MAX_GAP) -> list[list[int]]:
    """Collinear chains of matches (word ``d[i]`` here, ``r[i]`` there), best first; each match is in one at most."""
    order = sorted(range(len(d)), key=lambda i: (d[i], r[i]))
    places = sorted(set(r))
    best = [(-1e18, -1)] * (len(places) + 1)  # Fenwick tree of prefix maxima
    score, back = [0.0] * len(d), [-1] * len(d)
    waiting: list[tuple[int, tuple[float, int]]] = []
    for n, i in enumerate(order):
        if n and d[i] != d[order[n - 1]]:  # matches at the same word can't follow each other
            for at, value in waiting:
                while at <= len(places):
                    if best[at] < value:
                        best[at] = value
                    at += at & -at
            waiting.clear()
        rank = bisect.bisect_left(places, r[i])
        top, at = (-1e18, -1), rank
        while at > 0:
            if best[at] > top:
                top = best[at]
            at -= at & -at
        gain = top[0] - gap_cost * (d[i] + r[i])
        score[i] = k + max(0.0, gain)
        back[i] = top[1] if gain > 0 else -1
        waiting.append((rank + 1, (score[i] + gap_cost * (d[i] + r[i]), i)))
    used, out = [False] * len(d), []
    for i in sorted(range(len(d)), key=lambda i: (-score[i], d[i])):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = back[i]
        chain.reverse()
        piece: list[int] = []
        for i in chain:  # cut where a gap is too wide
            if piece and max(d[i] - d[piece[-1]], r[i] - r[piece[-1]]) > max_gap + k:
                out.append(piece)
                piece = []
            piece.append(i)
        if piece:
            out.append(piece)
    return out


def _extend(x: np.ndarray, y: np.ndarray, i: int, j: int, step: int) -> list[tuple[int, int]]:
    """Equal words from (i, j) on in one direction, across short edits: (word of x, word of y)."""
    out = []
    while 0 <= i < len(x) and 0 <= j < len(y):
        if x[i] == y[j]:
            out.append((i, j))
            i += step
            j += step
            continue
        for a, b in ((1, 1), (1, 0), (0, 1), (2, 2), (2, 1), (1, 2), (2, 0), (0, 2), (3, 3)):  # resume where three words agree
            p, q = i + a * step, j + b * step
            ahead = [(p + t * step, q + t * step) for t in range(3)]
            if all(0 <= u < len(x) and 0 <= v < len(y) and x[u] == y[v] for u, v in ahead):
                i, j = p, q
                break
        else:
            break
    return out


def aligned(x: np.ndarray, y: np.ndarray, d: list[int], r: list[int], k: int = K) -> np.ndarray:
    """Which words of ``x`` match ``y`` along a chain of matches (``d``, ``r``)."""
    hit = np.zeros(len(x), dtype=bool)
    for i, j in zip(d, r, strict=True):
        hit[i : i + k] = x[i : i + k] == y[j : j + k]
    for n, (i, j) in enumerate(zip(d, r, strict=True)):
        end = (d[n + 1], r[n + 1]) if n + 1 < len(d) else (len(x), len(y))
        if i + k < end[0] and j + k < end[1]:
            got = _extend(x[: end[0]], y[: end[1]], i + k, j + k, 1)
            hit[[p for p, _ in got]] = True
            if n + 1 < len(d) and (not got or got[-1] != (end[0] - 1, end[1] - 1)):
                low = (got[-1][0] + 1, got[-1][1] + 1) if got else (i + k, j + k)
                rest = _extend(x[low[0] : end[0]], y[low[1] : end[1]], end[0] - 1 - low[0], end[1] - 1 - low[1], -1)
                hit[[p + low[0] for p, _ in rest]] = True
    if d:
        hit[[p for p, _ in _extend(x, y, d[0] - 1, r[0] - 1, -1)]] = True
    return hit


def passages(hit: np.ndarray, min_words: int, identity: float, slack: int = 8) -> list[tuple[int, int]]:
    """Runs (first word, number) that begin and end with a match, with gaps of at most ``slack`` words and enough matches."""
    at = np.flatnonzero(hit)
    out = []
    if len(at):
        cut = np.flatnonzero(np.diff(at) > slack + 1)
        for a, b in zip(np.append(0, cut + 1), np.append(cut, len(at) - 1), strict=True):
            first, n, found = int(at[a]), int(at[b] - at[a] + 1), int(b - a + 1)
            if n >= min_words and found >= identity * n:
                out.append((first, n))
            elif n >= min_words:  # dense parts of a run that has thin ones
                out += _dense(at[a : b + 1], min_words, identity)
    return out


def _dense(at: np.ndarray, min_words: int, identity: float) -> list[tuple[int, int]]:
    """Of a run with matches at the words ``at``: the longest stretch with enough matches, and so on to its left and right."""
    share, out, waiting = Fraction(str(identity)), [], [(0, len(at))]
    gain, loss = share.denominator - share.numerator, share.numerator  # a stretch has enough matches if its sum isn't negative
    rank = np.arange(len(at))
    before = rank * gain - (at - at[0] - rank) * loss
    while waiting:
        a, b = waiting.pop()
        if b <= a or at[b - 1] - at[a] + 1 < min_words:
            continue
        least = np.minimum.accumulate(before[a:b])
        start = a + np.searchsorted(-least, -(before[a:b] + gain), "left")  # the first match from which the sum up to each isn't negative
        n = at[a:b] - at[start] + 1
        j = int(n.argmax())
        i = int(start[j])
        if n[j] >= min_words:
            out.append((int(at[i]), int(n[j])))
            waiting += [(a, i), (a + j + 1, b)]
    return sorted(out)


def passages_exact(hit: np.ndarray, shift: int, min_words: int) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return [(int(a) + shift, int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= min_words]


_KEY = ("doc_id", "tag")


def _identified(doc_id: str, text: str):
    """``doc_id, tag``: which document a row is. A row without an id has one from its text, above half of all ids."""
    whole = text_column(text)
    own = F.shiftrightunsigned(F.xxhash64(whole, F.lit(1)), 2).bitwiseOR(1 << 62)
    return F.coalesce(F.col(doc_id).cast("long"), own), F.shiftrightunsigned(F.xxhash64(whole), 33)


def _seeds(docs: DataFrame, k: int, w: int) -> DataFrame:
    """``seed, doc_id, place``: the place is the document's tag and the word (31 and 32 bits)."""

    def seeds(batches):
        kind = byte_class("letters")
        for batch in batches:
            buf, off = text_bytes(batch.column("text"))
            ids, tags = batch.column("doc_id"), batch.column("tag").to_numpy()
            for lo, hi in doc_slices(off):
                words = Words(buf, off[lo : hi + 1], kind)
                at = minimizers(words.hash, words.bound, k, w)
                short = shingle_hashes(words.hash, k)[at]
                home = np.searchsorted(words.bound, at, "right") - 1
                place = (tags[lo + home] << 32) | (at - words.bound[home])
                whole = minimizers(short, np.searchsorted(at, words.bound), LONG_K, LONG_W)
                names = np.concatenate([short, ~shingle_hashes(short, LONG_K)[whole]])
                rank = np.concatenate([np.arange(len(at)), whole])
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), ids.take(pa.array(lo + home[rank])), pa.array(place[rank])], ["seed", "doc_id", "place"])

    return docs.mapInArrow(seeds, "seed long, doc_id long, place long")


def _candidates(matches: DataFrame, k: int) -> DataFrame:
    """``doc_id, tag, ref, ref_tag, d, r``: all chains, best first, one row for each group of
    neighbouring matches and reference. A document's matches are at most its seeds."""

    def close(found):
        # Matches of any reference, near each other in this document. One is enough: length and identity are judged after alignment.
        found = sorted(set(found))  # a short and a long seed may begin at one word
        group: list[tuple] = []
        for m in [*found, None]:
            if group and (m is None or m[0] - group[-1][0] > MAX_GAP + k):
                by: dict[tuple, list[tuple]] = {}
                for word, ref, ref_place in group:
                    by.setdefault((ref, ref_place >> 32), []).append((word, ref_place & 0xFFFFFFFF))
                for (ref, ref_tag), own in by.items():
                    got = chains([d for d, _ in own], [r for _, r in own], k)
                    yield ref, ref_tag, [[own[c][0] for c in chain] for chain in got], [[own[c][1] for c in chain] for chain in got]
                group = []
            if m is not None:
                group.append(m)

    def chain(batches):
        for part in _documents(batches):
            ids, tags = (part.column(c).to_numpy() for c in _KEY)
            cuts = (np.flatnonzero((np.diff(ids) != 0) | (np.diff(tags) != 0)) + 1).tolist()
            found = list(zip(*(part.column(c).to_pylist() for c in ("word", "ref", "ref_place")), strict=True))
            out: dict[str, list] = {c: [] for c in (*_KEY, "ref", "ref_tag", "d", "r")}
            for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                for values in close(found[a:b]):
                    for name, value in zip(out, (int(ids[a]), int(tags[a]), *values), strict=True):
                        out[name].append(value)
            types = (*[pa.int64()] * 4, *[pa.list_(pa.list_(pa.int64()))] * 2)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))

    dealt = matches.repartition(*_KEY).sortWithinPartitions(*_KEY)
    return dealt.mapInArrow(chain, "doc_id long, tag long, ref long, ref_tag long, d array<array<long>>, r array<array<long>>")


def _documents(batches):
    """Tables of whole documents, from rows sorted by document."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        rest = t if rest is None else pa.concat_tables([rest, t])
        if not rest.num_rows:
            continue
        ids, tags = (rest.column(c).to_numpy() for c in _KEY)
        other = np.flatnonzero((ids != ids[-1]) | (tags != tags[-1]))  # the last document may go on in the next batch
        if len(other):
            yield rest.slice(0, int(other[-1]) + 1)
            rest = rest.slice(int(other[-1]) + 1)
    if rest is not None and rest.num_rows:
        yield rest


def _read(codes: bytes) -> np.ndarray:
    raw = np.frombuffer(codes, np.uint8).reshape(-1, CODE)
    wide = np.zeros((len(raw), 4), np.uint8)
    wide[:, :CODE] = raw
    return wide.view("<u4").ravel()


def _codes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Word codes (``CODE`` bytes each) of the wanted documents."""

    def code(batches):
        kind = byte_class("letters")
        for batch in batches:
            buf, off = text_bytes(batch.column("text"))
            out = []
            for lo, hi in doc_slices(off):
                words = Words(buf, off[lo : hi + 1], kind)
                small = words.hash.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CODE]
                out += [small[a:b].tobytes() for a, b in zip(words.bound[:-1], words.bound[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _KEY), pa.array(out, pa.binary())], [*_KEY, "codes"])

    # A merge join at every size: what is wanted grows with the documents.
    return docs.join(wanted.hint("merge"), list(_KEY)).mapInArrow(code, "doc_id long, tag long, codes binary")


def repeated_passages(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, w: int = W, min_words: int = MIN_WORDS, identity: float = IDENTITY
) -> DataFrame:
    """``doc_id, tag, spans, refs`` of each document that repeats passages of documents with smaller ids.

    ``tag`` stands for the text. ``spans``: (first word, number of words) in
    order; ``refs``: the ids of the documents that they were aligned with.
    """
    own, tag = _identified(doc_id, text)
    docs = docs.select(own.alias("doc_id"), tag.alias("tag"), text_column(text).alias("text"))
    seeds = _seeds(docs, k, w)
    shared = seeds.groupBy("seed").agg(F.min(F.struct("doc_id", "place")).alias("at"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Settled, so that the join below has a plain exchange on either side and hot seeds can be split.
    shared = settle(shared.select("seed", F.col("at.doc_id").alias("ref"), F.col("at.place").alias("ref_place")), "seeds")
    matches = seeds.join(shared, "seed").select("doc_id", F.shiftright("place", 32).alias("tag"), F.col("place").bitwiseAND(0xFFFFFFFF).alias("word"), "ref", "ref_place")
    matches = matches.filter((F.col("doc_id") != F.col("ref")) | (F.col("tag") != F.shiftright("ref_place", 32)))
    found = settle(_candidates(matches, k), "chains")
    forget(shared)
    wanted = found.select(*_KEY).unionAll(found.select("ref", "ref_tag")).distinct()
    codes = settle(_codes(docs, wanted).dropDuplicates(list(_KEY)), "codes")

    margin = min_words + w + k
    low = lambda c: F.greatest(F.lit(0), F.array_min(F.flatten(c)) - margin)
    span = lambda c: F.array_max(F.flatten(c)) + k + margin - low(c)
    cut = lambda c: F.substring("codes", CODE * low(c) + 1, CODE * span(c))
    there = found.join(codes.toDF("ref", "ref_tag", "codes"), ["ref", "ref_tag"]).select(*_KEY, "ref", "d", "r", cut("r").alias("y"))
    both = there.join(codes, list(_KEY)).select(*_KEY, "ref", "d", "r", "y", cut("d").alias("x"), low("d").alias("d0"), low("r").alias("r0"))

    def align(batches):
        for batch in batches:
            first, n = [], []
            for row in batch.to_pylist():
                x, y = (_read(row[c]) for c in "xy")
                hit = np.zeros(len(x), dtype=bool)
                for d, r in zip(row["d"], row["r"], strict=True):
                    d = [i - row["d0"] for i in d]
                    if not all(hit[i : i + k].all() for i in d):  # else a better chain has it, as in texts of few words
                        hit |= aligned(x, y, d, [j - row["r0"] for j in r], k)
                runs = passages_exact(hit, row["d0"], 1)
                first.append([a for a, _ in runs])
                n.append([b for _, b in runs])
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*_KEY, "ref")), pa.array(first, lists), pa.array(n, lists)], [*_KEY, "ref", "first", "n"])

    runs = both.mapInArrow(align, "doc_id long, tag long, ref long, first array<long>, n array<long>")

    def merge(batches):  # a document's runs are at most its words, several times over
        for t in _documents(batches):
            ids, tags = (t.column(c).to_numpy() for c in _KEY)
            of_row = np.append(0, np.cumsum((np.diff(ids) != 0) | (np.diff(tags) != 0)))
            rows = np.repeat(np.arange(t.num_rows), pc.list_value_length(t.column("n")).to_numpy())
            first, n = (pc.list_flatten(t.column(c)).to_numpy() for c in ("first", "n"))
            size = np.zeros(of_row[-1] + 1, dtype=np.int64)
            np.maximum.at(size, of_row[rows], first + n)
            base = np.append(0, np.cumsum(size + 32))  # documents one after another, too far apart for one passage
            at = base[of_row[rows]] + first
            open_ = np.bincount(at, minlength=base[-1] + 1) - np.bincount(at + n, minlength=base[-1] + 1)
            spans = passages(np.cumsum(open_) > 0, min_words, identity)
            inside = np.zeros(base[-1] + 1, dtype=bool)
            for a, b in spans:
                inside[a : a + b] = True
            of_span = np.searchsorted(base, [a for a, _ in spans], "right") - 1
            used = np.flatnonzero(inside[at])
            refs: dict[int, set] = {}
            for d, ref in zip(of_row[rows[used]].tolist(), t.column("ref").to_numpy()[rows[used]].tolist(), strict=True):
                refs.setdefault(d, set()).add(ref)
            found: dict[int, list] = {}
            for d, (a, b) in zip(of_span.tolist(), spans, strict=True):
                found.setdefault(d, []).append({"first": a - int(base[d]), "n": b})
            head = np.searchsorted(of_row, list(found)) if found else np.zeros(0, np.int64)
            kinds = (pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())])), pa.list_(pa.int64()))
            values = (list(found.values()), [sorted(refs[d]) for d in found])
            yield pa.RecordBatch.from_arrays([pa.array(ids[head]), pa.array(tags[head]), *(pa.array(v, k) for v, k in zip(values, kinds, strict=True))], [*_KEY, "spans", "refs"])

    merged = runs.filter(F.size("n") > 0).repartition(*_KEY).sortWithinPartitions(*_KEY)
    out = settle(merged.mapInArrow(merge, "doc_id long, tag long, spans array<struct<first:long,n:long>>, refs array<long>"), "passages")
    forget(found, codes)
    return out


def repeats_by_document(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: ``doc_id, n_passages, n_repeated, spans, refs`` (empty lists where nothing repeats)."""
    found = repeated_passages(docs, doc_id, text, **options)
    own, tag = _identified(doc_id, text)
    ids = docs.select(F.col(doc_id).cast("long").alias("own_id"), own.alias("doc_id"), tag.alias("tag"))
    spans = F.coalesce("spans", F.array().cast("array<struct<first:long,n:long>>"))
    return ids.join(found, list(_KEY), "left").select(
        F.col("own_id").alias("doc_id"),
        F.size(spans).cast("long").alias("n_passages"),
        F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s["n"]).alias("n_repeated"),
        spans.alias("spans"),
        F.coalesce("refs", F.array().cast("array<long>")).alias("refs"),
    )


def cut_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str | None = "n_chars", **options) -> DataFrame:
    """The documents with repeated passages cut out of their text (the first place keeps its own).

    From the first letter of a passage to the first letter of the word after
    it, or to the end. ``length``, where there is such a column, is counted anew
    for texts that changed. All rows and columns stay.
    """
    found = repeated_passages(docs, doc_id, text, **options).select(F.struct("doc_id", "tag").alias(_OF), F.col("spans").alias(_SPANS))
    own, tag = _identified(doc_id, text)
    joined = docs.join(found.hint("merge"), F.struct(own.alias("doc_id"), tag.alias("tag")) == F.col(_OF), "left")
    columns = docs.columns
    at = columns.index(text)

    def cut(batches):
        kind = byte_class("letters")
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for n, spans in enumerate(batch.column(_SPANS).to_pylist()):
                if spans:
                    raw = np.frombuffer(texts[n].encode(), np.uint8)
                    words = Words(raw, np.array([0, len(raw)]), kind)
                    keep = np.ones(len(raw), dtype=bool)
                    for s in spans:
                        end = s["first"] + s["n"]
                        keep[words.start[s["first"]] : words.start[end] if end < len(words.start) else len(raw)] = False
                    texts[n] = raw[keep].tobytes().decode()
            out = batch.select(columns)
            yield out.set_column(at, out.schema.field(at), pa.array(texts, out.schema.field(at).type))

    out = joined.select(*columns, _SPANS).mapInArrow(cut, docs.schema)
    if length in columns:
        out = out.withColumn(length, F.when(F.col(text).isNotNull(), F.char_length(text).cast(docs.schema[length].dataType)).otherwise(F.col(length)))
    return out
