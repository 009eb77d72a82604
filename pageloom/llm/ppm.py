"""Language-model scoring by prediction by partial matching over bytes.

*Model.* All runs of ``order + 1`` symbols of the training texts, with their
counts, form a context trie; lower orders are sums of higher ones. A symbol is a
byte of the text with A-Z in lower case, or the end of the text; before the text
stand ``order`` start symbols. Every run of the training texts is in it.

*Probability.* From the longest known context down, a symbol is coded with its
count or by an escape. Every symbol of a context yields the escape a discount. It
is estimated for each order on an eighth of the training texts: how often what
the others have for a context fails there, against how many symbols they have.
Symbols that a longer context offers are excluded below it. After order 0 the
symbols not yet excluded are equally likely. Because a context's symbols are
among those of its shorter contexts, the excluded counts are one number per
context, summed once.

*Where it is kept.* The trie is a table and nobody holds it whole. The texts are
dealt into buckets; each bucket asks once for every different run (and word)
that it has. Runs are dealt by the three symbols before the last one, which
holds together all deeper contexts, and get their log-probability there, streamed
by that context (one has 257^3 runs at most). Sent to executors are only counts of one and two
symbols and sums of contexts of two (258^2 numbers each, whatever the corpus).
The log-probabilities then go back to the buckets that asked.

*Base.* A word model with added counts, over the whole vocabulary, on the same way.

Edge cases: a null text is empty and is coded as its end alone; repeated rows
score alike; ties cannot arise, every number is a sum; a very long text is
counted and scored in pieces; with no training text the
model is uniform and the base has only its added counts; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import _LOWER, Words, byte_class, crc_of, doc_slices, forget, settle, text_bytes, text_column

ORDER, NEAR = 5, 3
#: A bucket's text (the larger, the fewer runs and words are asked for more than once), and what is worked on at a time.
BUCKET_BYTES, PIECE = 64 << 20, 1 << 20
#: A bucket is a task of its own up to so many buckets; of more, several share a task one after the other.
MOST_TASKS = 65_536
BITS, START, END, SYMBOLS = 9, 0, 257, 257
CODES = SYMBOLS + 1
WORD, RUN = 0, 1
_U = np.uint64


def _mask(symbols: int) -> int:
    return (1 << BITS * symbols) - 1


def _packed(s: np.ndarray, order: int) -> np.ndarray:
    out = s[: len(s) - order].copy()
    for j in range(1, order + 1):
        out <<= _U(BITS)
        out |= s[j : len(s) - order + j]
    return out


def pieces(buf: np.ndarray, off: np.ndarray, order: int):
    """``lo, hi, runs, begin`` of slices of the documents; a long document comes in several."""
    for lo, hi in doc_slices(off, PIECE):
        if off[hi] - off[lo] <= 2 * PIECE:
            yield lo, hi, *runs(buf, off[lo : hi + 1], order)
            continue
        first, last = int(off[lo]), int(off[hi])  # one document
        for a in range(first, last, PIECE):
            b = min(a + PIECE, last)
            head = _LOWER[buf[max(first, a - order) : a]].astype(_U) + _U(1)
            s = np.concatenate([np.full(order - len(head), START, _U), head, _LOWER[buf[a:b]].astype(_U) + _U(1), np.full(int(b == last), END, _U)])
            got = _packed(s, order)
            yield lo, hi, got, np.array([0, len(got)])


def runs(buf: np.ndarray, off: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """All runs of ``order + 1`` symbols, packed, and where each document's runs begin."""
    n = np.diff(off)
    begin = np.append(0, np.cumsum(n + order + 1))
    s = np.full(begin[-1], START, dtype=_U)
    home = np.repeat(np.arange(len(n)), n)
    raw = buf[off[0] : off[-1]]
    s[np.arange(len(raw)) - (off[home] - off[0]) + begin[home] + order] = _LOWER[raw].astype(_U) + _U(1)
    s[begin[1:] - 1] = END
    packed = _packed(s, order)
    keep = np.ones(len(packed), dtype=bool)
    for j in range(order):  # runs that would reach into the next document
        keep[begin[1:-1] - 1 - j] = False
    return packed[keep], np.append(0, np.cumsum(n + 1))


def summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys with the sums of their counts."""
    rank = np.argsort(keys, kind="stable")
    k = keys[rank]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[first], *(np.add.reduceat(c[rank], first) if len(first) else c for c in counts)


def _different(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the number of each key among them, by hashing."""
    coded = pa.array(keys).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key is in the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


# ---------------------------------------------------------------- the model


def discount(escapes: float, expected: float) -> float:
    """What each symbol of a context yields to the escape: the escapes that were seen, against those at a discount of 1."""
    return min(0.95, max(0.01, escapes / expected)) if expected else 0.5


def escapes(run: np.ndarray, n: np.ndarray, aside: np.ndarray) -> tuple[float, float]:
    """Of the texts set aside (counts ``aside``, part of ``n``): escapes from contexts that the others have, and those expected at a discount of 1."""
    context, first = np.unique(run >> _U(BITS), return_index=True)
    if not len(context):
        return 0.0, 0.0
    others, missing = n - aside, np.where(n == aside, aside, 0)
    whole, symbols, seen, failed = (np.add.reduceat(x, first) for x in (others, others > 0, aside, missing))
    known = whole > 0
    return float(failed[known].sum()), float((seen[known] * symbols[known] / whole[known]).sum())


@dataclass
class Low:
    """What every task gets of the model: counts of one and two symbols, sums of contexts of two, discounts."""

    one: np.ndarray  # [CODES]
    two: np.ndarray  # [CODES, CODES]: context, symbol
    context: np.ndarray  # [3, CODES * CODES]: occurrences, symbols and shadow of contexts of two symbols
    discounts: list[float]


def log_probabilities(run: np.ndarray, n: np.ndarray, head: np.ndarray, below: np.ndarray, low: Low, order: int) -> np.ndarray:
    """log10 of the probability of the last symbol of each run after the others.

    The runs are all those of some contexts of ``NEAR`` symbols, with their
    counts in training texts (0: none); ``head`` are their last ``NEAR + 1``
    symbols (sorted), ``below`` the training counts of the last ``NEAR`` of these.
    """
    levels = {order: summed(run[n > 0], n[n > 0].astype(np.float64))}
    for d in range(order - 1, NEAR - 1, -1):
        k, c = levels[d + 1]
        levels[d] = summed(k & _U(_mask(d + 1)), c)
    out, excluded, shadow = (np.zeros(len(run)) for _ in range(3))
    open_ = np.arange(len(run))

    def step(d, whole, symbols, gone, count):
        """One order: coded symbols leave ``open_``, the others escape."""
        nonlocal open_
        known = whole > 0
        mine, count = open_[known], count[known]
        rest, fresh = whole[known] - shadow[mine], symbols[known] - excluded[mine]
        coded = count > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.where(coded, count - low.discounts[d], low.discounts[d] * fresh) / rest
        out[mine] += np.log10(np.where(rest > 0, share, 1.0))
        excluded[mine], shadow[mine] = symbols[known], gone[known]
        still = np.ones(len(open_), dtype=bool)
        still[np.flatnonzero(known)[coded]] = False
        open_ = open_[still]

    for d in range(order, NEAR - 1, -1):
        k, c = levels[d]
        context, first = np.unique(k >> _U(BITS), return_index=True)
        symbols = np.diff(np.append(first, len(k))).astype(np.float64)
        keys, counts = levels.get(d - 1, (head, below))
        at, there = _found(keys, k & _U(_mask(d if d > NEAR else NEAR + 1)))
        gone = np.add.reduceat(np.where(there, counts[at], 0.0), first) if len(first) else symbols
        mine = run[open_] & _U(_mask(d + 1))
        at, known = _found(context, mine >> _U(BITS))
        slot, coded = _found(k, mine)
        pick = lambda x, at=at, known=known: np.where(known, x[at], 0.0) if len(x) else np.zeros(len(at))
        whole = np.add.reduceat(c, first) if len(first) else symbols
        step(d, pick(whole), pick(symbols), pick(gone), np.where(coded, c[slot], 0.0) if len(c) else np.zeros(len(mine)))
    part = lambda i: ((run[open_] >> _U(BITS * i)) & _U(_mask(1))).astype(np.int64)
    two = part(2) * CODES + part(1)
    step(2, *(x[two] for x in low.context), below[np.searchsorted(head, run[open_] & _U(_mask(NEAR + 1)))])
    one, offered = part(1), low.two > 0
    step(1, low.two.sum(axis=1)[one], offered.sum(axis=1)[one].astype(np.float64), (offered @ low.one)[one], low.two[one, part(0)])
    nothing = np.zeros(len(open_))
    step(0, nothing + low.one.sum(), nothing + (low.one > 0).sum(), nothing, low.one[part(0)])
    out[open_] -= np.log10(np.maximum(1.0, SYMBOLS - excluded[open_]))
    return out


def _contexts(batches, rows: int = 1 << 18):
    """Tables of about so many rows that are sorted by ``near``, cut between contexts."""
    waiting: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in waiting) < rows:
            continue
        t = pa.concat_tables(waiting)
        near = t.column("near").to_numpy()
        whole = int(np.searchsorted(near, near[-1], "left"))  # the last context may go on in the next batch
        waiting = [t.slice(whole)]
        if whole:
            yield t.slice(0, whole)
    if waiting:
        yield pa.concat_tables(waiting)


def _last(symbols: int):
    return F.col("run").bitwiseAND(_mask(symbols)).alias("run")


def run_scores(totals: DataFrame, order: int = ORDER) -> DataFrame:
    """``run, score`` for a table of all different runs ``run, n, aside`` (``n``: their count in training texts, 0 for none)."""
    spark = totals.sparkSession
    sums = [F.sum("n").alias("n"), F.sum("aside").alias("aside")]
    near = settle(totals.groupBy(_last(NEAR + 1)).agg(*sums), "runs")
    three = settle(near.groupBy(_last(NEAR)).agg(*sums), "runs")
    pairs = three.filter("n > 0").groupBy(_last(2)).agg(*sums)
    two, aside = np.zeros((CODES, CODES)), np.zeros((CODES, CODES))
    for run, n, m in pairs.collect():  # CODES ** 2 rows at most
        two[run >> BITS, run & _mask(1)], aside[run >> BITS, run & _mask(1)] = n, m
    one = two.sum(axis=0)
    singles = np.arange(CODES, dtype=_U)
    doubles = (singles[:, None] << _U(BITS) | singles).ravel()
    seen = [escapes(singles[one > 0], one[one > 0], aside.sum(axis=0)[one > 0]), escapes(doubles[two.ravel() > 0], two[two > 0], aside[two > 0])]
    above = three.filter("n > 0").join(F.broadcast(pairs.select(F.col("run").alias("pair"), F.col("n").alias("m"))), F.col("run").bitwiseAND(_mask(2)) == F.col("pair"))  # as many
    others = F.col("n") - F.col("aside")
    above = above.groupBy(F.shiftright("run", BITS).alias("at")).agg(
        F.sum("n"), F.count(F.lit(1)), F.sum("m"), F.sum(others).alias("whole"), F.count(F.when(others > 0, 1)).alias("symbols"), F.sum("aside"), F.sum(F.when(others == 0, F.col("aside")).otherwise(0))
    )
    context, failed, expected = np.zeros((3, CODES * CODES)), 0.0, 0.0
    for at, n, symbols, gone, whole, kinds, tried, missing in above.collect():  # CODES ** 2 rows at most
        context[:, (at >> BITS) * CODES + (at & _mask(1))] = n, symbols, gone
        if whole:
            failed, expected = failed + missing, expected + tried * kinds / whole
    seen.append((failed, expected))

    def tried(batches):
        for t in _contexts(batches):
            k, n, m = t.column("run").to_numpy().astype(np.int64).view(_U), t.column("n").to_numpy(), t.column("aside").to_numpy()
            for d in range(order, NEAR - 1, -1):
                k, n, m = summed(k & _U(_mask(d + 1)), n, m)
                got = escapes(k[n > 0], n[n > 0], m[n > 0])
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), *(pa.array([x]) for x in got)], ["d", "failed", "expected"])

    by_near = F.shiftright("run", BITS).bitwiseAND(_mask(NEAR)).alias("near")
    deep = totals.select(by_near, "run", "n", "aside").repartition("near").sortWithinPartitions("near").mapInArrow(tried, "d int, failed double, expected double")
    seen += [tuple(r)[1:] for r in deep.groupBy("d").agg(F.sum("failed"), F.sum("expected")).orderBy("d").collect()]  # a row for each order
    low = spark.sparkContext.broadcast(Low(one, two, context, [discount(*x) for x in seen] or [0.5]))

    # The last four symbols come before the runs that end with them, with the count of the last three.
    heads = near.select(F.col("run").alias("head"), _last(NEAR)).join(three.select("run", "n"), "run").select(F.shiftright("head", BITS).alias("near"), F.lit(0).alias("kind"), F.col("head").alias("run"), "n")
    rows = totals.select(by_near, F.lit(1).alias("kind"), "run", "n")

    def score(batches):
        for t in _contexts(batches):
            kind, run, n = (t.column(c).to_numpy() for c in ("kind", "run", "n"))
            run, top = run.astype(np.int64).view(_U), kind == 0
            head, below = summed(run[top], n[top].astype(np.float64))
            run, n = run[~top], n[~top]
            got = log_probabilities(run, n, head, below, low.value, order)
            for at in range(0, len(run), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(run[at : at + (1 << 17)].view(np.int64)), pa.array(got[at : at + (1 << 17)])], ["run", "score"])

    dealt = heads.unionAll(rows).repartition("near").sortWithinPartitions("near", "kind")
    out = settle(dealt.mapInArrow(score, "run long, score double"), "runs")
    forget(near, three)
    return out


# ---------------------------------------------------------------- buckets


def _slices_of(batch: pa.RecordBatch, *columns: str):
    """Slices of a batch within which the columns don't change."""
    cut = np.zeros(max(0, batch.num_rows - 1), dtype=bool)
    for c in columns:
        cut |= np.diff(batch.column(c).to_numpy()) != 0
    edges = [0, *(np.flatnonzero(cut) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


class _Tally:
    """Different keys with their counts in all that is learnt and in what is set aside, merged when half as many wait as there are."""

    def __init__(self):
        self.parts, self.kept = [(np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64))], 0

    def add(self, keys: np.ndarray, *weights: np.ndarray) -> None:
        different, code = _different(keys)
        self.parts.append((different, *(np.bincount(code, w, len(different)).astype(np.int64) for w in weights)))
        if sum(len(p[0]) for p in self.parts) > self.kept + max(self.kept // 2, 1 << 19):
            self.merge()

    def merge(self) -> tuple[np.ndarray, ...]:
        columns = [list(c) for c in zip(*self.parts, strict=True)]
        self.parts.clear()

        def whole(c: list[np.ndarray]) -> np.ndarray:  # the pieces go as soon as they are put together
            out = np.concatenate(c)
            c.clear()
            return out

        keys = whole(columns[0])
        rank = np.argsort(keys, kind="stable")
        keys = keys[rank]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        keys = keys[first]
        self.kept = len(keys)
        self.parts.append((keys, *(np.add.reduceat(whole(c)[rank], first) if len(first) else whole(c) for c in columns[1:])))
        return self.parts[0]


def _dealt(rows: DataFrame, buckets: int, *order: str) -> DataFrame:
    """Rows by bucket, placed by its number: hashed buckets could meet in one partition while others stay empty."""
    return rows.repartitionById(min(buckets, MOST_TASKS), "bucket").sortWithinPartitions("bucket", *order)


def _asked(docs: DataFrame, order: int, buckets: int) -> DataFrame:
    """``bucket, kind, key, n, aside``: every different word and run of each bucket with its counts in training texts."""

    def different(batches):
        solid, at, tallies = byte_class("solid"), None, None

        def handed():
            for kind, tally in enumerate(tallies):
                k, n, m = tally.merge()
                for lo in range(0, len(k), 1 << 17):
                    part = slice(lo, lo + (1 << 17))
                    size = len(k[part])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(size, at, np.int32)), pa.array(np.full(size, kind, np.int32)), pa.array(k[part].view(np.int64)), pa.array(n[part]), pa.array(m[part])],
                        ["bucket", "kind", "key", "n", "aside"],
                    )

        for batch in batches:
            for part in _slices_of(batch, "bucket"):
                here = part.column("bucket")[0].as_py()
                if here != at:
                    if at is not None:
                        yield from handed()
                    at, tallies = here, (_Tally(), _Tally())
                buf, off = text_bytes(part.column("text"))
                weights = [part.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("learn", "aside")]
                for lo, hi in doc_slices(off, PIECE):
                    w = Words(buf, off[lo : hi + 1], solid)
                    tallies[WORD].add(w.hash, *(np.repeat(x[lo:hi], np.diff(w.bound)) for x in weights))
                for lo, hi, packed, begin in pieces(buf, off, order):
                    tallies[RUN].add(packed, *(np.repeat(x[lo:hi], np.diff(begin)) for x in weights))
                pa.default_memory_pool().release_unused()
        if at is not None:
            yield from handed()

    dealt = _dealt(docs.select("bucket", "learn", (F.col("learn") & set_aside()).alias("aside"), "text"), buckets)
    return dealt.mapInArrow(different, "bucket int, kind int, key long, n long, aside long")


def set_aside():
    """The eighth of the texts on which discounts are estimated."""
    return F.pmod(F.xxhash64("text", "doc_id"), F.lit(8)) == 0


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", learn=None, order: int = ORDER, added: float = 0.1, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Learn from the rows where ``learn`` (a column expression; default: all) holds and score all whole texts.

    ``doc_id, learn, n_tokens, n_known, train_tokens, base_score, score``, one
    row per row. ``order`` is from 3 to 6.
    """
    if not NEAR <= order <= 6:
        raise ValueError("order is from 3 to 6")
    learn = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))
    docs = docs.select(F.col(doc_id).alias("doc_id"), text_column(text).alias("text"), learn.alias("learn"))
    kind_id = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length("text")), F.count(F.when(F.col("learn"), 1))).first()
    buckets, ends = max(1, -(-(size[0] or 0) // bucket_bytes)), size[1]
    docs = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int"))
    asked = settle(_asked(docs, order, buckets), "asked")
    totals = settle(asked.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("aside").alias("aside")), "totals")
    words, all_runs = totals.filter(F.col("kind") == WORD), totals.filter(F.col("kind") == RUN).select(F.col("key").alias("run"), "n", "aside")
    got = words.filter("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    different, total = got[0] + (ends > 0), (got[1] or 0) + ends
    scores = run_scores(all_runs, order)
    scored = scores.select(F.lit(RUN).alias("kind"), F.col("run").alias("key"), F.col("score").alias("value"))
    values = words.select("kind", "key", F.col("n").cast("double").alias("value")).unionAll(scored)
    answers = asked.select("bucket", "kind", "key").join(values, ["kind", "key"])

    def score(batches):
        solid, whole = byte_class("solid"), total + added * (different + 1)
        last = np.log10((ends + added) / whole)
        at, known, pile = None, None, None
        for batch in batches:
            for part in _slices_of(batch, "bucket", "kind"):
                here, kind = part.column("bucket")[0].as_py(), part.column("kind")[0].as_py()
                if here != at:
                    at, known, pile = here, None, ([], [])
                if kind < 2:
                    pile[kind].append((part.column("key").to_numpy().view(_U).copy(), part.column("value").to_numpy().copy()))  # not the whole batch
                    continue
                if known is None:
                    known = []
                    for own in pile:
                        k, v = (np.concatenate([np.zeros(0, t), *(x[i] for x in own)]) for i, t in enumerate((_U, np.float64)))
                        own.clear()
                        rank = np.argsort(k)
                        known.append((k[rank], v[rank]))
                    del k, v, rank
                    pa.default_memory_pool().release_unused()
                buf, off = text_bytes(part.column("text"))
                tokens, seen_in, base, model = [], [], [], np.zeros(part.num_rows)
                for lo, hi in doc_slices(off, PIECE):
                    w = Words(buf, off[lo : hi + 1], solid)
                    where, there = _found(known[WORD][0], w.hash)
                    c = np.where(there, known[WORD][1][where], 0.0) if len(w.hash) else np.zeros(0)
                    logs = np.append(np.log10((c + added) / whole), 0.0)
                    empty = np.diff(w.bound) == 0
                    seen = np.append(0, np.cumsum(c > 0))
                    tokens.append(np.diff(w.bound) + 1)
                    seen_in.append(seen[w.bound[1:]] - seen[w.bound[:-1]] + (ends > 0))
                    base.append(np.where(empty, 0.0, np.add.reduceat(logs, w.bound[:-1])) + last)
                for lo, hi, packed, begin in pieces(buf, off, order):
                    distinct, code = _different(packed)
                    slot = np.searchsorted(known[RUN][0], distinct)  # all are there: the bucket asked for them
                    model[lo:hi] += np.add.reduceat(known[RUN][1][slot][code], begin[:-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("learn"),
                        pa.array(np.concatenate(tokens)),
                        pa.array(np.concatenate(seen_in)),
                        pa.array(np.full(part.num_rows, total)),
                        pa.array(np.concatenate(base)),
                        pa.array(model),
                    ],
                    ["doc_id", "learn", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    none = lambda kind: F.lit(None).cast(kind)
    given = answers.select("bucket", "kind", none(kind_id).alias("doc_id"), none("string").alias("text"), none("boolean").alias("learn"), "key", "value")
    texts = docs.select("bucket", F.lit(2).alias("kind"), "doc_id", "text", "learn", none("long").alias("key"), none("double").alias("value"))
    dealt = _dealt(given.unionAll(texts), buckets, "kind")
    out = settle(dealt.mapInArrow(score, f"doc_id {kind_id}, learn boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "scores")
    forget(asked, totals, scores)
    return out


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from training: crc32 of the id is 0 modulo 10."""
    return F.pmod(crc_of(doc_id), F.lit(10)) == 0
