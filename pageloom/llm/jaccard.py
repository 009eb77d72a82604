"""N-gram Jaccard join with Bayesian candidate pruning.

A document is the set of its runs of five words. Documents with equal sets are
one *node* from the start, whatever their number. Then

1. every node gets ``BANDS * ROWS`` MinHash values; nodes that agree on all
   values of a band are tied to the smallest node of that band (a star: as many
   rows as members, never all pairs);
2. ties are pruned by comparing MinHash values in steps and dropping a tie as
   soon as the posterior probability that its similarity reaches the threshold
   falls below ``tolerance``. A node takes the smallest node that it is still
   tied to as its label (and that one's label). Members of one band that have
   different labels are then compared with each other, all pairs, in blocks of at
   most ``band_block`` nodes, with the same pruning: a pair must not be lost
   because the smallest node of its bands is unlike either;
3. components of all ties that survive are candidate groups. Groups are cut into
   blocks of about ``block`` nodes and 2 ** 20 shingles and each pair of blocks
   is one unit of work, so a large group is spread over many tasks; inside a
   unit all pairs pass the same Bayesian pruning and the rest is verified exactly
   on the shingle sets. A unit returns one row per node (a count and a parent),
   not its pairs. A set is sent once for each block of its group;
4. components of the verified links are the classes; a group of one block has
   them from its unit.

At similarity 0.8, ``32`` bands of ``6`` values miss a pair with probability
0.00006, at 0.85 with 0.0000003.

A similarity of 0.8 on five-word runs allows one changed word in 45, evenly
spread; copies with more edits than that are not linked.

Edge cases: an empty table gives an empty result; extra columns are ignored, in
:func:`one_of_each` carried; a very long text is one set, compared like any other
(equal similarities need no order, links are counted and not ranked); fewer than five words make one shingle; a text without words (also
null or empty) equals only texts that are the same string, null counting as
empty; repeated rows share a class; rows with a null id take part and their
class id is the smallest id that is not null, if there is one.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import Words, byte_class, components, doc_slices, forget, mix, settle, shingle_hashes, short_hash, text_bytes, text_column

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 6
TOLERANCE = 1e-6
BLOCK, BLOCK_SHINGLES, BAND_BLOCK = 512, 1 << 20, 4096
_U = np.uint64
_ROW, _KEPT = "__row_of_jaccard", "__kept_by_jaccard"


def _permutations(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x632BE59BD9B4E019)) | _U(1)


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingles of one document's word hashes."""
    if not len(h):
        return h
    return np.unique(shingle_hashes(h, k)) if len(h) >= k else short_hash(h)


def node_key(shingles: np.ndarray, raw: bytes) -> bytes:
    """16 bytes that stand for the set; of a text without words, for the text."""
    return hashlib.md5(shingles.tobytes() if len(shingles) else b"text:" + raw, usedforsecurity=False).digest()


def min_hashes(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """One 32-bit MinHash value for each multiplier."""
    out = np.full(len(multipliers), np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        for m in range(0, len(multipliers), 32):
            low = ((part[None, :] * multipliers[m : m + 32, None]) >> _U(32)).min(axis=1).astype(np.uint32)
            np.minimum(out[m : m + 32], low, out=out[m : m + 32])
    return out


@lru_cache(maxsize=None)
def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The fewest of ``n`` agreeing 8-bit values with which a pair is kept.

    The prior of the similarity is uniform; 8-bit values of different MinHashes
    agree once in 256. The posterior is integrated on a grid.
    """
    j = (np.arange(20000) + 0.5) / 20000
    agree = j + (1 - j) / 256
    above = j >= threshold
    for m in range(n + 1):
        log = m * np.log(agree) + (n - m) * np.log1p(-agree)
        weight = np.exp(log - log.max())
        if weight[above].sum() >= tolerance * weight.sum():
            return m
    return n + 1


def _steps(n: int) -> list[int]:
    return sorted({32, 64, 96, 128, n} & set(range(1, n + 1)) | {n})


def _sketches(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    kind_id = docs.schema["doc_id"].dataType.simpleString()

    def sketch(batches):
        kind, multipliers = byte_class("letters"), _permutations(bands * rows)
        salt = mix(np.arange(1, bands + 1, dtype=_U))
        for batch in batches:
            buf, off = text_bytes(batch.column("text"))
            nodes, sizes, small, keys = [], [], [], []
            for lo, hi in doc_slices(off):
                words = Words(buf, off[lo : hi + 1], kind)
                for d in range(hi - lo):
                    s = shingle_set(words.hash[words.bound[d] : words.bound[d + 1]], k)
                    nodes.append(node_key(s, buf[off[lo + d] : off[lo + d + 1]].tobytes()))
                    sizes.append(len(s))
                    if not len(s):
                        small.append(b"")
                        keys.append([])
                        continue
                    values = min_hashes(s, multipliers)
                    small.append(values.astype(np.uint8).tobytes())
                    key = salt.copy()
                    for v in values.reshape(bands, rows).T:
                        key *= _U(0x9E3779B97F4A7C15)
                        key += v
                    keys.append(mix(key).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(small, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "row", "node", "n_shingles", "values", "bands"],
            )

    return docs.mapInArrow(sketch, f"doc_id {kind_id}, row long, node binary, n_shingles int, values binary, bands array<long>")


def _pruned(ties: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """``a, b, va, vb`` without the ties whose similarity is too unlikely."""

    def prune(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            width = len(batch.column("va")[0].as_py())
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, width) for c in ("va", "vb"))
            keep = np.arange(batch.num_rows)
            done, same = 0, np.zeros(batch.num_rows, dtype=np.int64)
            for n in _steps(width):
                same[keep] += (x[keep, done:n] == y[keep, done:n]).sum(axis=1)
                keep, done = keep[same[keep] >= least_matches(n, threshold, tolerance)], n
            yield batch.select(["a", "b"]).take(pa.array(keep))

    return ties.mapInArrow(prune, "a binary, b binary")


class _Forest:
    """Union-find over the rows of one unit."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)


def _across(members: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Ties ``a, b`` between nodes of different groups in each unit ``(band, i, j)``: a spanning forest of the likely ones."""

    def compare(t: pa.Table) -> pa.Table:
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        t = t.sort_by("node")
        nodes, block = t.column("node").to_pylist(), t.column("block").to_numpy()
        group = np.unique(np.array([r.hex() for r in t.column("root").to_pylist()]), return_inverse=True)[1]
        values = np.frombuffer(b"".join(t.column("values").to_pylist()), np.uint8).reshape(len(nodes), -1)
        forest = _Forest(len(nodes))
        left, right = (np.flatnonzero(block == x) for x in (i, j))
        for at in range(0, len(left), 64):  # so many rows of pairs at a time
            x = left[at : at + 64]
            wanted = group[x][:, None] != group[right][None, :]
            if i == j:
                wanted &= x[:, None] < right[None, :]
            a, b = np.nonzero(wanted)
            a, b = x[a], right[b]
            done, same = 0, np.zeros(len(a), dtype=np.int64)
            for n in _steps(values.shape[1]):
                same += (values[a, done:n] == values[b, done:n]).sum(axis=1)
                keep = same >= least_matches(n, threshold, tolerance)
                a, b, same, done = a[keep], b[keep], same[keep], n
            for m, o in zip(a.tolist(), b.tolist(), strict=True):
                forest.join(m, o)
        roots = [forest.root(m) for m in range(len(nodes))]
        tied = [m for m, r in enumerate(roots) if m != r]
        return pa.table({"a": pa.array([nodes[m] for m in tied], pa.binary()), "b": pa.array([nodes[roots[m]] for m in tied], pa.binary())})

    return members.groupBy("band", "i", "j").applyInArrow(compare, "a binary, b binary")


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the given pairs of sorted sets."""
    if len(left) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right, strict=True)], dtype=np.int64)
    names, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    rank = np.argsort(code, kind="stable")
    code, owner = code[rank], owner[rank]
    total = np.zeros((len(sets), len(sets)), dtype=np.float64)
    for at in range(0, len(names), 8192):  # a slice of the incidence matrix at a time
        lo, hi = np.searchsorted(code, [at, at + 8192])
        part = np.zeros((len(sets), min(8192, len(names) - at)), dtype=np.float32)
        part[owner[lo:hi], code[lo:hi] - at] = 1
        total += part @ part.T
    return total[left, right].astype(np.int64)


def _verified(members: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Links inside each unit ``(root, i, j)``: per node its links and a linked node that is smaller."""
    limit = Fraction(str(threshold))

    def verify(t: pa.Table) -> pa.Table:
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        t = t.sort_by("node")
        names = t.column("node").to_pylist()
        t = t.take(pa.array([x for x in range(len(names)) if not x or names[x] != names[x - 1]]))
        nodes, block, copies = t.column("node").to_pylist(), t.column("block").to_numpy(), t.column("copies").to_numpy()
        sets = [np.frombuffer(s, _U) for s in t.column("shingles").to_pylist()]
        size = np.array([len(s) for s in sets])
        values = np.frombuffer(b"".join(t.column("values").to_pylist()), np.uint8).reshape(len(nodes), -1)
        a, b = np.triu_indices(len(nodes), 1)
        if i != j:
            across = block[a] != block[b]
            a, b = a[across], b[across]
        fits = np.minimum(size[a], size[b]) * limit.denominator >= limit.numerator * np.maximum(size[a], size[b])
        a, b = a[fits], b[fits]
        done, same = 0, np.zeros(len(a), dtype=np.int64)
        for n in _steps(values.shape[1]):
            same += (values[a, done:n] == values[b, done:n]).sum(axis=1)
            keep = same >= least_matches(n, threshold, tolerance)
            a, b, same, done = a[keep], b[keep], same[keep], n
        both = common_counts(sets, a, b)
        linked = both * limit.denominator >= limit.numerator * (size[a] + size[b] - both)
        a, b = a[linked], b[linked]
        texts = np.bincount(a, minlength=len(nodes)) + np.bincount(b, minlength=len(nodes))
        rows = np.bincount(a, copies[b], len(nodes)) + np.bincount(b, copies[a], len(nodes))
        forest = _Forest(len(nodes))
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            forest.join(x, y)
        some = np.flatnonzero(texts).tolist()
        return pa.table(
            {
                "node": pa.array([nodes[x] for x in some], pa.binary()),
                "texts": pa.array(texts[some], pa.int64()),
                "rows": pa.array(rows[some].astype(np.int64), pa.int64()),
                "parent": pa.array([nodes[forest.root(x)] for x in some], pa.binary()),
                "alone": pa.array([t.column("blocks")[0].as_py() == 1] * len(some), pa.bool_()),
            }
        )

    return members.groupBy("root", "i", "j").applyInArrow(verify, "node binary, texts long, rows long, parent binary, alone boolean")


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
    tolerance: float = TOLERANCE,
    block: int = BLOCK,
    band_block: int = BAND_BLOCK,
) -> DataFrame:
    """One row per document: ``doc_id, class_id, n_links, n_text_links, n_copies, first``.

    ``class_id`` is the smallest id of the class, ``n_links`` the number of
    other documents at or above the threshold (copies included),
    ``n_text_links`` the same counted in different sets, ``n_copies`` the
    documents with this set, ``first`` whether the set is that of ``class_id``.
    """
    out = _classified(docs, F.col(doc_id), text, F.lit(0).cast("long"), shingle, threshold, bands, rows, tolerance, block, band_block)
    return out.select("doc_id", F.col("least.doc_id").alias("class_id"), "n_links", "n_text_links", "n_copies", F.col("own.doc_id").eqNullSafe(F.col("least.doc_id")).alias("first"))


def _classified(docs, doc_id, text, row, shingle, threshold, bands, rows, tolerance, block, band_block) -> DataFrame:
    """``doc_id, row, least, own, n_links, n_text_links, n_copies``: the least document ``(unnamed, doc_id, row)`` of the class and of the set."""
    docs = docs.select(doc_id.alias("doc_id"), text_column(text).alias("text"), row.alias("row"))
    sketch = settle(_sketches(docs, shingle, bands, rows), "sketch")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"))
    count = settle(sketch.groupBy("node").agg(least.alias("own"), F.count(F.lit(1)).alias("copies")), "counts")
    # One sketch for each node that has words.
    one = sketch.filter("n_shingles > 0").dropDuplicates(["node"]).select("node", "n_shingles", "values", "bands")
    nodes = settle(one, "nodes")
    banded = nodes.select("node", F.explode("bands").alias("band"))
    star = banded.groupBy("band").agg(F.min("node").alias("b"), F.max("node").alias("z")).filter("b != z").select("band", "b")
    met = settle(banded.join(star, "band"), "bands")
    ties = met.filter("node != b").select(F.col("node").alias("a"), "b").distinct()
    values = nodes.select("node", "values")
    ties = ties.join(values.toDF("a", "va"), "a").join(values.toDF("b", "vb"), "b")
    labels = settle(_pruned(ties, threshold, tolerance).groupBy("a").agg(F.min("b").alias("root")), "labels")
    above = labels.toDF("root", "top")
    jumped = labels.join(above, "root", "left").select(F.col("a").alias("node"), F.coalesce("top", "root").alias("root"))

    # Bands whose members do not have one label by now; their members meet, block by block.
    of = settle(met.select("band", "node").join(jumped, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root")), "members")
    # Bands with the same members are one.
    kinds = of.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("all")).filter("lo != hi")
    open_ = settle(kinds.groupBy("n", "all").agg(F.min("band").alias("band")).select("band", F.ceil(F.col("n") / F.lit(band_block)).cast("int").alias("blocks")), "open")
    facing = of.join(open_, "band").join(values, "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    facing = facing.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    more = _across(facing.select("band", "i", "j", "block", "node", "root", "values"), threshold, tolerance)
    tied = components(labels.toDF("a", "b").unionAll(more))
    groups = settle(tied, "groups")
    forget(met, of, open_, labels, tied)

    sizes = groups.join(nodes.select("node", "n_shingles"), "node").groupBy("root")
    sizes = sizes.agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(block)), F.ceil(F.sum("n_shingles") / F.lit(BLOCK_SHINGLES))).cast("int").alias("blocks"))
    placed = groups.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    wanted = placed.join(count.select("node", "own.doc_id", "copies"), "node").join(values, "node")
    # Merge joins with the texts at every size: what is wanted grows with the documents.
    pieces = docs.join(wanted.withColumnRenamed("doc_id", "_of").hint("merge"), F.col("doc_id").eqNullSafe(F.col("_of")))
    kind_of = {"node": "binary", "root": "binary", "blocks": "int", "block": "int", "copies": "long", "values": "binary"}

    def sets(batches):
        kind = byte_class("letters")
        for batch in batches:
            buf, off = text_bytes(batch.column("text"))
            keep, out, seen = [], [], set()
            node = batch.column("node").to_pylist()
            for lo, hi in doc_slices(off):
                words = Words(buf, off[lo : hi + 1], kind)
                for d in range(hi - lo):
                    s = shingle_set(words.hash[words.bound[d] : words.bound[d + 1]], shingle)
                    if node[lo + d] not in seen and node_key(s, b"") == node[lo + d]:  # another text may carry the same id
                        seen.add(node[lo + d])
                        keep.append(lo + d)
                        out.append(s.tobytes())
            got = batch.select(list(kind_of)).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*got.columns, pa.array(out, pa.binary())], [*kind_of, "shingles"])

    shingled = pieces.select("text", *kind_of).mapInArrow(sets, ", ".join(f"{k} {v}" for k, v in kind_of.items()) + ", shingles binary")
    once = shingled.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    units = once.select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    found = settle(_verified(units, threshold, tolerance), "links")

    links = found.groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("rows").alias("rows"))
    spread = components(found.filter("not alone").select(F.col("node").alias("a"), F.col("parent").alias("b")))
    classes = spread.unionAll(found.filter("alone").select("node", F.col("parent").alias("root")))
    joined = count.join(classes, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # The class id: a grouped minimum, so a large class is pre-aggregated.
    ids = joined.groupBy("root").agg(F.min("own").alias("least"))
    named = joined.join(ids, "root").select("node", "copies", "texts", "rows", "own", "least")
    out = sketch.select("doc_id", "row", "node").join(named, "node")
    out = out.select(
        "doc_id",
        "row",
        "least",
        "own",
        (F.coalesce("rows", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_text_links"),
        F.col("copies").cast("long").alias("n_copies"),
    )
    out = settle(out, "classes")
    forget(sketch, count, nodes, groups, found, spread)
    return out


def one_of_each(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
    tolerance: float = TOLERANCE,
    block: int = BLOCK,
    band_block: int = BAND_BLOCK,
) -> DataFrame:
    """The documents with one row of each class, the one with the smallest id.

    A row is told from others by its id and a hash of all its columns, so other
    texts under the same id are judged on their own. Rows without an id come
    after all that have one. Of rows that are equal in every column one stays.
    """
    row = F.xxhash64(*(F.col(c) for c in docs.columns))
    found = _classified(docs, F.col(doc_id), text, row, shingle, threshold, bands, rows, tolerance, block, band_block)
    kept = found.groupBy("least").agg(F.count(F.lit(1))).select(F.struct("least.doc_id", "least.row").alias(_KEPT))
    key = F.struct(F.col(doc_id).alias("doc_id"), row.alias("row"))
    marked = docs.withColumn(_ROW, key)
    return marked.join(kept.hint("merge"), F.col(_ROW).eqNullSafe(F.col(_KEPT)), "left_semi").dropDuplicates([_ROW]).drop(_ROW)
