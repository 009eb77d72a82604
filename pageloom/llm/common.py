"""Pieces that several training-data operators share.

* :func:`settle` cuts lineage by writing a table into the folder that
  ``spark.checkpoint.dir`` names, so that a lost executor costs a reread and
  never a recomputation of everything before it.
* :class:`Words` turns the UTF-8 bytes of an Arrow column into word positions
  and 64-bit word hashes with a handful of array passes, no Python per word.
* :func:`components` labels connected components with alternating star rounds.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text whose per-byte arrays are in memory at one time.
CHUNK = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_own_root: dict[str, str] = {}


# ---------------------------------------------------------------- storage


def shared_root(spark: SparkSession) -> str:
    """A folder of this application inside ``spark.checkpoint.dir``.

    Where the setting is absent only a local master gets a folder of its own;
    a cluster without a shared folder is refused, because executors would not
    see each other's files.
    """
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if app not in _own_root:
            _own_root[app] = tempfile.mkdtemp(prefix="pageloom-")
            atexit.register(_remove_local, _own_root[app])
        base = _own_root[app]
    return f"{base.rstrip('/')}/pageloom-{app}"


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables made by :func:`settle` that no later plan reads."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._settled_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_column(name: str = "text"):
    """The text with null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def crc_of(name: str = "doc_id"):
    """crc32 of the id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shifts and odd multipliers), in place."""
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A random number for each byte.
_NOISE = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))


def byte_class(kind: str) -> np.ndarray:
    """``letters``: 0-9, A-Z, a-z and all from code point 0x80 on; ``solid``: all but ASCII white space."""
    out = np.zeros(256, dtype=bool)
    if kind == "letters":
        out[48:58] = out[65:91] = out[97:123] = out[128:] = True
    else:
        out[:] = True
        out[[9, 10, 11, 12, 13, 32]] = False
    return out


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, off


class Words:
    """Words of consecutive documents: byte spans, hashes, and the range of words of each document."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, kind: np.ndarray):
        starts, ends, hashes = [], [], []
        at, last = int(off[0]), int(off[-1])
        while at < last:
            to = self._cut(buf, off, kind, at, last)
            s, e, h = self._piece(buf[at:to], off[np.searchsorted(off, at, "left") : np.searchsorted(off, to, "right")] - at, kind)
            starts.append(s + at)
            ends.append(e + at)
            hashes.append(h)
            at = to
        self.start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, _U)
        self.bound = np.searchsorted(self.start, off, "left")
        self.buf = buf

    @staticmethod
    def _cut(buf, off, kind, at, last) -> int:
        """Where a piece that starts at ``at`` may end without splitting a word."""
        to = min(at + CHUNK, last)
        if to == last:
            return to
        whole = off[np.searchsorted(off, to, "right") - 1]
        if whole > at:
            return int(whole)
        gaps = np.flatnonzero(~kind[buf[at:to]])
        if len(gaps):
            return at + int(gaps[-1]) + 1
        step = to
        while step < last:  # one word longer than a piece
            gaps = np.flatnonzero(~kind[buf[step : step + CHUNK]])
            if len(gaps):
                return min(step + int(gaps[0]) + 1, int(off[np.searchsorted(off, to, "left")]))
            step += CHUNK
        return int(off[np.searchsorted(off, to, "left")])

    @staticmethod
    def _piece(b, edges, kind):
        inside = kind[b]
        before = np.zeros(len(b), dtype=bool)
        before[1:] = inside[:-1]
        before[edges[edges < len(b)]] = False
        start = np.flatnonzero(inside & ~before)
        after = np.zeros(len(b), dtype=bool)
        after[:-1] = inside[1:]
        cut = edges[(edges > 0) & (edges <= len(b))] - 1
        after[cut] = False
        end = np.flatnonzero(inside & ~after) + 1
        if not len(start):
            return start, end, np.zeros(0, _U)
        # A sum over (byte, place in the word), each pair finalised on its own, so that no pattern of bytes cancels out.
        lo = start[0]
        place = np.arange(lo, len(b)) - np.repeat(start, np.diff(np.append(start, len(b))))
        v = mix(_NOISE[_LOWER[b[lo:]]] + place.astype(_U) * _U(0xD1342543DE82EF95))
        v[~inside[lo:]] = 0
        return start, end, mix(np.add.reduceat(v, start - lo) + (end - start).astype(_U))

    def text(self, i: int) -> bytes:
        """Word ``i``, with A-Z in lower case."""
        return _LOWER[self.buf[self.start[i] : self.end[i]]].tobytes()


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words of one array of word hashes (fewer words than ``k``: none)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = h[:n].copy()
    for j in range(1, k):
        out *= _U(_BASE)
        out += h[j : j + n]
    return mix(out)


def short_hash(h: np.ndarray) -> np.ndarray:
    """The one shingle of a text with fewer words than a shingle has."""
    out = np.array([len(h)], dtype=_U)
    for x in h:
        out *= _U(_BASE)
        out += x
    return mix(out)


def doc_slices(off: np.ndarray, limit: int = 4 * CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents that have about ``limit`` bytes, one document at least."""
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi
        lo = hi


# ---------------------------------------------------------------- components


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges (a, b)``: the smallest node of its component.

    Alternating large-star and small-star rounds (each a grouped minimum and a
    join on the node), every round settled in the shared folder. Edges stay at
    most as many as they were; nothing but a pair of sums reaches the driver. The
    result reads a settled table, which :func:`forget` deletes.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    pairs = settle(pairs, "edges")
    state = _state(pairs)
    for _ in range(rounds):
        if not state[0]:
            break
        both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Settled, so that the join has a plain exchange on either side and a node with very many edges can be split.
        least = settle(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(F.col("b").alias("a"), "m", F.col("a").alias("own"))
        star = small.select("a", F.col("m").alias("b")).unionAll(small.select(F.col("own").alias("a"), F.col("m").alias("b")))
        nxt = settle(star.filter("a != b").distinct(), "edges")
        forget(pairs, least)
        pairs, old, state = nxt, state, _state(nxt)
        if state == old:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = roots.unionAll(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    out._settled_at = pairs._settled_at
    return out


def _state(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)
