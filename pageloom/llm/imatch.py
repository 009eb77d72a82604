"""I-Match document fingerprints, with DataFrame functions only.

The lexicon holds the terms whose document share lies in ``[low, high]`` (an
inverse-document-frequency band), counted over all documents. It has at most
(mean distinct terms of a document) / ``low`` terms, however many documents
there are, which is why it may be broadcast. Each of ``LEXICONS`` randomised
subsets keeps a term if two digits of the term's md5 are below ``KEEP``. A
component of a fingerprint is the md5 of the sorted distinct terms that the
text has of one subset, or empty; a text without any term of the subsets has
the md5 of itself as its only component. Likeness is the share of equal components
among those that either text has.

Texts are dealt once, by ranges of ids, with one ghost row per range (the first
row of the next one), so the next document is a neighbour in the same range and
everything after that shuffle stays in place: windows, the broadcast join and
the grouping by row all use the same partitioning. The ranges end at quantiles of
the ids, so they hold about as many rows wherever the ids lie; an id that fills
several ranges (or the rows without an id) is spread over them by a hash of the text.

Edge cases: null text is empty; a null id comes last in descending order; rows
with equal ids are ordered by a hash of their text, then by text; repeated rows
are documents of their own; a very long text has as many terms as it has
different words; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import text_column

LOW, HIGH = 0.01, 0.2
LEXICONS, KEEP = 16, "03"
RANGE_BYTES, MOST_RANGES = 4 << 20, 65_536
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def terms(text):
    """Distinct lower-case words."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), SEPARATORS)), "")


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH, lexicons: int = LEXICONS, keep: str = KEEP) -> DataFrame:
    """Terms of the band over all documents that any subset keeps: ``term, subsets`` (their numbers)."""
    total = docs.count()
    # explode_outer: a plain one has the array computed a second time, for an inferred filter on its size.
    counts = docs.select(F.explode_outer(terms(F.col("text"))).alias("term")).filter("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    band = counts.filter((F.col("df") >= low * total) & (F.col("df") <= high * total))
    # Made to depend on the count, so that the last filter is not moved below the aggregate and run for every word.
    digest = F.array(F.when(F.col("df") > 0, F.md5("term")))
    numbers = F.sequence(F.lit(0), F.lit(lexicons - 1))
    kept = F.transform(digest, lambda d: F.filter(numbers, lambda n: F.substring(d, 2 * n + 1, F.lit(2)) < keep))[0]
    return band.select("term", kept.alias("subsets")).filter(F.size("subsets") > 0)


def _ranged(docs: DataFrame) -> DataFrame:
    """Adds ``hash`` and ``range``, which does not fall as (id, hash) rises; null ids are the lowest."""
    size, n, null = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1)), F.count(F.when(F.col("doc_id").isNull(), 1))).first()
    ranges = int(min(MOST_RANGES, max(1, -(-(size or 0) // RANGE_BYTES))))
    array = lambda xs, kind: F.from_json(F.lit(json.dumps(xs)), f"array<{kind}>")
    bounds = []
    if ranges > 1 and n > null:
        cuts = F.percentile_approx("doc_id", array([x / ranges for x in range(1, ranges)], "double"), 4 * ranges)
        bounds = docs.agg(cuts.alias("cuts")).first()["cuts"] or []  # fewer than MOST_RANGES numbers
    # A bound that is there several times is an id that fills several ranges.
    often = Counter(bounds)
    kinds = sorted(often)
    parts = [max(1, -(-ranges * null // max(1, n))), *(often[b] for b in kinds)]
    begin = [0]
    for p in parts:
        begin.append(begin[-1] + p + 1)
    at = F.lit(0)
    if kinds:  # the number of bounds at or below the id, by binary search
        steps = [1 << x for x in reversed(range(len(kinds).bit_length()))]
        known = array(kinds, "bigint")
        below = lambda acc, step: (acc + step <= len(kinds)) & (F.try_element_at(known, acc + step) <= F.col("doc_id"))
        at = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda acc, step: F.when(below(acc, step), acc + step).otherwise(acc))
    docs = docs.withColumn("hash", F.xxhash64("text")).withColumn("_at", at)
    share = F.col("hash").cast("double") / 2.0**64 + 0.5
    of = lambda xs, kind="int": F.element_at(array(xs, kind), F.col("_at") + 1)
    hot = (of([0, *kinds], "bigint") == F.col("doc_id")) & (F.col("_at") > 0) & (of(parts) > 1)
    sub = lambda many: F.least(F.floor(share * many), many - 1)
    known = F.when(hot, of(begin) + sub(of(parts))).otherwise(of(begin) + of(parts))
    return docs.withColumn("range", F.when(F.col("doc_id").isNull(), sub(F.lit(parts[0]))).otherwise(known).cast("int")).drop("_at")


def _neighbours(docs: DataFrame) -> DataFrame:
    """``range, place, ghost, doc_id, text, next_text`` in descending order of ids; ghosts close each range."""
    docs = _ranged(docs)
    # The first row of each range, at most 2 * MOST_RANGES + 2 of them, and the range above it that needs it.
    firsts = docs.groupBy("range").agg(F.max(F.struct("doc_id", "hash")).alias("first"))
    order = Window.orderBy("range")  # of a row for each range
    to = F.coalesce(F.lead("range").over(order), F.min("range").over(order))
    ghosts = firsts.select(F.col("range").alias("_range"), F.col("first.doc_id").alias("_id"), F.col("first.hash").alias("_hash"), to.alias("_to"))
    found = docs.join(F.broadcast(ghosts), (F.col("range") == F.col("_range")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")))
    extra = found.groupBy(F.col("_to").alias("range")).agg(F.max("doc_id").alias("doc_id"), F.max("hash").alias("hash"), F.max("text").alias("text"))
    both = docs.select("doc_id", "hash", "text", "range", F.lit(False).alias("ghost")).unionAll(extra.select("doc_id", "hash", "text", "range", F.lit(True)))
    order = Window.partitionBy("range").orderBy("ghost", F.col("doc_id").desc_nulls_last(), F.col("hash").desc(), F.col("text").desc())
    return both.select("range", F.row_number().over(order).alias("place"), "ghost", "doc_id", "text", F.lead("text").over(order).alias("next_text"))


def edited(text, next_text):
    """The last third replaced by as many first code points of the next text (or all of them)."""
    n = F.char_length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.left(text, n - third), F.left(next_text, third))


def likeness(x, y):
    """Share of equal components among those that either has."""
    pairs = F.arrays_zip(F.split(x, r"\.").alias("x"), F.split(y, r"\.").alias("y"))
    either = F.size(F.filter(pairs, lambda p: (p["x"] != "") | (p["y"] != "")))
    same = F.size(F.filter(pairs, lambda p: (p["x"] != "") & (p["x"] == p["y"])))
    return same / either


def components(found, lexicons: int = LEXICONS):
    """The terms of each subset, sorted and joined, from a sorted array of ``(term, subsets)``."""
    own = lambda n: F.filter(found, lambda t: F.array_contains(t["subsets"], n))
    return F.transform(F.sequence(F.lit(0), F.lit(lexicons - 1)), lambda n: F.array_join(F.transform(own(n), lambda t: t["term"]), " "))


def fingerprint(joined, whole, lexicons: int = LEXICONS):
    """Components from joined terms; ``whole``: what stands for a text without any."""
    parts = F.array_join(F.transform(joined, lambda t: F.when(t == "", "").otherwise(F.left(F.md5(t), F.lit(8)))), ".")
    # Drops the text's own md5 unless nothing but dots follows.
    return F.regexp_replace(F.concat(whole, F.lit("#"), parts), rf"^[0-9a-f]*#(?!\.{{{lexicons - 1}}}$)|#", "")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``, one row per row."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_column(text).alias("text"))
    # An entry with an empty term keeps every text in the join below.
    words = lexicon(docs, low, high).unionAll(docs.sparkSession.range(1).select(F.lit("").alias("term"), F.array().cast("array<int>").alias("subsets")))
    near = _neighbours(docs).withColumn("edited", edited(F.col("text"), F.coalesce("next_text", F.lit(""))))
    texts = near.select(
        "range", "place", "ghost", "doc_id", F.char_length("text").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.explode_outer(
            F.array(
                F.struct(F.lit(False).alias("is_edited"), F.md5("text").alias("whole"), F.concat(F.array(F.lit("")), terms(F.col("text"))).alias("terms")),
                F.struct(F.lit(True).alias("is_edited"), F.md5("edited").alias("whole"), F.concat(F.array(F.lit("")), terms(F.col("edited"))).alias("terms")),
            )
        ).alias("t"),
    )
    # Flat columns first: an exploded row must not carry the array that it comes from.
    flat = texts.select("range", "place", "ghost", "doc_id", "n_chars", "edited_sha256", "t.is_edited", "t.whole", "t.terms")
    each = flat.select("range", "place", "ghost", "doc_id", "n_chars", "edited_sha256", "is_edited", "whole", F.explode_outer("terms").alias("term"))
    kept = each.join(F.broadcast(words), "term")
    entry = F.when(F.col("term") != "", F.struct("term", "subsets"))
    collected = lambda flag: F.collect_list(F.when(F.col("is_edited") == flag, entry))
    whole = lambda flag: F.max(F.when(F.col("is_edited") == flag, F.col("whole")))
    rows = kept.groupBy("range", "place").agg(
        F.first("ghost").alias("ghost"), F.first("doc_id").alias("doc_id"), F.first("n_chars").alias("n_chars"), F.first("edited_sha256").alias("edited_sha256"),
        collected(False).alias("own"), collected(True).alias("changed"), whole(False).alias("whole"), whole(True).alias("whole_edited"),
    )
    # One projection for each step, so that none is evaluated more than once.
    kept_columns = ["range", "place", "ghost", "doc_id", "n_chars", "edited_sha256", "whole", "whole_edited"]
    ordered = rows.select(*kept_columns, F.sort_array("own").alias("own"), F.sort_array("changed").alias("changed"))
    joined = ordered.select(*kept_columns, components(F.col("own")).alias("own"), components(F.col("changed")).alias("changed"))
    marked = joined.select(*kept_columns[:6], fingerprint(F.col("own"), F.col("whole")).alias("fingerprint"), fingerprint(F.col("changed"), F.col("whole_edited")).alias("edited_fingerprint"))
    follows = F.lead("fingerprint").over(Window.partitionBy("range").orderBy("place"))
    return marked.withColumn("next", follows).filter("not ghost").select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next")).alias("near_next"),
    )
