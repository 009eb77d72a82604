"""Questions to the node table that need no tree: intervals, scores, neighbours, boundaries, votes.

``nodes`` tables come from :func:`pageloom.operators.dom.nodes`. Joins are on the
page (a hash key) with an interval condition, so no page meets another.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.operators.blocks import MIN_BEFORE_CUE, RECOMMENDATION_CUE
from pageloom.plans.review import LABELS, MAX_WINDOW_CHARS, MAX_WINDOW_ENTRIES, NEARBY, OVERLAP, pieces, windows


def within(nodes: DataFrame, roots: DataFrame, how: str = "left_semi") -> DataFrame:
    """Nodes that are (``left_semi``) or are not (``left_anti``) in a subtree of ``roots (page_id, pre, last)``."""
    r = roots.select(F.col("page_id").alias("_page"), F.col("pre").alias("_pre"), F.col("last").alias("_last"))
    return nodes.join(r, (F.col("page_id") == F.col("_page")) & F.col("pre").between(F.col("_pre"), F.col("_last")), how)


def nearest(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Each node with the innermost of ``roots`` around it: ``page_id, pre, root_pre``."""
    r = roots.select(F.col("page_id").alias("_page"), F.col("pre").alias("_pre"), F.col("last").alias("_last"), F.col("depth").alias("_depth"))
    met = nodes.join(r, (F.col("page_id") == F.col("_page")) & F.col("pre").between(F.col("_pre"), F.col("_last")) & (F.col("pre") != F.col("_pre")))
    return met.groupBy("page_id", "pre").agg(F.max_by("_pre", "_depth").alias("root_pre"))


def attribute(name: str):
    return F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))


def has_class(name: str):
    return F.array_contains(F.split(attribute("class"), " "), name)


def tracking():
    """Whether an image is stated to be at most two pixels wide and high (a page's source states no other size)."""
    side = lambda k: F.regexp_extract(attribute(k), r"^\s*(\d{1,9})", 1).try_cast("int")
    return F.coalesce((side("width") > 0) & (side("width") <= 2) & (side("height") > 0) & (side("height") <= 2), F.lit(False))


#: Content selectors in order of trust, as conditions on a node row.
CONTENT = [
    lambda: F.col("tag") == "article",
    lambda: attribute("itemprop") == "articleBody",
    lambda: attribute("role") == "main",
    lambda: F.col("tag") == "main",
    *(lambda c=c: has_class(c) for c in ("article-body", "article-content", "post-content", "entry-content")),
]


def candidate_roots(nodes: DataFrame) -> DataFrame:
    """Candidate roots with the rank of the first selector they match; a page without any has its body, at rank 99."""
    rank = F.when(F.lit(False), 0)
    for n, test in enumerate(CONTENT):
        rank = rank.when(test(), n)
    rank = rank.when(F.col("tag") == "body", 99)
    found = nodes.filter("kind = 'tag'").withColumn("rank", rank).filter("rank is not null")
    best = F.min("rank").over(Window.partitionBy("page_id"))
    return found.withColumn("best", best).filter((F.col("rank") < 99) | (F.col("best") == 99)).select("page_id", "pre", "last", "depth", "rank")


def content_scores(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``page_id, pre, rank, score``: text length, 80 a paragraph, 40 a heading, minus 250 for each noisy element."""
    r = roots.select(F.col("page_id").alias("_page"), F.col("pre").alias("root"), F.col("last").alias("_last"), "rank")
    inside = nodes.join(r, (F.col("page_id") == F.col("_page")) & (F.col("pre") > F.col("root")) & (F.col("pre") <= F.col("_last")))
    words = F.trim(F.regexp_replace("text", r"(?U)[\s\x1c-\x1f]+", " "))
    shown = F.when((F.col("kind") == "text") & ~F.col("hidden") & (F.length(words) > 0), F.length(words))
    noisy = F.col("tag").isin("nav", "footer", "aside") | attribute("class").rlike("recommend|newsletter|subscribe")
    count = lambda c: F.count(F.when((F.col("kind") == "tag") & c, 1))
    text = F.coalesce(F.sum(shown) + F.count(shown) - 1, F.lit(0))
    score = text + 80 * count(F.col("tag") == "p") + 40 * count(F.col("tag").isin("h1", "h2", "h3", "h4")) - 250 * count(noisy)
    return inside.groupBy("page_id", F.col("root").alias("pre"), "rank").agg(score.cast("long").alias("score"))


def best_roots(scores: DataFrame) -> DataFrame:
    """The root with the highest score of each page; of equals the one with the lower rank, then the earlier."""
    return scores.groupBy("page_id").agg(F.max_by(F.struct("pre", "score"), F.struct("score", -F.col("rank"), -F.col("pre"))).alias("b")).select("page_id", "b.pre", "b.score")


def common_ancestor(nodes: DataFrame, kept: DataFrame) -> DataFrame:
    """The innermost element of each page that holds all ``kept (page_id, pre)``: ``page_id, root``."""
    span = kept.groupBy(F.col("page_id").alias("_page")).agg(F.min("pre").alias("lo"), F.max("pre").alias("hi"))
    holds = nodes.filter("kind = 'tag'").join(span, (F.col("page_id") == F.col("_page")) & (F.col("pre") < F.col("lo")) & (F.col("last") >= F.col("hi")))
    return holds.groupBy("page_id").agg(F.max_by("pre", "depth").alias("root"))


def visible_text(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``page_id, root, text``: the text of each root in source order."""
    r = roots.select(F.col("page_id").alias("_page"), F.col("pre").alias("root"), F.col("last").alias("_last"))
    shown = nodes.filter("kind = 'text' and not hidden").withColumn("t", F.trim(F.regexp_replace("text", r"(?U)[\s\x1c-\x1f]+", " "))).filter("t <> ''")
    met = shown.join(r, (F.col("page_id") == F.col("_page")) & F.col("pre").between(F.col("root"), F.col("_last")))
    parts = F.array_sort(F.collect_list(F.struct("pre", "t")))
    return met.groupBy("page_id", "root").agg(F.array_join(F.transform(parts, lambda s: s["t"]), " ").alias("text"))


def scrubbed(nodes: DataFrame) -> DataFrame:
    """Node rows of an inert snapshot: no scripts (but JSON-LD), styles, forms, SVG and tracking images, no event handlers; ``src`` kept under a private name."""
    active = ("style", "noscript", "form", "input", "textarea", "button", "svg", "source", "iframe", "object", "embed")
    gone = nodes.filter("kind = 'tag'").filter(F.col("tag").isin(*active) | ((F.col("tag") == "script") & (attribute("type") != "application/ld+json")) | ((F.col("tag") == "img") & tracking()))
    kept = within(nodes, gone.select("page_id", "pre", "last"), "left_anti")
    quiet = F.map_filter("attrs", lambda k, v: ~k.rlike("(?i)^on") & (k != "srcset"))
    return kept.withColumn("attrs", F.transform_keys(quiet, lambda k, v: F.when((F.col("tag") == "img") & (k == "src"), "data-source").otherwise(k)))


def greedy_windows(rows: DataFrame, key: str, sizes: str, max_chars: int = MAX_WINDOW_CHARS, max_entries: int = MAX_WINDOW_ENTRIES, overlap: int = OVERLAP) -> DataFrame:
    """``key, w, st, en`` (all from 1, both ends included) for an array column of entry sizes. Packing is sequential, so it runs per row in Arrow batches."""
    kind = rows.schema[key].dataType.simpleString()

    def pack(batches):
        for batch in batches:
            at, w, st, en = [], [], [], []
            for i, entry in enumerate(batch.column(sizes).to_pylist()):
                for n, (a, b) in enumerate(windows(entry or [], max_chars, max_entries, overlap), 1):
                    at.append(i), w.append(n), st.append(a + 1), en.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (w, st, en))], [key, "w", "st", "en"])

    return rows.select(key, sizes).mapInArrow(pack, f"{key} {kind}, w long, st long, en long")


def split_pieces(rows: DataFrame, key: str, text: str, limit: int = 6000) -> DataFrame:
    """``key, part, piece``: texts in parts of at most ``limit`` characters."""
    kind = rows.schema[key].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            at, part, out = [], [], []
            for i, t in enumerate(batch.column(text).to_pylist()):
                for n, p in enumerate(pieces(t or "", limit), 1):
                    at.append(i), part.append(n), out.append(p)
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int64())), pa.array(part, pa.int64()), pa.array(out, pa.string())], [key, "part", "piece"])

    return rows.select(key, text).mapInArrow(cut, f"{key} {kind}, part long, piece string")


def nearby(blocks: DataFrame, key: str, order: str, tag: str, text: str, fixed: str | None = None, n: int = NEARBY) -> DataFrame:
    """Adds ``nearby``: the beginnings of the blocks before and after, without those that are decided."""
    w = Window.partitionBy(key).orderBy(order)
    said = F.concat(F.col(tag), F.lit(": "), F.left(F.col(text), F.lit(n)))
    said = F.when(~F.col(fixed), said) if fixed else said
    return blocks.withColumn("_said", said).withColumn("nearby", F.concat_ws(" ", F.lag("_said").over(w), F.lead("_said").over(w))).drop("_said")


def cue_boundaries(blocks: DataFrame, key: str, order: str, text: str, kept: str | None = None, cue: str = RECOMMENDATION_CUE.pattern) -> DataFrame:
    """``key, boundary``: the first block that starts with a cue after 100 kept characters (null: none)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    size = F.length(text) if kept is None else F.when(F.col(kept), F.length(text)).otherwise(0)
    seen = blocks.withColumn("_before", F.coalesce(F.sum(size).over(w), F.lit(0)))
    found = F.col(text).rlike(f"(?i){cue}")
    return seen.groupBy(key).agg(F.min(F.when((F.col("_before") >= MIN_BEFORE_CUE) & found, F.col(order))).alias("boundary"))


def resolved_votes(votes: DataFrame, key: list[str], label: str) -> DataFrame:
    """The label of each key by precedence; votes that are no label don't count, no vote is noise."""
    rank = F.when(F.lit(False), 0)
    for n, name in enumerate(LABELS):
        rank = rank.when(F.col(label) == name, n)
    best = votes.groupBy(*key).agg(F.min(rank).alias("_rank"))
    return best.select(*key, F.coalesce(F.element_at(F.array(*map(F.lit, LABELS)), F.col("_rank") + 1), F.lit("noise")).alias("label"))


def same_keys(asked: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """``key, complete``: whether the ids of an answer are exactly those that were asked (``id`` in both)."""
    a = asked.groupBy(key).agg(F.array_sort(F.collect_set("id")).alias("_asked"))
    g = given.groupBy(key).agg(F.array_sort(F.collect_set("id")).alias("_given"))
    return a.join(g, key, "left").select(key, F.coalesce(F.col("_asked") == F.col("_given"), F.lit(False)).alias("complete"))
