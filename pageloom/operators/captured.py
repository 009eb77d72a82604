"""Images of a captured page on the node table: places, sources, and which are no part of an article."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.operators.relational import attribute, tracking, within

# Fixed value: what the text or the classes of a decorative image say.
DECORATIVE = "avatar|logo|icon|profile|author|tracking|pixel"
SOURCE = "data-source"


def images(nodes: DataFrame) -> DataFrame:
    """``page_id, pre, ordinal, source, decorative, tracking`` of all images; ordinals count from 1 in each page."""
    said = F.concat_ws(" ", attribute("alt"), attribute("class"))
    source = F.coalesce(*(F.nullif(attribute(k), F.lit("")) for k in ("src", "data-src", SOURCE)))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("pre"))
    return nodes.filter("tag = 'img'").select("page_id", "pre", place.alias("ordinal"), source.alias("source"), said.rlike(f"(?i){DECORATIVE}").alias("decorative"), tracking().alias("tracking"))


def paired(clone: DataFrame, page: DataFrame) -> DataFrame:
    """The images of a clone with the sources of the page's, matched by their ordinal (before anything is removed from either).

    ``page_id, pre, ordinal, source``; an image of the clone that the page doesn't have is left out.
    """
    own, of = images(clone).select("page_id", "pre", "ordinal"), images(page).select("page_id", "ordinal", "source")
    return own.join(of, ["page_id", "ordinal"]).select("page_id", "pre", "ordinal", "source")


def without_images(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """Nodes without the given images ``(page_id, pre)``; an image in a ``picture`` takes the innermost with it."""
    at = gone.select(F.col("page_id").alias("_page"), F.col("pre").alias("_pre"))
    frames = nodes.filter("tag = 'picture'").join(at, (F.col("page_id") == F.col("_page")) & F.col("_pre").between(F.col("pre"), F.col("last")))
    held = frames.groupBy("_page", "_pre").agg(F.max_by(F.struct("pre", "last"), "depth").alias("f"))
    alone = nodes.select("page_id", "pre", "last").join(at, (F.col("page_id") == F.col("_page")) & (F.col("pre") == F.col("_pre"))).drop("_page", "_pre")
    spans = alone.unionAll(held.select(F.col("_page").alias("page_id"), F.col("f.pre").alias("pre"), F.col("f.last").alias("last")))
    return within(nodes, spans, "left_anti")


def captured(nodes: DataFrame) -> DataFrame:
    """Nodes of an article as a capture keeps them: without decorative and tracking images."""
    return without_images(nodes, images(nodes).filter("decorative or tracking"))
