"""Inputs: saved pages, captures, lists of addresses, inline images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.functions.urls import MAX_URL
from pageloom.operators.dom import MAX_PAGE_BYTES

ALLOWANCE = 65536
MAX_LIST = 1000
CAPTURE = "title string, author string, sourceUrl string, html string, publishedDate string"
# Image types of a package and their file endings.
IMAGE_TYPES = {"image/gif": ".gif", "image/jpeg": ".jpg", "image/png": ".png", "image/svg+xml": ".svg", "image/webp": ".webp"}
MAX_IMAGE_BYTES, MAX_IMAGES_BYTES = 5 * 1024 * 1024, 50 * 1024 * 1024


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A table of saved pages: ``page_id, url, html``."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def read_saved(spark: SparkSession, path: str) -> DataFrame:
    """Saved HTML files: ``path, html, error``. UTF-8 with an optional byte order mark; too large or undecodable files have an error."""
    files = spark.read.format("binaryFile").load(path)
    limit = MAX_PAGE_BYTES + ALLOWANCE
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    error = F.when(F.col("length") > limit, "Saved input exceeds the 10 MiB limit plus allowance.").when(~valid, "Saved input must be UTF-8.")
    return files.select("path", F.when(error.isNull(), F.regexp_replace(text, "^\\uFEFF", "")).alias("html"), error.alias("error"))


def captures(rows: DataFrame, json: str = "json") -> DataFrame:
    """Validate article captures (one JSON object per row): the columns of ``CAPTURE`` and ``error``; other keys are ignored."""
    got = rows.withColumn("c", F.from_json(json, CAPTURE))
    strings = F.lit(True)
    for name in ("title", "author", "sourceUrl", "html"):
        strings = strings & F.coalesce(F.trim(F.col(f"c.{name}")) != "", F.lit(False)) & F.coalesce(F.expr(f"schema_of_variant(try_variant_get(try_parse_json({json}), '$.{name}', 'variant')) = 'STRING'"), F.lit(False))
    date = F.col("c.publishedDate")
    given = F.expr(f"schema_of_variant(try_variant_get(try_parse_json({json}), '$.publishedDate', 'variant'))")
    missing = date.isNull() & (given.isNull() | (given == "VOID"))
    error = (
        F.when(~strings, "A capture requires non-empty string title, author, sourceUrl, and html fields.")
        .when(F.octet_length("c.html") > MAX_PAGE_BYTES, "Capture HTML exceeds 10 MiB.")
        .when(~missing & ((given != "STRING") | ~date.rlike(r"^\d{4}-\d{2}-\d{2}$")), "Capture publishedDate must use YYYY-MM-DD format.")
        .when(~missing & F.try_to_date(date, "yyyy-MM-dd").isNull(), "Capture publishedDate is not a valid calendar date.")
    )
    return got.withColumn("error", error).select(*(c for c in rows.columns if c != json), "c.title", "c.author", "c.sourceUrl", "c.html", date.alias("publishedDate"), "error")


def url_list(lines: DataFrame, order: str = "line_no", line: str = "line") -> DataFrame:
    """Different addresses of a list in order of their first line: ``position, url, error``.

    Blank lines and comments are skipped. An address over the length limit is an
    error, and so is every address after the thousandth, which has no position;
    both are rows, not exceptions.
    """
    url = F.regexp_replace(F.col(line), r"^(?U)\s+|(?U)\s+$", "")
    kept = lines.select(F.col(order).alias("line_no"), url.alias("url")).filter((F.col("url") != "") & ~F.col("url").startswith("#"))
    first = kept.groupBy("url").agg(F.min("line_no").alias("line_no"))
    # Only the first thousand have a position, so only they, a top-k, are numbered in one place.
    place = F.row_number().over(Window.orderBy("line_no", "url"))
    listed = first.orderBy("line_no", "url").limit(MAX_LIST).withColumn("position", place).select(F.col("url").alias("_url"), "position")
    late = F.col("position").isNull()
    error = F.when(F.length("url") > MAX_URL, f"Batch URL exceeds the {MAX_URL}-character limit.").when(late, f"Batch input exceeds {MAX_LIST} unique articles.")
    return first.join(F.broadcast(listed), F.col("url") == F.col("_url"), "left").select("position", "url", error.alias("error"))


def inline_image(source) -> tuple:
    """Media type and bytes of a ``data:image/`` address (bytes null if they can't be decoded, or for other addresses)."""
    head = F.regexp_extract(source, r"^data:([^,]*),", 1)
    body = F.regexp_extract(source, r"^data:[^,]*,(?s)(.*)$", 1)
    kind = F.split_part(head, F.lit(";"), F.lit(1))
    coded = F.when(F.length(body) % 4 == 0, F.when(body.rlike(r"^[A-Za-z0-9+/]*={0,2}$"), F.try_to_binary(body, F.lit("base64"))))
    plain = F.try_url_decode(F.replace(body, F.lit("+"), F.lit("%2B"))).cast("binary")
    data = F.when(source.startswith("data:image/"), F.when(head.contains(";base64"), coded).otherwise(plain))
    return kind, data


def budgeted(images: DataFrame, page_id: str = "page_id", order: str = "seq", size: str = "size") -> DataFrame:
    """Which images of a page fit: each at most 5 MiB, all together 50 MiB, greedily in order (a later smaller one may still fit)."""
    listed = images.groupBy(page_id).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("n")))).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<struct<o:long,fits:boolean>>").alias("out"))

    def step(acc, s):
        fits = (s["n"] <= MAX_IMAGE_BYTES) & (acc["total"] + s["n"] <= MAX_IMAGES_BYTES)
        return F.struct((acc["total"] + F.when(fits, s["n"]).otherwise(F.lit(0).cast("long"))).alias("total"), F.concat(acc["out"], F.array(F.struct(s["o"].cast("long").alias("o"), fits.alias("fits")))).alias("out"))

    return listed.select(page_id, F.explode(F.aggregate("all", start, step)["out"]).alias("x")).select(page_id, F.col("x.o").alias(order), F.col("x.fits").alias("fits"))
