"""Validation of requests, settings files, and the package sink."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from pageloom.operators.dom import MAX_PAGE_BYTES

REQUEST = "sourceUrl string, html string, title string, author string, mode string"


def valid_email(c) -> Column:
    """An address that can be mailed: at most 254 characters, a plain local part, a domain with a dot."""
    c = F.col(c) if isinstance(c, str) else c
    atom = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+"
    return F.coalesce((F.length(c) <= 254) & c.rlike(rf"^{atom}(?:\.{atom})*@{atom}(?:\.{atom})+$"), F.lit(False))


def requests(rows: DataFrame, json: str = "json") -> DataFrame:
    """Analysis requests, one JSON object per row: the fields of ``REQUEST`` (the mode is ``standard`` by default) and ``error``."""
    got = rows.withColumn("r", F.from_json(json, REQUEST))
    given = lambda n: F.coalesce(F.length(f"r.{n}"), F.lit(0))
    mode = F.coalesce("r.mode", F.lit("standard"))
    error = (
        F.when(F.col("r").isNull() | (given("sourceUrl") == 0) | (given("html") == 0), "A request requires non-empty sourceUrl and html.")
        .when(given("title") > 500, "A title has 500 characters at most.")
        .when(given("author") > 300, "An author has 300 characters at most.")
        .when(~mode.isin("standard", "ai"), "The mode is standard or ai.")
        .when(F.octet_length("r.html") > MAX_PAGE_BYTES, "Request HTML exceeds 10 MiB.")
    )
    return got.withColumn("error", error).select(*(c for c in rows.columns if c != json), "r.sourceUrl", "r.html", "r.title", "r.author", mode.alias("mode"), "error")


def settings(text: str, environment: dict[str, str] | None = None) -> dict[str, str]:
    """``KEY=VALUE`` lines; comments and lines without a proper key are skipped, quotes are taken off, the environment wins."""
    out = {}
    for line in text.splitlines():
        key, given, value = (p.strip() for p in line.strip().partition("="))
        if given and not key.startswith("#") and key.isidentifier():
            out[key] = value[1:-1] if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'" else value
    return {k: (environment or {}).get(k, v) for k, v in out.items()}


class PackageFiles(DataSource):
    """A sink for ``file_name, epub``: every file is written under another name and renamed when the whole write commits.

    ``spark.dataSource.register(PackageFiles)``, then
    ``df.write.format("packages").option("path", dir).mode("append").save()``.
    The folder must be one that driver and executors share. Mode ``append``
    never replaces a file; ``overwrite`` does.
    """

    @classmethod
    def name(cls) -> str:
        return "packages"

    def schema(self) -> str:
        return "file_name string, epub binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


class _Files(WriterCommitMessage):
    def __init__(self, names):
        self.names = names


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.removeprefix("file://"), overwrite

    def write(self, rows):
        os.makedirs(self.path, exist_ok=True)
        names = []
        for row in rows:
            held = os.path.join(self.path, f".{uuid.uuid4().hex}.part")
            with open(held, "wb") as out:
                out.write(row["epub"])
            names.append((held, os.path.join(self.path, os.path.basename(row["file_name"]))))
        return _Files(names)

    def commit(self, messages):
        moves = [m for part in messages if part is not None for m in part.names]
        if not self.overwrite and (taken := [name for _, name in moves if os.path.exists(name)]):
            self.abort(messages)
            raise FileExistsError(f"Output already exists: {taken[0]}")
        for held, name in moves:
            os.replace(held, name)

    def abort(self, messages):
        for held, _ in (m for part in messages if part is not None for m in part.names):
            if os.path.exists(held):
                os.unlink(held)
