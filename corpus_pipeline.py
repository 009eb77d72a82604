"""The training-corpus pipeline: five stages over ``documents``.

Every stage takes ``(spark, docs, sf_dir)``, works on all that the one before
kept, and is written as Parquet and read again before the next. All but the
last return the columns of ``documents``. Rows without an id, or with other texts
under one id, are documents like any other in every stage; null texts count as
empty; columns that ``docs`` has besides those of ``documents`` are carried up to
the last stage; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pageloom.llm import chaining, decontam, jaccard, knn_quality, mixing
from pageloom.llm.common import forget, shared_root, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled neighbours reject go. Learns from labels of rows that are not held out.

    An empty text has a score like any other. Without labels, or with one kind
    only, the share of good labels decides for all (0.5 without any: all stay).
    """
    labels = knn_quality.training_labels(table(spark, sf_dir, "labels"))
    return knn_quality.accepted(docs, knn_quality.fit(docs, labels))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id.

    Texts without words are a group only if they are the same string. Rows
    without an id come after those with one; of equal rows one stays.
    """
    return jaccard.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document has are cut from the text; no row goes.

    A null text stays null, and ``n_chars`` follows the text.
    """
    return chaining.cut_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a ten-word window of a benchmark item go. Without items, or without words, nothing goes."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def target_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets the rate with which it is to be read; none goes.

    An empty text gets a rate and weighs nothing. Without labels all posteriors are equal shares.
    """
    return mixing.mix_documents(docs, mixing.quality_domains(table(spark, sf_dir, "labels")))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing to target weights", target_mixing),
]

#: The classifier, the posteriors and the fitted rates are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{n}")
        if n:
            forget(docs)
        docs = spark.read.parquet(f"{root}/{n}")
        docs._settled_at = f"{root}/{n}"
    return docs
