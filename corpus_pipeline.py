"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again
as the docs of the next. All stages but the last return the columns of documents, and any extra ones.

Null and empty texts score the classifiers' base rates, lose no line and are no copy of anything. Rows without doc_id are
judged by their text alone and never dropped as copies. Repeated rows are one document: what happens to one happens to all.
Of rows that share a doc_id and differ in text, the n-gram join makes one document, the other stages as many as there are
texts. An empty table stays empty."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquern.llm import common as c
from logquern.llm import lines, ngrams, packing, quality, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return toxicity.clean(docs, toxicity.trained(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "labels")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.good(docs, quality.trained(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines like an earlier one go, and documents of which nothing else is left."""
    return lines.deduplicate(docs, empty=False)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, stays of each group that five-word shingles connect at 0.8 or more."""
    found = ngrams.near_duplicates(docs, ngrams.Rule(5, 80, 100)).select(F.col("doc_id").alias("_doc"), "component_id")
    gone = found.filter("component_id <> _doc").select("_doc").distinct()
    return docs.join(gone.hint("shuffle_hash"), docs["doc_id"] == gone["_doc"], "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What stays, as pieces in sequences."""
    return packing.pack(c.stored(packing.cut(docs, packing.default_vocabulary())))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("line dedup", drop_lines),
    ("n-gram join", drop_copies),
    ("packing", pack),
]

#: SQL can express neither the trained models nor best-fit packing; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = c.stored(docs)
    return docs
