"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm._shared import documents, held_in_fold


def _usable(labels: DataFrame, column: str, folds: int, out: int) -> DataFrame:
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    return usable.where(~held_in_fold(F.col("doc_id"), folds, out)).groupBy("doc_id").agg(F.max("label").alias("label"))


def label_counts(labels: DataFrame, column: str, folds: int, out: int) -> DataFrame:
    """(label int, n) of all documents with a label outside the fold held out."""
    return _usable(labels, column, folds, out).groupBy("label").agg(F.count("*").alias("n"))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, folds: int, out: int, most: int, by_class: bool) -> DataFrame:
    """(doc_id, text, label int) of at most `most` labels outside the fold held out, or as many of each class, chosen by a hash of doc_id.

    Labels other than 0 and 1 and null ids are left out; of several labels of a document the largest counts. The
    ids, bounded by `most`, are broadcast to the documents.
    """
    usable = _usable(labels, column, folds, out)
    chosen = lambda rows: rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    ids = chosen(usable.where("label = 0")).unionByName(chosen(usable.where("label = 1"))) if by_class else chosen(usable)
    return documents(docs).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label")
