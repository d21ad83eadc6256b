"""Labelled samples for classifiers: the training split and a bounded number of its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of doc_id as text, modulo 5; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % 5


def sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, *, held_out: int = 0) -> DataFrame:
    """text and label (double) of at most `bound` labelled rows outside the held-out fifth, taken by a hash of doc_id.

    Repeated labels of a document count once, as their maximum; rows with a null id or label are left out.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder() != held_out)).groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    # `some` has at most `bound` rows of two numbers
    return texts.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.max("text").alias("text"))
