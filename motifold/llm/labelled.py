"""Labelled documents: all of them, or a bounded sample for fitting a classifier on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def known(labels: DataFrame, label: str, learn: Column, id_column: str = "doc_id") -> DataFrame:
    """id and label of the rows where `learn` holds; labels other than 0 and 1 and null ids are left out."""
    rows = labels.where(learn & F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(label).cast("int").alias("label"))
    return rows.where(F.col("label").isin(0, 1))


def first(marked: DataFrame, most: tuple[int, int]) -> DataFrame:
    """At most most[y] rows of label y, the first by a hash of the id, and each id once."""
    parts = [marked.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(most[y]) for y in (0, 1)]
    return parts[0].unionByName(parts[1]).dropDuplicates(["id"])


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: tuple[int, int], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, text and label of at most most[y] rows of label y among the known ones. Their ids, at most sum(most), are what is broadcast."""
    picked = first(known(labels, label, learn, id_column), most)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.join(F.broadcast(picked), "id")
