"""Bounded, repeatable samples of labelled documents to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that any classifier is fitted on: a documented bound; the rows with the smallest hashes of doc_id.
SAMPLE_ROWS = 12_000


def crc_mod(id_col: str, k: int) -> Column:
    """crc32(doc_id as text) mod k; null for a null id."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % k


def sample(docs: DataFrame, labels: DataFrame, label: str, where: Column | None = None, rows: int = SAMPLE_ROWS, columns: tuple[str, ...] = ("text",), classes: tuple[int, ...] = (0, 1)) -> DataFrame:
    """doc_id, label and `columns` of at most `rows` labelled documents, one row a doc_id.

    Labels that contradict each other count as the larger; labels that are null, of null ids or outside
    `classes` are left out, as are rows for which `where` (on doc_id) is not true.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    own = own.where(F.col("doc_id").isNotNull() & F.col("label").isin(*classes))
    own = own.where(where) if where is not None else own
    own = own.groupBy("doc_id").agg(F.max("label").alias("label"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(f"`{c}`") for c in columns])
    return texts.join(F.broadcast(own), "doc_id")  # `rows` rows of two numbers
