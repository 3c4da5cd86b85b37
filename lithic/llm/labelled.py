"""Labelled documents, and folds that keep rows for testing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows of three numbers up to which the labels are broadcast; more meet their documents by shuffling.
BROADCAST_ROWS = 250_000


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32(doc_id as text) mod folds; a null id counts as an empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int | None = None) -> DataFrame:
    """(doc_id, text, label, fold) of all documents with a label 0 or 1, none of the held-out fold.

    Of several label rows for an id the highest label counts; labels other than 0 and 1 and null ids are left out.
    Of several documents with an id the one of least MD5 of its text comes (null as empty), so there
    is a row for each id at most, however often documents are repeated.  With per_class, that many of either
    label at most, those first by a hash of doc_id.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    own = own.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("fold", fold_of(F.col("doc_id"), folds)).where(F.col("fold") != held_out)
    if per_class is None:
        chosen, few = own, own.count() <= BROADCAST_ROWS
    else:
        order = [F.xxhash64("doc_id"), F.col("doc_id")]
        some = [own.where(F.col("label") == k).orderBy(*order).limit(per_class) for k in (0, 1)]
        chosen, few = some[0].unionByName(some[1]), 2 * per_class <= BROADCAST_ROWS
    text = F.coalesce("text", F.lit(""))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(F.md5(text).alias("key"), text.alias("text")).alias("one")).join(F.broadcast(chosen) if few else chosen, "doc_id")
    return found.groupBy("doc_id", "label", "fold").agg(F.min("one").alias("one")).select("doc_id", "one.text", "label", "fold")
