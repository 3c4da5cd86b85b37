"""A training corpus out of raw documents, stage by stage.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; run() writes each stage's result as Parquet to the shared folder and reads it again for
the next.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lithic.llm import minhash, mixing, packing, quality, store, toxicity

#: The stages depend on hashes, learned models and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go.

    Null, empty and blank texts have all one score and stay or go together, as equal texts and repeated rows do; very long texts
    count whole; columns may have any names; no rows give none.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null, empty and blank texts have all one score and stay or go together, as equal texts and repeated rows do; very long texts
    count whole; columns may have any names; no rows give none.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that of least doc_id, null last, then of the least MD5 of its text.

    Of repeated rows one stays.  Null, empty and blank texts are in no group, so all of them stay; very long texts count whole;
    columns may have any names; no rows give none.
    """
    return minhash.deduplicate(docs, width=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row each time a document is taken, along the schedule.

    Rows without words (null, empty and blank texts) are never taken; a null source is a source of its own; of rows equal in
    doc_id, text and source one stands for all; very long texts lie in as many blocks as they fill and may be cut where a target
    ends; columns may have any names; no rows give none.
    """
    return mixing.apply_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens.

    Null and empty texts are an end token alone; very long texts are cut into full windows and a rest; repeated rows and null
    ids are packed like any others, equal lengths in the order they come; other columns are ignored; no rows give none.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("toxicity", without_toxic),
    ("quality_classifier", of_quality),
    ("minhash_near_dedup", without_near_copies),
    ("source_mixing", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir, one after the other; a stage's table goes when the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, store.materialize(stage(spark, docs, sf_dir), name)
        store.release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
