"""Document fingerprints: MinHash over word shingles in vectorised numpy.

A fingerprint holds the low byte of the least value under each of 128 universal
hash permutations; two fingerprints' likeness is the share of equal bytes, less
what chance makes equal.  near_groups() joins bands of full signatures in Spark
and confirms Jaccard similarity on whole shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithic.llm import minhash
from lithic.llm.store import map_arrow, materialize
from lithic.llm.words import U64, mix, shingles_of, text_slices, words_of

PERMUTATIONS = 128
SHINGLE = 5
#: Bands of full signatures: at a similarity of 0.8 a pair misses all 32 of 4 values once in 2e7.
BAND_VALUES = 4


def signatures(shingles: np.ndarray, counts: np.ndarray, n: int = PERMUTATIONS) -> np.ndarray:
    """(texts, n) uint32: each text's least shingle value under each permutation; the greatest number where it has none."""
    out = np.full((len(counts), n), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(counts)
    if len(full):
        firsts = (np.cumsum(counts) - counts)[full]
        a, b = minhash.permutations(n, seed=7)
        for k in range(n):
            out[full, k] = np.minimum.reduceat(((shingles * a[k] + b[k]) >> U64(32)).astype(np.uint32), firsts)
    return out


def fingerprints(texts: pa.Array, width: int = SHINGLE) -> np.ndarray:
    """(texts, PERMUTATIONS) uint8."""
    found = [np.zeros((0, PERMUTATIONS), np.uint8)]
    for _, data, offsets in text_slices(texts, 1 << 19):
        found.append((signatures(*shingles_of(*words_of(data, offsets), width)) & 0xFF).astype(np.uint8))
    return np.concatenate(found)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of fingerprint rows, 0 to 1."""
    equal = (a == b).mean(axis=-1)
    return np.clip((equal - 1 / 256) / (1 - 1 / 256), 0.0, 1.0)


def band_keys(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(texts, bands) uint64 for minhash.near_duplicates."""
    sig = signatures(shingles, counts).astype(U64).reshape(len(counts), -1, BAND_VALUES)
    out = np.broadcast_to(np.arange(sig.shape[1], dtype=U64), sig.shape[:2]).copy()
    for k in range(BAND_VALUES):
        out = mix(out * U64(0xD1342543DE82EF95) + sig[:, :, k])
    return out


def near_groups(docs: DataFrame, percent: int = 80) -> DataFrame:
    """minhash.near_duplicates over this module's signatures and five-word shingles: bands joined in Spark, Jaccard similarity verified.

    docs has doc_id and text; other columns are ignored, whatever their names.  A row for each row of docs; what null, empty and very long texts,
    ties, repeated rows and empty tables give is said there.
    """
    return minhash.near_duplicates(docs, SHINGLE, percent, keys=band_keys)


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 2) characters replaced by the first as many, or all, of following."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_DONE = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _compared(ids: list, texts: list[str], following: list[str], own: np.ndarray, later: np.ndarray) -> pa.RecordBatch:
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    after = fingerprints(pa.array(changed, pa.string()))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array(list(map(len, texts)), pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            pa.array([x.tobytes() for x in own], pa.binary()),
            pa.array([x.tobytes() for x in after], pa.binary()),
            pa.array(likeness(own, after), pa.float64()),
            pa.array(likeness(own, later), pa.float64()),
        ],
        [x.split()[0] for x in _DONE.split(", ")],
    )


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    docs has doc_id and text; other columns are ignored, whatever their names; null texts are empty.
    The next document is the one that follows in the order of doc_id (null first),
    then of a hash of the text; after the last comes the first, so a single row follows itself.  Equal texts, repeated rows among
    them, have equal fingerprints; texts without words have all one.  A text of
    fewer than five words has its whole sequence as its one shingle.  Whole texts
    count, however long.  An empty table gives no rows.

    Texts move once, into ranges of the order that are sorted; each task holds a batch
    and the row before it.  Only the last row of a range waits for the first of the next: the ranges' numbers alone
    are put in a row, and the rows meet by them.  Rows equal in doc_id and text may be any number: a last key spreads them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        names = [x.split()[0] for x in _DONE.split(", ")]

        def end(kind: int, doc: int | None, text: str, print_: np.ndarray) -> pa.RecordBatch:
            values = [doc, len(text), "", print_.tobytes(), b"", 0.0, 0.0, kind, place, text]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [*names, "kind", "place", "held"])

        def plain(rows: pa.RecordBatch) -> pa.RecordBatch:
            n = rows.num_rows
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, place, np.int32)), pa.nulls(n, pa.string())], [*names, "kind", "place", "held"])

        last: tuple | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, texts = part.column("doc_id").to_pylist(), [t or "" for t in part.column("text").to_pylist()]
                prints = fingerprints(pa.array(texts, pa.string()))
                if last is None:
                    yield end(2, ids[0], texts[0], prints[0])
                else:
                    ids, texts, prints = [last[0], *ids], [last[1], *texts], np.concatenate([last[2][None], prints])
                if len(ids) > 1:
                    yield plain(_compared(ids[:-1], texts[:-1], texts[1:], prints[:-1], prints[1:]))
                last = ids[-1], texts[-1], prints[-1]
        if last is not None:
            yield end(1, *last)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, later = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PERMUTATIONS) for c in ("fingerprint", "next_fingerprint"))
            yield _compared(batch.column("doc_id").to_pylist(), batch.column("held").to_pylist(), batch.column("next_held").to_pylist(), own, later)

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("by"), F.monotonically_increasing_id().alias("at"))
    ordered = keyed.repartitionByRange("doc_id", "by", "at").sortWithinPartitions("doc_id", "by", "at").select("doc_id", "text")
    rows = materialize(map_arrow(ordered, run, f"{_DONE}, kind int, place int, held string"), "fingerprints")
    # First (2) and last (1) row of each range: what follows a last row is the first one of the next range that has rows.
    order = Window.orderBy("place")
    around = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    places = rows.where("kind = 1").select("place")  # a number for each range
    places = places.select("place", F.coalesce(F.lead("place").over(order), F.first("place").over(around)).alias("next_place"))
    firsts = rows.where("kind = 2").select(F.col("place").alias("next_place"), F.col("held").alias("next_held"), F.col("fingerprint").alias("next_fingerprint"))
    ends = rows.where("kind = 1").select("place", "doc_id", "held", "fingerprint").join(places, "place").join(firsts, "next_place")
    closed = map_arrow(ends.select("doc_id", "held", "fingerprint", "next_held", "next_fingerprint"), close, _DONE)
    done = rows.where("kind = 0").drop("kind", "place", "held").unionByName(closed)
    for c in ("fingerprint", "edited_fingerprint"):
        done = done.withColumn(c, F.lower(F.hex(c)))
    return done
