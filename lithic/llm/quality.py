"""Quality by logistic regression over hashed word n-grams, trained with follow-the-regularised-leader.

Tokens are runs of letters and digits and runs of punctuation, case kept.
Features are single tokens and pairs; a token equal to the one before it is
written as a back-reference, so "X X" shares a feature whatever X is.  A
feature's value is its share of the text's tokens times SCALE; scoring is a
sparse dot product with the bias.

All labelled rows teach.  They are dealt by a hash of doc_id into shards of some STEPS rows; each
shard is learned in a task of its own, and the model is the mean of the shards' weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.llm.labelled import fold_of, training_rows
from lithic.llm.store import map_arrow, materialize, release
from lithic.llm.words import U64, mix, text_slices, tokens_of

#: Steps that a shard's training takes, about: fewer rows are gone over as often as that needs, more are several shards.
STEPS = 24_000
BITS = 18
SCALE = 12.0
#: Of follow-the-regularised-leader: step size, its offset, and the two penalties.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.05, 0.02
_SAME = U64(0x5851F42D4C957F2D)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each text in token order, two for each token, and how many each text has."""
    tokens, _, _, counts = tokens_of(data, offsets)
    before = np.r_[np.zeros(1, U64), tokens[:-1]][: len(tokens)]
    before[(np.cumsum(counts) - counts)[counts > 0]] = 0
    again = np.where(tokens == before, _SAME, tokens)
    both = np.empty(2 * len(tokens), U64)
    both[0::2] = mix(again + U64(1))
    both[1::2] = mix(np.where(again == _SAME, _SAME, before) * U64(0xD1342543DE82EF95) + again)
    return (both >> U64(64 - BITS)).astype(np.int64), 2 * counts


class FollowTheRegularisedLeader:
    """Per-coordinate FTRL-proximal steps for logistic loss; the last coordinate is the bias."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def train(rows: DataFrame, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """The weights and the bias learned from (doc_id, text, label), gone over until steps are taken.

    Shards of at least steps rows, one where there are fewer, each pass a task in hash order, one row after the
    other; the task holds one model and one batch.  The shards' weights are averaged in their order.
    """
    rows = materialize(rows.select("doc_id", "text", "label"), "labelled")
    n = rows.count()
    epochs, shards = max(1, -(-steps // max(1, n))), max(1, n // steps)

    def learned_of(shard: int, model: FollowTheRegularisedLeader) -> pa.RecordBatch:
        w = model.weights()
        at = np.flatnonzero(w)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard, np.int64)), pa.array(at), pa.array(w[at])], ["shard", "at", "w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, model = None, None
        for batch in batches:
            labels, own_shard = batch.column("label").to_pylist(), batch.column("shard").to_pylist()
            for row, data, offsets in text_slices(batch.column("text")):
                found, counts = features(data, offsets)
                for k, own in enumerate(np.split(found, np.cumsum(counts)[:-1])):
                    if own_shard[row + k] != shard:
                        if model is not None:
                            yield learned_of(shard, model)
                        shard, model = own_shard[row + k], FollowTheRegularisedLeader(1 << BITS)
                    at, many = np.unique(own, return_counts=True)
                    model.learn(at, many * (SCALE / max(1, len(own))), labels[row + k])
        if model is not None:
            yield learned_of(shard, model)

    order = F.xxhash64("epoch", "doc_id")
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard")
    passes = rows.select("doc_id", "text", "label", shard, F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch"))
    inline = passes.repartition(shards, "shard").sortWithinPartitions("shard", "epoch", order, "doc_id", "text").select("text", "label", "shard")
    each = map_arrow(inline, run, "shard long, at long, w double").groupBy("at").agg(F.array_sort(F.collect_list(F.struct("shard", "w"))).alias("of"))
    learned = each.select("at", (F.aggregate("of", F.lit(0.0), lambda sum_, x: sum_ + x["w"]) / shards).alias("w")).toArrow()
    release(rows)
    w = np.zeros((1 << BITS) + 1)
    w[learned.column("at").to_numpy()] = learned.column("w").to_numpy()
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, per_class: int | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias learned from all labelled rows outside of the held-out fold; with per_class, that many of either class at most.

    Where that thinned a class out, the bias puts its odds back.
    """
    weights, bias = train(training_rows(docs, labels, "quality", folds, held_out, per_class))
    if per_class is None:
        return weights, bias
    known = labels.where(fold_of(F.col("doc_id"), folds) != held_out).groupBy(F.col("quality").cast("int").alias("k")).count().where("k in (0, 1)").collect()
    of = {r["k"]: r["count"] for r in known}
    return weights, bias + float(np.log(max(1.0, of.get(1, 0) / per_class)) - np.log(max(1.0, of.get(0, 0) / per_class)))


def scores(texts: pa.Array, model: tuple[np.ndarray, float]) -> np.ndarray:
    w, bias = model
    x = np.zeros(len(texts))
    for row, data, offsets in text_slices(texts):
        found, counts = features(data, offsets)
        sums = np.r_[0.0, np.cumsum(w[found])]
        ends = np.cumsum(counts)
        x[row : row + len(counts)] = (sums[ends] - sums[ends - counts]) * SCALE / np.maximum(counts, 1)
    return 1 / (1 + np.exp(-np.clip(x + bias, -500, 500)))


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, per_class: int | None = None, threshold: float = 0.3) -> DataFrame:
    """A row for each row of docs: doc_id, held_out, score (0 to 1), predicted.

    docs has doc_id and text, labels doc_id and quality; other columns are ignored.
    The model is fit()'s.  Null and empty texts get the bias's value, as all texts do without
    labels.  Repeated rows are scored each; whole texts count, however long; an
    empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, folds, held_out, per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(batch.column("text"), model.value))], ["doc_id", "score"])

    scored = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")
    return scored.select("doc_id", (fold_of(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **of_fit: int) -> DataFrame:
    """docs, all columns as they are, of the rows that score_quality gives threshold or more.

    docs has doc_id and text, whatever else it has and however that is named.  Null, empty and wordless texts have the bias's
    value, as all texts do without labels, and stay or go by it together; equal texts, repeated rows among them, stay or go together; very long texts count whole;
    an empty table gives an empty one.
    """
    model, at = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **of_fit)), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at), model.value) >= threshold))

    return map_arrow(docs, run, docs.schema)
