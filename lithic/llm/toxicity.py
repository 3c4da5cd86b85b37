"""Toxicity by class-conditional Kneser-Ney word models.

Two interpolated Kneser-Ney models, one of toxic and one of ordinary documents,
give a document two log-likelihoods; the score is a logistic function of their
difference for each word.  Both go from word pairs to words to word stems
(first letters) to stem counts that both classes share.  Every level counts the distinct contexts
of its entries in the class (a pair's words before it, a word's predecessors, a
stem's words), so copies of a document count once.

An entry is the class's own where the classes differ beyond chance (G2) and
by a factor of RATIO or more; all other expressions are left to the counts
that both classes share.  Else the many rare words of ordinary prose, and how a
language happens to be spread over the labels, would drown the few that matter.

All labelled rows teach.  Contexts are counted by Spark, a share of the words at a time;
all entries that differ make the model that is broadcast.  What an entry doesn't get goes to the level below, so the distributions stay whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithic.llm.labelled import fold_of, training_rows
from lithic.llm.store import map_arrow, materialize, release
from lithic.llm.words import U64, mix, span_hasher, text_slices, word_spans

G2, RATIO = 15.0, 5.0
STEM = 4
DISCOUNT = 0.75
#: The training rows are dealt into so many parts; each is scored by a model of the others to fit the logistic function.
PARTS = 5
#: Whose counts a model has: all parts but one, for each; then all.
_MODELS = [[h for h in range(PARTS) if h != k] for k in range(PARTS)] + [list(range(PARTS))]
#: Contexts are counted for a share of the words at a time, so that not all are being shuffled: a share for so many rows, but few, as each reads all texts.
SHARE_ROWS, SHARES = 6000, 8
_CELLS = [(p, c) for p in range(PARTS + 1) for c in (0, 1)]
#: The bits of a model's parts and class.
_MASKS = {(p, c): sum(1 << (2 * h + c) for h in _MODELS[p]) for p, c in _CELLS}


def word_events(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each text's words, of the words before them (0 at its start) and of their stems; words per text."""
    starts, ends = word_spans(data, offsets)
    counts, hashes = np.diff(np.searchsorted(starts, offsets)), span_hasher(data)
    words = hashes(starts, ends)
    before = np.r_[np.zeros(1, U64), words[:-1]][: len(words)]
    before[(np.cumsum(counts) - counts)[counts > 0]] = 0
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    at = np.searchsorted(chars, starts) + STEM
    cut = np.r_[chars, np.full(STEM + 1, len(data))][np.minimum(at, len(chars) + STEM)]
    stems = mix(hashes(starts, np.maximum(starts + 1, np.minimum(ends, cut))) + U64(1)) if len(words) else words
    return words, before, stems, counts


def pair_key(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(before * U64(0xD1342543DE82EF95) + words)


def _lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.fill_null(""))


def context_counts(rows: DataFrame, share: int = 0, shares: int = 1) -> DataFrame:
    """(text, label, part) -> a row for each distinct three words in a row: key, before and word (the last two), stem, and seen (bit 2 part + label where they are).

    With shares, of those only whose last word's hash leaves share when divided by shares.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = 2 * batch.column("part").to_numpy() + batch.column("label").to_numpy()
            for row, data, offsets in text_slices(_lower(batch.column("text"))):
                words, before, stems, counts = word_events(data, offsets)
                pair = pair_key(before, words)
                earlier = np.r_[np.zeros(1, U64), before[:-1]][: len(before)]
                earlier[(np.cumsum(counts) - counts)[counts > 0]] = 0  # nothing comes before a text, whatever its neighbour in the batch
                own = np.flatnonzero(words % U64(shares) == share)
                key, first, where = np.unique(pair_key(earlier, pair)[own], return_index=True, return_inverse=True)
                seen, first = np.zeros(len(key), np.int32), own[first]
                np.bitwise_or.at(seen, where, np.repeat(1 << cell[row : row + len(counts)], counts).astype(np.int32)[own])
                yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in (key, before[first], words[first], stems[first])), pa.array(seen)], ["key", "before", "word", "stem", "seen"])

    names = ["before", "word", "stem"]
    spec = ", ".join([*(f"{c} long" for c in ("key", *names)), "seen int"])
    return map_arrow(rows.select("text", "label", "part"), run, spec).groupBy("key").agg(*[F.first(c).alias(c) for c in names], F.bit_or("seen").alias("seen"))


@dataclass
class Level:
    """Entries of one level by sorted key: value[i, c] for class c; `other` where there is no entry."""

    keys: np.ndarray
    value: np.ndarray
    other: np.ndarray
    near: np.ndarray  # by the first 16 bits, whether there is a key that begins so

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        out = np.empty((len(keys), 2))
        out[:] = self.other
        if len(self.keys):
            some = np.flatnonzero(self.near[keys >> U64(48)])
            at = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
            there = self.keys[at] == keys[some]
            out[some[there]] = self.value[at[there]]
        return out


def _level(keys: np.ndarray, value: np.ndarray, other: tuple[float, float]) -> Level:
    order, near = np.argsort(keys), np.zeros(1 << 16, bool)
    near[keys >> U64(48)] = True
    return Level(keys[order], np.ascontiguousarray(value[order]), np.array(other, float), near)


@dataclass
class KneserNey:
    """Two class-conditional models over the same levels; column 0 is the ordinary class, 1 the toxic one."""

    pairs: Level  # discounted probability of the word after its predecessor
    rest: Level  # probability left to the words level after a predecessor
    words: Level  # probability of a word that is an entry, its stem's part included
    stems: Level  # what other words get by their stem

    def log_ratio(self, words: np.ndarray, before: np.ndarray, stems: np.ndarray) -> np.ndarray:
        known = self.words.look_up(words)
        lower = np.where(known[:, :1] > 0, known, self.stems.look_up(stems))
        p = self.pairs.look_up(pair_key(before, words)) + self.rest.look_up(before) * lower
        return np.log(p[:, 1]) - np.log(p[:, 0])


def _differs(totals: np.ndarray) -> Column:
    """Whether a row's class counts differ beyond chance and by RATIO, for some part of the training rows."""
    tests = []
    for p in range(PARTS + 1):
        n, all_ = [F.col(f"n{p}_{c}") for c in (0, 1)], [float(max(1, x)) for x in totals[p]]
        both = n[0] + n[1]
        terms = [F.when(n[c] > 0, n[c] * F.log(n[c] * sum(all_) / (both * all_[c]))).otherwise(0.0) for c in (0, 1)]
        ratio = F.abs(F.log((n[1] + 0.5) / all_[1]) - F.log((n[0] + 0.5) / all_[0]))
        tests.append(((2 * (terms[0] + terms[1]) >= G2) & (ratio >= float(np.log(RATIO)))).cast("int") * (1 << p))
    return sum(tests[1:], start=tests[0])


def _contexts(df: DataFrame, by: list[str], also: list[str] = ()) -> DataFrame:
    """For each `by`, how many rows have a count in each cell; and the first of `also`."""
    return df.groupBy(*by).agg(*[F.first(c).alias(c) for c in also], *[F.count(F.when(F.col(f"n{p}_{c}") > 0, 1)).alias(f"n{p}_{c}") for p, c in _CELLS])


def _totals(df: DataFrame) -> np.ndarray:
    found = df.agg(*[F.coalesce(F.sum(f"n{p}_{c}"), F.lit(0)) for p, c in _CELLS]).first()
    return np.array(found, float).reshape(PARTS + 1, 2)


def _entries(df: DataFrame, totals: np.ndarray, key: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """The rows that differ: keys, counts (rows, parts, classes), whether kept in each part, and all columns."""
    # n occurrences in all can't reach G2 beyond 2 n log(all / the rarer class), in any part; most rows are ruled out by that.
    own = np.maximum(1.0, totals)
    least = float(np.min(G2 / (2 * np.log(own.sum(1) / own.min(1)))))
    kept = df.where(F.col(f"n{PARTS}_0") + F.col(f"n{PARTS}_1") >= least).withColumn("kept", _differs(totals)).where("kept > 0")
    found = kept.withColumn("both", F.col(f"n{PARTS}_0") + F.col(f"n{PARTS}_1")).toArrow().sort_by([("both", "descending"), (key, "ascending")])
    column = {c: found.column(c).to_numpy() for c in found.column_names}
    counts = np.stack([column[f"n{p}_{c}"] for p, c in _CELLS], 1).reshape(-1, PARTS + 1, 2).astype(float)
    return column[key].view(U64), counts, (column["kept"][:, None] >> np.arange(PARTS + 1)) & 1 == 1, column


def train(*counts: DataFrame) -> list[KneserNey]:
    """The models of all parts of the training rows but one, for each, and of all, from context_counts, all of its shares."""
    cells = [F.col("seen").bitwiseAND(F.lit(mask)).alias(f"n{p}_{c}") for (p, c), mask in _MASKS.items()]
    shares = [materialize(_contexts(x.select("before", "word", "stem", *cells), ["before", "word"], ["stem"]), "pairs") for x in counts]
    pairs = functools.reduce(DataFrame.unionByName, shares)
    words = materialize(_contexts(pairs, ["word"], ["stem"]), "words", few=True)
    stems = _contexts(words, ["stem"]).join(words.groupBy("stem").agg(F.sum(F.col(f"n{PARTS}_0") + F.col(f"n{PARTS}_1")).alias("contexts")), "stem")
    stems = materialize(stems, "stems", few=True)
    pair_all, word_all, stem_all = _totals(pairs), _totals(words), _totals(stems)
    _, n_pair, in_pair, of_pair = _entries(pairs, pair_all, "word")
    named = stems.select("stem", "contexts", *[F.col(f"n{p}_{c}").alias(f"s{p}_{c}") for p, c in _CELLS])
    word, n_word, in_word, of_word = _entries(words.join(named, "stem"), word_all, "word")
    stem, n_stem, in_stem, _ = _entries(stems, stem_all, "stem")
    before = of_pair["before"].view(U64)
    pair = pair_key(before, of_pair["word"].view(U64))
    known = pairs.join(F.broadcast(pairs.sparkSession.createDataFrame([(int(x),) for x in np.unique(of_pair["before"])], "before long")), "before")
    context = known.groupBy("before").agg(*[F.sum(f"n{p}_{c}").alias(f"n{p}_{c}") for p, c in _CELLS]).orderBy("before").toArrow()
    ctx = context.column("before").to_numpy()
    n_ctx = np.stack([context.column(f"n{p}_{c}").to_numpy() for p, c in _CELLS], 1).reshape(-1, PARTS + 1, 2).astype(float)
    n_of = np.stack([of_word[f"s{p}_{c}"] for p, c in _CELLS], 1).reshape(-1, PARTS + 1, 2).astype(float)
    share = (n_word[:, PARTS].sum(1) + 0.5) / (of_word["contexts"] + 0.5)
    release(*shares, words, stems)

    def own(n: np.ndarray, kept: np.ndarray, total: np.ndarray) -> np.ndarray:
        return np.maximum(n - DISCOUNT, 0) / np.maximum(total, 1) * kept[:, None]

    models = []
    for p in range(PARTS + 1):
        size = max(1.0, stem_all[p].sum())
        by_stem = own(n_stem[:, p], in_stem[:, p], stem_all[p])
        left = 1 - by_stem.sum(0)
        by_stem = by_stem + left * (n_stem[:, p].sum(1, keepdims=True) + 0.5) / size
        by_word = own(n_word[:, p], in_word[:, p], word_all[p])
        rest = 1 - by_word.sum(0)
        at, entry = _positions(stem, of_word["stem"].view(U64))
        base = left * (n_of[:, p].sum(1, keepdims=True) + 0.5) / size
        base = np.where(entry[:, None], by_stem[at] if len(stem) else 0.0, base)
        by_word = by_word + rest * base * share[:, None]
        at = np.searchsorted(ctx, before.view(np.int64))
        by_pair = own(n_pair[:, p], in_pair[:, p], n_ctx[at, p] if len(pair) else np.ones((0, 2)))
        spent = np.stack([np.bincount(at, by_pair[:, c], minlength=len(ctx)) for c in (0, 1)], 1)
        models.append(KneserNey(_level(pair, by_pair, (0, 0)), _level(ctx.view(U64), 1 - spent, (1, 1)), _level(word, by_word, (0, 0)), _level(stem, rest * by_stem, tuple(rest * left * 0.5 / size))))
    return models


def _positions(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key is in keys (0 if nowhere), and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), int), np.zeros(len(wanted), bool)
    order = np.argsort(keys)
    at = order[np.minimum(np.searchsorted(keys[order], wanted), len(keys) - 1)]
    there = keys[at] == wanted
    return np.where(there, at, 0), there


def _ratios(texts: pa.Array, model: KneserNey) -> Iterator[tuple[int, np.ndarray]]:
    """For runs of rows, the first row and each text's log-likelihood difference for a word (0 without words)."""
    for row, data, offsets in text_slices(_lower(texts)):
        words, before, stems, counts = word_events(data, offsets)
        sums = np.r_[0.0, np.cumsum(model.log_ratio(words, before, stems))]
        ends = np.cumsum(counts)
        yield row, (sums[ends] - sums[ends - counts]) / np.maximum(counts, 1)


@dataclass
class Logistic:
    """A logistic function of the difference x, on an arcsinh scale in units of ordinary documents' spread."""

    mean: float
    scale: float
    slope: float
    intercept: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.arcsinh((x - self.mean) / self.scale)
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.intercept, -500, 500)))


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Logistic:
    """The logistic function that fits y, by Newton steps with a light ridge; the rate of y = 1 where a class is missing."""
    ordinary = x[y == 0] if (y == 0).any() else np.zeros(1)
    mean, scale = float(ordinary.mean()), max(1e-3, float(ordinary.std()))
    z = np.stack([np.arcsinh((x - mean) / scale), np.ones(len(x))], 1)
    rate = (float((weight * y).sum()) + 0.5) / (float(weight.sum()) + 1.0)
    beta, ridge = np.array([0.0, np.log(rate / (1 - rate))]), np.diag([0.1, 1e-6])
    for _ in range(100 if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (y - p)) - ridge @ beta)
        beta = beta + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return Logistic(mean, scale, float(beta[0]), float(beta[1]))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, per_class: int | None = None) -> tuple[KneserNey, Logistic]:
    """The model of all training rows and the logistic function of its differences.

    Rows of the held-out fold teach nothing, all other labelled ones do; per_class, if given, bounds the
    documents of either class that are read.  Each part of them is scored by a
    model of the others to fit the logistic function, weighted back to the labels' own rates.
    """
    spark = docs.sparkSession
    rows = training_rows(docs, labels, "toxic", folds, held_out, per_class)
    # Parts go by the text, so that copies of one aren't in several.
    rows = materialize(rows.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(PARTS)).cast("int")).select("text", "label", "part"), "labelled")
    shares = min(SHARES, 1 + rows.count() // SHARE_ROWS)
    models = train(*[context_counts(rows, k, shares) for k in range(shares)])
    others = spark.sparkContext.broadcast(models[:PARTS])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column("part").to_numpy()
            for k in np.unique(part):
                own = batch.filter(pa.array(part == k))
                x = np.concatenate([got for _, got in _ratios(own.column("text"), others.value[k])])
                yield pa.RecordBatch.from_arrays([pa.array(x), own.column("label")], ["x", "label"])

    got = rows.select("text", "label", "part").mapInArrow(across, "x double, label int").toArrow()
    x, y = got.column("x").to_numpy(), got.column("label").to_numpy().astype(float)
    known = labels.where(fold_of(F.col("doc_id"), folds) != held_out).groupBy(F.col("toxic").cast("int").alias("k")).count().where("k in (0, 1)").collect()
    of = {r["k"]: r["count"] for r in known}
    weight = np.where(y == 1, of.get(1, 0) / max(1, y.sum()), of.get(0, 0) / max(1, (1 - y).sum()))
    release(rows, others)
    return models[PARTS], calibrate(x, y, weight)


def scores(texts: pa.Array, model: tuple[KneserNey, Logistic]) -> np.ndarray:
    found = [got for _, got in _ratios(texts, model[0])]
    return model[1](np.concatenate(found) if found else np.zeros(0))


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, per_class: int | None = None, threshold: float = 0.7) -> DataFrame:
    """A row for each row of docs: doc_id, held_out, score (0 to 1), predicted.

    docs has doc_id and text, labels doc_id and toxic; other columns are ignored.
    The model is fit()'s.  Null and wordless texts get the logistic function's value at
    a difference of 0; without labels of both classes every score
    is the smoothed rate of label 1.  Repeated rows are scored each; whole texts
    count, however long; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, folds, held_out, per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(batch.column("text"), model.value))], ["doc_id", "score"])

    scored = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")
    return scored.select("doc_id", (fold_of(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **of_fit: int) -> DataFrame:
    """docs, all columns as they are, without the rows that score_toxicity gives threshold or more.

    docs has doc_id and text, whatever else it has and however that is named.  Null, empty and wordless texts have the
    value of a difference of 0, all texts the rate of label 1 where a class has no labels; equal texts, repeated rows among them, stay or go together; very long texts count
    whole; an empty table gives an empty one.
    """
    model, at = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **of_fit)), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at), model.value) < threshold))

    return map_arrow(docs, run, docs.schema)
