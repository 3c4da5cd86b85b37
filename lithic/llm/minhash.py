"""Near-duplicate groups by min-max hashing with exact confirmation.

Each universal hash permutation of a text's shingle hashes gives two signature
values, its minimum and its maximum, so 64 evaluations give 128 values.  32 bands
of 4 values propose candidates: at the threshold of 0.8 a pair misses every band
with probability (1 - 0.8**4)**32 < 5e-8.  Every proposed link is confirmed on
the full shingle sets.

Hot groups.  Texts with equal shingle sets collapse to one representative before
banding, and no all-pairs list of a bucket is made.  Links inside a component
cannot change the result, so only links between components are looked for:

1. everyone in a bucket is compared with the bucket's least member;
2. in buckets that still hold several components, everyone is compared with the
   member that has the fewest shingles of its own (an original has nearly none,
   its edited copies have some);
3. what still crosses components is found by an exact filter: shingles are put
   in one global order, those held by a single component first, then rare
   before frequent.  A linked pair must share a shingle in both prefixes of
   n - ceil(0.8 n) + 1, and enough shingles that other components hold, for
   both sizes.  The sets on a shingle's list are compared with the list's middle and a few others of
   it first, and then all pairs that pass and still cross components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithic.llm.components import connected_components
from lithic.llm.store import map_arrow, materialize, release
from lithic.llm.words import U64, mix, shingles_of, text_slices, words_of

PERMUTATIONS = 64
BAND_VALUES = 4
BANDS = 2 * PERMUTATIONS // BAND_VALUES
#: One shingle in so many is looked at to choose the leaders of step 2; it decides no link.
SAMPLED = 8
#: Rows of two short keys each (some 25 MB) up to which the list of needed texts is broadcast.
BROADCAST_ROWS = 250_000
#: In step 3, rounds in which a shingle's sets are compared with HEADS of them before the rest is.
POST_TURNS, HEADS = 2, 3


def permutations(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of n multiply-shift hash functions."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, n, dtype=U64) * U64(2) + U64(1), rng.integers(0, 1 << 63, n, dtype=U64)


def min_max_signatures(shingles: np.ndarray, counts: np.ndarray, n: int = PERMUTATIONS) -> np.ndarray:
    """(texts, 2 n) uint32: the least and the greatest value under each permutation; zeros where a text has no shingle."""
    out = np.zeros((len(counts), 2 * n), np.uint32)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    firsts = (np.cumsum(counts) - counts)[full]
    a, b = permutations(n)
    for k in range(n):
        h = ((shingles * a[k] + b[k]) >> U64(32)).astype(np.uint32)
        out[full, 2 * k] = np.minimum.reduceat(h, firsts)
        out[full, 2 * k + 1] = np.maximum.reduceat(h, firsts)
    return out


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """By slice of the array: all shingles, how many each text has, and each text's sorted distinct ones."""
    for _, data, offsets in text_slices(texts, 1 << 19):
        shingles, counts = shingles_of(*words_of(data, offsets), width)
        yield shingles, counts, [np.unique(x) for x in np.split(shingles, np.cumsum(counts)[:-1])]


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(texts, BANDS) uint64: each band's values with the band's number, hashed."""
    bands = signatures.astype(U64).reshape(len(signatures), BANDS, BAND_VALUES)
    out = np.broadcast_to(np.arange(BANDS, dtype=U64), bands.shape[:2]).copy()
    for k in range(BAND_VALUES):
        out = mix(out * U64(0xD1342543DE82EF95) + bands[:, :, k])
    return out


def min_max_bands(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return band_keys(min_max_signatures(shingles, counts))


Keys = Callable[[np.ndarray, np.ndarray], np.ndarray]


def set_features(docs: DataFrame, width: int, keys: Keys = min_max_bands) -> DataFrame:
    """(doc_id, text_key, text) -> doc_id, text_key, n_shingles, set_key (128 bits of the sorted set), bands (array of long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, bands, per = [], [], [np.zeros(0, U64)], 1
            for shingles, counts, sets in shingle_sets(batch.column("text"), width):
                sizes += map(len, sets)
                names += [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
                found = keys(shingles, counts)
                bands.append(found.ravel())
                per = found.shape[1]
            flat = pa.array(np.concatenate(bands).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * per), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), lists], ["doc_id", "text_key", "n_shingles", "set_key", "bands"])

    return map_arrow(docs, run, "doc_id long, text_key binary, n_shingles long, set_key binary, bands array<long>")


def held_shingles(members: DataFrame, texts: DataFrame, width: int, every: int = 1) -> DataFrame:
    """members (b, ...) -> (b, s): a row for each distinct shingle, or for one in every by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x for _, _, found in shingle_sets(batch.column("text"), width) for x in found]
            if every > 1:
                sets = [x[x % U64(every) == 0] for x in sets]
            for k in range(0, len(sets), 256):  # outputs stay small
                part = sets[k : k + 256]
                rows = np.repeat(np.arange(k, k + len(part)), [len(x) for x in part])
                yield pa.RecordBatch.from_arrays([batch.column("b").take(pa.array(rows)), pa.array(np.concatenate(part).view(np.int64))], ["b", "s"])

    return map_arrow(members.select("b").join(texts, "b").select("b", "text"), run, "b long, s long")


def text_key(text: Column) -> Column:
    """128 bits that name a text; a null text is an empty one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b, label_a, label_b) whose full shingle sets have 100 |A & B| >= percent |A | B|, as their components (a, b).

    texts (b, text) has the text of each set once.  The text is joined to each
    side in turn; a leader of many pairs is a skewed key, which Spark splits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [x for _, _, sets in shingle_sets(batch.column("text_a"), width) for x in sets]
            right = [x for _, _, sets in shingle_sets(batch.column("text_b"), width) for x in sets]
            shared = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right, strict=True)], np.int64)
            union = np.array([len(x) + len(y) for x, y in zip(left, right, strict=True)], np.int64) - shared
            yield pa.RecordBatch.from_arrays([batch.column("label_a"), batch.column("label_b")], ["a", "b"]).filter(pa.array(100 * shared >= percent * union))

    one = texts.select(F.col("b").alias("a"), F.col("text").alias("text_a"))
    two = texts.select("b", F.col("text").alias("text_b"))
    full = pairs.join(one, "a").join(two, "b")
    return map_arrow(full.select("label_a", "label_b", "text_a", "text_b"), run, "a long, b long")


def _pairs(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) -> with their labels, without those of one component and those whose sizes alone rule them out."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    ends = pairs.where("a <> b").select(low.alias("a"), high.alias("b")).distinct()
    for k in "ab":
        ends = ends.join(nodes.select(F.col("b").alias(k), F.col("n").alias(f"n_{k}"), F.col("label").alias(f"label_{k}")), k)
    fits = F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b")
    return ends.where(fits).where("label_a <> label_b").select("a", "b", "label_a", "label_b")


def _mixed(crowd: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """Members (bucket, b, label) of buckets that hold more than one component; None if there are none."""
    named = materialize(crowd.select("bucket", "b").join(nodes.select("b", "label"), "b"), "members", few=True)
    split = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket")
    mixed = materialize(named.join(split, "bucket"), "mixed", few=True)
    release(named)
    if mixed.isEmpty():
        release(mixed)
        return None
    return mixed


def _posts(mixed: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The exact prefix filter's index of step 3: (s, b, n, label, after, most, mid) for each shingle in a set's prefix that components share.

    after: how many shared shingles come later in the set's order; most: the greatest size of a partner; mid: how many sets hold
    one of its shingles on average, which is highest for what a crowd's members are copies of.
    """
    members = mixed.select("b").distinct().join(nodes.select("b", "n", "label"), "b")
    held = materialize(held_shingles(members, texts, width).join(members, "b"), "held")
    across = held.groupBy("s").agg(F.count("*").alias("d"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("s", "d")
    own = Window.partitionBy("b")
    places = F.count("*").over(own).alias("c"), (F.sum("d").over(own) / F.col("n")).alias("mid"), F.row_number().over(own.orderBy("d", "s")).alias("nth")
    ranked = held.join(across, "s").select("b", "n", "label", "s", *places)
    # The n - c shingles that one component holds come first in the order.
    prefix = F.expr(f"n - ({percent} * n + 99) div 100 + 1 - (n - c)")
    most = F.expr(f"((100 + {percent}) * c) div {percent} - n").alias("most")
    posts = materialize(ranked.where(F.col("nth") <= prefix).select("s", "b", "n", "label", (F.col("c") - F.col("nth")).alias("after"), most, "mid"), "posts")
    release(held)
    return posts


def _open(posts: DataFrame) -> DataFrame:
    """posts of shingles that still cross components, of sets that some partner's size fits."""
    lists = posts.groupBy("s").agg(F.min("n").alias("least"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("s", "least")
    return posts.join(lists, "s").where("most >= least").drop("least")


def _fitting(posts: DataFrame, other: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a shingle's sets in different components that can be linked."""
    other = other.select("s", *[F.col(x).alias(y) for x, y in (("b", "a"), ("n", "n_a"), ("label", "label_a"), ("most", "most_a"), ("after", "after_a"))])
    # At the first shared shingle both sides' remainders must still hold enough.
    enough = f"(100 + {percent}) * (1 + least(after, after_a)) >= {percent} * (n + n_a)"
    return posts.join(other, "s").where(f"label <> label_a and n <= most_a and n_a <= most and {enough}").select("a", "b")


def _relabelled(posts: DataFrame, nodes: DataFrame) -> DataFrame:
    """posts with the labels of now; the old table goes."""
    new = materialize(posts.drop("label").join(nodes.select("b", "label"), "b"), "posts")
    release(posts)
    return new


def linked_sets(own: DataFrame, feats: DataFrame, width: int, percent: int) -> DataFrame:
    """Components of set_features(own): (node, label), both set keys, for every set that shares a bucket with another.

    Sets go by a long id inside, which is written once with their table.  Each step confirms pairs between components only
    and joins what it links; edges are never gone over again.
    """
    where = F.struct("text_key", "doc_id")
    reps = feats.where("n_shingles > 0").groupBy("set_key").agg(F.first("n_shingles").alias("n"), F.min(where).alias("at"), F.first("bands").alias("bands"))
    reps = materialize(reps.select(F.monotonically_increasing_id().alias("b"), "set_key", "n", "at", "bands"), "reps")
    in_band = reps.select("b", F.explode("bands").alias("bucket"))
    shared = in_band.groupBy("bucket").agg(F.min("b").alias("a"), F.max("b").alias("z")).where("a <> z").drop("z")
    crowd = materialize(in_band.join(shared, "bucket"), "crowd")
    # The sets that share a bucket with another, and a text of each.
    picked = reps.join(crowd.select("b").distinct(), "b").select("b", "set_key", "n", F.col("b").alias("label"), "at.text_key", "at.doc_id")
    nodes = materialize(picked, "nodes", few=True)
    release(reps)
    at = nodes.select(F.col("b").alias("at"), F.col("text_key").alias("at_key"), F.col("doc_id").alias("at_id"))
    # Few needed texts are picked out where they are read; many meet theirs by shuffling.
    at = F.broadcast(at) if nodes.count() <= BROADCAST_ROWS else at
    texts = own.join(at, (F.col("text_key") == F.col("at_key")) & F.col("doc_id").eqNullSafe(F.col("at_id")))
    texts = materialize(texts.select(F.col("at").alias("b"), "text").dropDuplicates(["b"]), "texts")

    def more(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
        """nodes with the labels after what the pairs link."""
        links = materialize(confirmed(_pairs(pairs, nodes, percent), texts, width, percent).distinct(), "links", few=True)
        if links.isEmpty():
            release(links)
            return nodes
        joined = connected_components(links).select(F.col("node").alias("label"), F.col("label").alias("new"))
        named = nodes.join(joined, "label", "left").withColumn("label", F.coalesce("new", "label")).drop("new")
        named = materialize(named.select(*nodes.columns), "nodes", few=True)
        release(links, nodes, joined)
        return named

    nodes = more(nodes, crowd.select("a", "b"))
    if (mixed := _mixed(crowd, nodes)) is not None:
        members = mixed.select("b").distinct().join(nodes.select("b", "n"), "b")
        held = materialize(held_shingles(members, texts, width, SAMPLED), "sampled")
        lone = held.groupBy("s").agg(F.min("b").alias("b"), F.count("*").alias("d")).where("d = 1").groupBy("b").agg(F.count("*").alias("lone"))
        alone = members.join(lone, "b", "left").select("b", (F.coalesce("lone", F.lit(0)) / F.col("n")).alias("share"))
        hubs = mixed.join(alone, "b").groupBy("bucket").agg(F.min(F.struct("share", "b", "label")).alias("hub"))
        far = materialize(mixed.join(hubs, "bucket").where("label <> hub.label").select("b", F.col("hub.b").alias("a")).distinct(), "far", few=True)
        release(held)
        nodes = more(nodes, far)
        if (rest := _mixed(mixed, nodes)) is not None:
            posts = _posts(rest, nodes, texts, width, percent)
            for turn in range(POST_TURNS):
                # Everyone on a shingle's list with a few of the list, at first with its middle too: what isn't linked to that
                # mostly shares too little with anyone.
                lists = _open(posts)
                row = F.struct(*posts.columns)
                first = [F.struct(-F.col("mid"), "b")] if turn == 0 else []
                orders = first + [F.xxhash64(F.lit(turn * HEADS + k), "b") for k in range(len(first), HEADS)]
                heads = lists.groupBy("s").agg(*[F.min_by(row, order).alias(f"h{k}") for k, order in enumerate(orders)])
                heads = heads.select(F.explode(F.array_distinct(F.array(*[f"h{k}" for k in range(HEADS)]))).alias("h")).select("h.*")
                nodes = more(nodes, _fitting(lists, heads, percent))
                posts = _relabelled(posts, nodes)
            # What still crosses components, all of it.
            lists = _open(posts)
            nodes = more(nodes, _fitting(lists, lists, percent).where("a < b"))
            release(rest, posts)
        release(mixed, far)
    heads = nodes.where("b = label").select("label", F.col("set_key").alias("head"))
    named = materialize(nodes.join(heads, "label").select(F.col("set_key").alias("node"), F.col("head").alias("label")), "linked", few=True)
    release(crowd, nodes, texts)
    return named


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, keys: Keys = min_max_bands) -> DataFrame:
    """Groups of documents linked by Jaccard similarity of their width-word shingle sets.

    docs has doc_id (long) and text; other columns are ignored.  Returns one row
    per input row: doc_id, text_key (128 bits of the text), n_shingles, group_key
    (names the component), component_id (the least doc_id of the component) and
    kept (doc_id = component_id).  Links are 100 * intersection >= percent *
    union of full sets; components are their transitive closure.  Null and blank
    texts have the empty set and are linked with nothing.  A text of fewer than
    width words has its whole sequence as its one shingle; of a very long one all shingles count.  Repeated rows are
    linked as equal sets are.  A null doc_id is never the least unless its
    component has no other; then component_id is null and kept is false.  An
    empty table gives no rows.  keys gives each text's band keys from its shingles.
    Runs eagerly but for the last join.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_key", text_key(F.col("text")))
    wide = materialize(set_features(own, width, keys), "sets")
    labels = linked_sets(own, wide, width, percent)
    feats = materialize(wide.drop("bands"), "sets")
    release(wide)
    least = feats.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("least"))
    named = least.join(labels.withColumnRenamed("node", "set_key"), "set_key")
    lowest = named.groupBy("label").agg(F.min("least").alias("lowest"))
    ids = named.join(lowest, "label").select("set_key", "label", "lowest")
    # Sets without a link are components of their own: equal sets, named by their least doc_id.
    alone = least.join(labels.select(F.col("node").alias("set_key")), "set_key", "left_anti").select("set_key", F.col("set_key").alias("label"), F.col("least").alias("lowest"))
    ids = materialize(ids.unionByName(alone), "ids")
    release(labels)
    out = _by_row(feats, ids)
    out._lithic_from = (feats, ids)
    return out


def _by_row(feats: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for each of feats; a set with many copies is a skewed key of a plain join, which Spark splits."""
    rows = feats.join(ids, "set_key", "left")
    blank = F.col("n_shingles") == 0
    own_id = F.when(blank, F.col("doc_id")).otherwise(F.col("lowest"))
    out = rows.select("doc_id", "text_key", "n_shingles", F.coalesce("label", "set_key").alias("group_key"), own_id.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each near-duplicate group, all columns as they were.

    The row kept has the group's least doc_id (nulls last, then the least text key;
    of rows equal in both any one).  Rows without words (null, empty and blank texts) stay, all of them.
    Groups are near_duplicates', so very long texts count whole; columns may have any names, those of its
    result too; an empty table gives an empty one.
    """
    found = near_duplicates(docs, width, percent)
    links = found.where("n_shingles > 0")
    rows = links.groupBy("group_key", "doc_id", "text_key").agg(F.count("*").alias("times"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    first = rows.groupBy("group_key").agg(F.min(order).alias("first"))
    stays = (F.col("text_key") == F.col("first.text_key")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    judged = rows.join(first, "group_key").withColumn("again", stays).where(~stays | (F.col("times") > 1))
    # The rows that go, and with again those of which one stays: few beside the documents.
    judged = materialize(judged.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"), "again"), "gone", few=True)
    release(*found._lithic_from)
    small = judged.count() <= BROADCAST_ROWS
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col("doc_id").cast("long").alias("id"), text_key(F.col("text")).alias("key"))
    same = (F.col("key") == F.col("gone_key")) & F.col("id").eqNullSafe(F.col("gone_id"))
    kept = keyed.join(F.broadcast(judged) if small else judged, same, "left_anti").select("row.*")
    again = judged.where("again")
    if again.isEmpty():
        return kept
    nth = F.row_number().over(Window.partitionBy("key", "id").orderBy("key"))
    one = keyed.join(F.broadcast(again) if small else again, same, "left_semi").withColumn("nth", nth).where("nth = 1")
    return kept.unionByName(one.select("row.*"))
