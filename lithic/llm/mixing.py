"""Mixing sources to target weights along a low-discrepancy schedule.

Every source's documents, shuffled by a hash, form a stream of words that repeats.
The stream is cut into blocks of equal word counts.  Slot i of the schedule has the
point frac(i * golden ratio); the source whose share of the targets
covers the point owns the slot.  Slots are ranked within their source, and the slot of rank r takes
the source's block r.  A source's last block is cut where its target ends.  So every stretch of the
schedule has the sources near their shares, and a document has the slots at which its words are taken.

Nothing is ordered in one task but the table of sources (a few numbers each): streams and schedule are
summed by ranges, ranges by ranges of ranges, and equal rows are spread, so no window has more than some thousand
rows or a millionth of the rows, whatever a source holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithic.llm.store import map_arrow, materialize, release
from lithic.llm.words import SPACE, text_slices

#: Words in a block; documents, slots or ranges that one range of a running sum holds, about.
BLOCK, RANGE = 2048, 1000
#: A document is taken at most so often.
MOST = 3
#: 2**31 / golden ratio, odd: multiples of it modulo 2**31 are golden-ratio points, each once in 2**31 slots.
_GOLDEN = 1327217885
#: Rows of some 60 bytes up to which the list of what is taken, or of repeated rows, is broadcast.
BROADCAST_ROWS = 250_000
#: Words that a partition of the mixture holds, about.
PART_WORDS = 1 << 24


def word_count(text: Column) -> Column:
    r"""Runs of characters other than \x20 and \x09-\x0D; a null text has none."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(plain == "", F.lit(0)).otherwise(F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) + 1).cast("long")


def word_counts(texts: pa.Array) -> np.ndarray:
    """word_count of each text, in one pass over the bytes."""
    out = [np.zeros(0, np.int64)]
    for _, data, offsets in text_slices(texts):
        solid = ~SPACE[data]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        inner = offsets[1:-1][offsets[1:-1] < len(data)]
        begins[inner] = solid[inner]  # a text's first word begins where it does
        out.append(np.diff(np.r_[0, np.cumsum(begins)][offsets]))
    return np.concatenate(out)


def sized(docs: DataFrame) -> DataFrame:
    """docs -> doc_id, source, row_key (the text's MD5), size (its words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(word_counts(batch.column("text")))], ["doc_id", "source", "row_key", "size"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("row_key"), "text")
    return map_arrow(rows, run, "doc_id long, source string, row_key binary, size long")


def source_targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """(source, size) summed rows -> source, documents, source_size, weight, target, take (the target in whole words).

    Sources by code point, null last, weigh 1, 2, 3, repeating.  A target is the least of
    most * source_size and level * weight, where the level makes all targets add up to
    all sizes: what resharing any excess by weight comes to.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("documents"))
    order = Window.orderBy(F.col("source").isNull(), "source")  # a row for each source only
    per = per.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1)
    per = per.withColumn("cap", most * F.col("source_size"))
    # In the order of cap / weight the sources that stop at their cap come first.
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    all_ = Window.partitionBy()
    up_to = fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = per.withColumns({"caps": F.sum("cap").over(up_to) - F.col("cap"), "weights": F.sum("weight").over(all_) - F.sum("weight").over(up_to) + F.col("weight"), "total": F.sum("source_size").over(all_)})
    per = per.withColumn("level", (F.col("total") - F.col("caps")) / F.col("weights"))
    stops = F.col("level") * F.col("weight") >= F.col("cap")
    per = per.withColumn("final", F.coalesce(F.min(F.when(~stops, F.struct(F.col("cap") / F.col("weight"), "level"))).over(all_)["level"], F.lit(float("inf"))))
    target = F.least(F.col("cap").cast("double"), F.col("final") * F.col("weight"))
    return per.select("source", "documents", "source_size", "weight", target.alias("target"), F.floor(target + 0.5).cast("long").alias("take"))


def _running(df: DataFrame, by: str, group: str, order: list, size: Column) -> DataFrame:
    """df with `before`: the sum of size over the rows of the same `by` in lower groups, or in this group before in order.

    Groups are numbered in order; RANGE of them at a time are summed first.
    """
    sums = df.groupBy(by, group).agg(F.sum(size).alias("__sum")).withColumn("__top", F.floor(F.col(group) / RANGE))
    tops = sums.groupBy(by, "__top").agg(F.sum("__sum").alias("__all"))
    less = (Window.unboundedPreceding, -1)
    tops = tops.withColumn("__under", F.coalesce(F.sum("__all").over(Window.partitionBy(by).orderBy("__top").rowsBetween(*less)), F.lit(0))).drop("__all")
    within = F.coalesce(F.sum("__sum").over(Window.partitionBy(by, "__top").orderBy(group).rowsBetween(*less)), F.lit(0))
    sums = sums.withColumn("__in", within).join(tops, [by, "__top"]).select(by, group, (F.col("__under") + F.col("__in")).alias("__below"))
    inner = Window.partitionBy(by, group).orderBy(*order).rowsBetween(*less)
    return df.join(sums, [by, group]).withColumn("before", F.col("__below") + F.coalesce(F.sum(size).over(inner), F.lit(0))).drop("__below")


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """The slots (slot, source_no, rank, fill): fill words of block `rank` of the source's stream are taken at `slot`.

    targets has source_no and take.  A source gets as many slots as its take has blocks,
    the first of those whose points its share covers; the points are spread so evenly
    that a few more slots than blocks do for all.
    """
    order = Window.orderBy("source_no")
    own = targets.where("take > 0").select("source_no", "take").withColumn("blocks", F.ceil(F.col("take") / block).cast("long"))
    own = own.withColumns({"hi": F.sum("blocks").over(order.rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("blocks").over(Window.partitionBy())})
    own = own.withColumns({"lo": (F.col("hi") - F.col("blocks")) / F.col("all"), "hi": F.col("hi") / F.col("all")})
    total = own.agg(F.max("all"), F.count("*")).first()
    slots, sources = total[0] or 0, total[1]
    n = slot_count(slots)
    spark = targets.sparkSession
    points = spark.range(0, n).select(F.col("id").alias("slot"), ((F.col("id") % (1 << 31)) * _GOLDEN % (1 << 31) / float(1 << 31)).alias("u"))
    bins = max(1, min(1 << 20, 4 * sources))
    spread = own.select("source_no", "blocks", "take", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * bins), F.least(F.floor(F.col("hi") * bins), F.lit(bins - 1)))).alias("bin"))
    points = points.withColumn("bin", F.floor(F.col("u") * bins))
    owned = points.join(spread, "bin").where("u >= lo and u < hi").select("slot", "source_no", "blocks", "take")
    owned = owned.withColumn("chunk", F.floor(F.col("slot") / RANGE))
    ranked = _running(owned, "source_no", "chunk", ["slot"], F.lit(1)).withColumnRenamed("before", "rank").where("rank < blocks")
    got = ranked.groupBy("source_no").agg(F.count("*").alias("got"))
    late = own.join(got, "source_no", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < blocks")
    late = late.select((F.lit(n) + F.col("source_no")).alias("slot"), "source_no", "take", F.explode(F.sequence("got", F.col("blocks") - 1)).alias("rank"))
    every = ranked.select("slot", "source_no", "take", "rank").unionByName(late)
    return every.select("slot", "source_no", "rank", F.least(F.lit(block), F.col("take") - F.col("rank") * block).alias("fill"))


def slot_count(blocks: int) -> int:
    """Slots that give every source its blocks.

    A range of points gets its share of n slots to within a few; 64 and a 16th part more are ample for wide
    ranges, and a narrow one that is still short gets the slots after all others.
    """
    return blocks + blocks // 16 + 64


def _streams(docs: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Every row with its place in its source's stream (doc_id, source, row_key, size, source_no, source_size, target, take, before), and the targets."""
    rows = materialize(sized(docs), "sizes")
    targets = source_targets(rows, most)
    number = Window.orderBy(F.col("source").isNull(), "source")
    targets = materialize(targets.withColumn("source_no", F.row_number().over(number).cast("long")), "targets", few=True)
    known = targets.select(F.col("source").alias("s"), "source_no", F.ceil(F.col("documents") / RANGE).alias("ranges"), "source_size", "target", "take")
    named = rows.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    named = named.withColumn("spot", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.lower(F.hex("row_key")))))
    # Ranges of the hash in order: its first 32 bits times the number of ranges.
    first = F.conv(F.substring("spot", 1, 8), 16, 10).cast("long")
    named = named.withColumn("chunk", F.shiftright(first * F.col("ranges"), 32))
    # Rows equal in doc_id and text share a spot.  Where they are more than a range, they get ranges of their own
    # after all others; which of them comes first makes no difference.
    often = named.groupBy("source_no", "spot").agg(F.count("*").alias("equal")).where(F.col("equal") > RANGE)
    often = often.withColumn("at", F.sum(F.ceil(F.col("equal") / RANGE)).over(Window.partitionBy("source_no").orderBy("spot")) - F.ceil(F.col("equal") / RANGE))
    named = named.join(often, ["source_no", "spot"], "left")
    own = F.col("ranges") + F.col("at") + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.ceil(F.col("equal") / RANGE))
    named = named.withColumn("chunk", F.when(F.col("equal").isNull(), F.col("chunk")).otherwise(own).cast("long"))
    # The ranges that were drawn must stay as they are from here on.
    named = materialize(named.drop("documents", "ranges", "equal", "at"), "ranges")
    placed = _running(named, "source_no", "chunk", ["spot"], F.col("size"))
    placed = materialize(placed.select("doc_id", "source", "row_key", "size", "source_no", "source_size", "target", "take", "before"), "streams")
    release(rows, named)
    return placed, targets


def _taken(placed: DataFrame, targets: DataFrame, block: int, most: int) -> DataFrame:
    """(source_no, before, nth, first_slot, last_slot, taken): what the schedule takes of repeat nth of the document at a place of a stream."""
    # The parts of each repeat of each document that lie in one block of its source's stream.
    again = placed.where("size > 0 and take > 0").select("source_no", "before", "size", "source_size", "take", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("nth"))
    again = again.withColumn("at", F.col("nth") * F.col("source_size") + F.col("before")).where("at < take")
    last = F.floor((F.least(F.col("at") + F.col("size"), F.col("take")) - 1) / block)
    again = again.select("source_no", "before", "nth", "at", "size", F.explode(F.sequence(F.floor(F.col("at") / block), last)).alias("rank"))
    met = again.join(schedule(targets, block), ["source_no", "rank"])
    start, end = F.greatest("at", F.col("rank") * block), F.least(F.col("at") + F.col("size"), F.col("rank") * block + F.col("fill"))
    # Words stand at their place in a stream, so (source_no, before) names a document that has any.
    return met.groupBy("source_no", "before", "nth").agg(F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.sum(F.greatest(end - start, F.lit(0))).cast("long").alias("taken"))


def mix_sources(docs: DataFrame, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """A row for each row of docs: doc_id, size, source_size, target, taken, first_slot, last_slot.

    docs has doc_id, text and source; other columns are ignored, whatever their names.  size is the text's word_count;
    targets are source_targets'; taken is how many of the row's words the schedule takes,
    repeats counted, most * size at most, and the slots are the first and the last at which it does (null if none).  A source takes its target to the word.
    The order within a source is by the MD5 of doc_id and the text's MD5, so reruns
    agree; rows equal in both are interchangeable.  Null, empty and blank texts have
    no words and nothing is taken of them; a very long text lies in as many blocks as it fills; a null source is a source, a null doc_id
    an empty one in the order; an empty table gives no rows.
    """
    placed, targets = _streams(docs, most)
    taken = _taken(placed, targets, block, most).groupBy("source_no", "before").agg(F.min("first_slot").alias("first_slot"), F.max("last_slot").alias("last_slot"), F.sum("taken").alias("taken"))
    rows = placed.where("size > 0").join(taken, ["source_no", "before"], "left")
    out = rows.unionByName(placed.where("size = 0"), allowMissingColumns=True)
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", "last_slot")


def mixture(docs: DataFrame, block: int = BLOCK, most: int = MOST, slot: str = "slot") -> DataFrame:
    """The mixture itself: the columns of docs and a column (named slot) of where in the schedule a row comes, for each time a document is taken.

    Partitions are stretches of the schedule, in order of slot.  A document that is taken in part has that many of its first words, parted by single spaces, in
    one more row, and n_chars, if there is such a column, is counted anew.  Rows of which nothing is taken go, those without words among them; of rows equal in doc_id,
    text and source one stands for all.  Sources, nulls, ties and long texts are as in mix_sources(); columns may have any names; an
    empty table gives an empty one.
    """
    placed, targets = _streams(docs, most)
    keys = ["__id", "__key", "__source"]
    takes = _taken(placed, targets, block, most).join(placed, ["source_no", "before"])
    takes = takes.where("size > 0").select(F.col("doc_id").alias("to_id"), F.col("row_key").alias("to_key"), F.col("source").alias("to_source"), F.col("first_slot").alias("__slot"), F.col("taken").alias("__taken"), F.col("size").alias("__size"))
    takes = materialize(takes, "takes")
    equal = placed.where("size > 0").groupBy("doc_id", "row_key", "source").agg(F.count("*").alias("rows")).where("rows > 1")
    equal = materialize(equal.select(F.col("doc_id").alias("to_id"), F.col("row_key").alias("to_key"), F.col("source").alias("to_source")), "equal", few=True)
    release(placed, targets)
    words, many = takes.agg(F.coalesce(F.sum("__taken"), F.lit(0)), F.count("*")).first()
    repeated = equal.count()
    same = F.col("__id").eqNullSafe(F.col("to_id")) & (F.col("__key") == F.col("to_key")) & F.col("__source").eqNullSafe(F.col("to_source"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col("doc_id").cast("long").alias("__id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("__key"), F.col("source").cast("string").alias("__source"))
    if repeated:
        known = F.broadcast(equal) if repeated <= BROADCAST_ROWS else equal
        rows = rows.join(known, same, "left_anti").unionByName(rows.join(known, same, "left_semi").dropDuplicates(keys))
    met = rows.join(F.broadcast(takes) if many <= BROADCAST_ROWS else takes, same)
    part = F.col("__taken") < F.col("__size")
    plain = F.trim(F.regexp_replace(F.col("row.text"), r"[\x20\x09-\x0D]+", " "))
    cut = F.when(part, F.array_join(F.slice(F.split(plain, " "), F.lit(1), F.col("__taken").cast("int")), " "))
    stretches = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), words // PART_WORDS)
    width = max(1, -(-(slot_count(-(-words // block)) + 1) // stretches))
    met = met.select("row", "__slot", cut.alias("__cut")).repartitionById(stretches, F.least(F.floor(F.col("__slot") / width), F.lit(stretches - 1)).cast("int")).sortWithinPartitions("__slot")
    kept = {"text": F.coalesce("__cut", F.col("row.text"))}
    if "n_chars" in docs.columns:
        kept["n_chars"] = F.when(F.col("__cut").isNull(), F.col("row.n_chars")).otherwise(F.length("__cut").cast(docs.schema["n_chars"].dataType))
    return met.select(*[kept.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns], F.col("__slot").alias(slot))


def apply_mix(docs: DataFrame, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """mixture() with the columns of docs alone: a row each time a document is taken, partition after partition along the schedule.

    Nulls, empty and very long texts, ties, repeated rows, empty tables and columns of any names give what they give there.
    """
    spare = "slot"
    while spare in docs.columns:
        spare += "_"
    return mixture(docs, block, most, spare).drop(spare)
