"""Packing token sequences by best-fit decreasing.

Each task packs the documents of its own input split: a document's full windows become sequences
of their own; what is left of it is placed, longest first, in the open window
with the least room that still takes it, found in a segment tree over room.
Texts are never shuffled.  Windows that a task leaves with much room are taken apart again,
and their pieces, rows of five numbers, are dealt out anew and packed together, so small splits
cost no padding either.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.llm.store import map_arrow, materialize
from lithic.llm.words import Remembered, cut_at_spaces, parted, row_slices

WINDOW = 4096
#: Remainders that a task holds before it places them (five numbers each); open windows stay open for later ones.
HELD = 1 << 20
#: A task's windows with more room than a window's part of this are packed again with those of other tasks.
ROOMY = 32
#: Pieces that one task packs again, about.
AGAIN = 200_000
#: Bytes of text that are looked at together.
SLICE = 1 << 22
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
PACKED = ", ".join(f"{n} long" for n in NAMES)


class Rooms:
    """Open windows by their room: a segment tree of counts finds the least room that is enough."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: dict[int, list[int]] = {}

    def _add(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, room: int, window: int) -> None:
        if room:
            self.open.setdefault(room, []).append(window)
            self._add(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """The (window, room) of least room >= length, which is no longer open; None if there is none."""
        at = length + self.leaves
        if not self.count[at]:
            # Up to the first right sibling that has a window, then down along its left edge.
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._add(room, -1)
        return self.open[room].pop(), room


def best_fit_decreasing(lengths: np.ndarray, window: int, rooms: Rooms | None = None, windows: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """For each length (1 to window) its window and offset, and how many windows there are. Equal lengths keep their order.

    rooms has the windows that are open already, windows is how many there were.
    """
    where = np.zeros(len(lengths), np.int64)
    offset = np.zeros(len(lengths), np.int64)
    rooms = rooms or Rooms(window)
    for k in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[k])
        if found := rooms.take(length):
            at, room = found
        else:
            at, room = windows, window
            windows += 1
        where[k], offset[k] = at, window - room
        rooms.put(room - length, at)
    return where, offset, windows


def gather(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """values[first : first + count] of each row, one after the other."""
    ends = np.cumsum(count)
    at = np.repeat(first - (ends - count), count)
    at += np.arange(len(at))
    return values[at]


class Encoder(Remembered):
    """Texts to token ids, for a word-level BPE that lower-cases, marks word ends and drops white space.

    No piece spans a space or a line break, so texts are cut there and each distinct part is
    encoded once; a text's ids are gathered by its parts' numbers.  A full
    stop or comma that ends a word stands alone for the tokenizer, so it is encoded alone.  The strings of special tokens in a
    text are ordinary text.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for piece, at in self.tokenizer.get_vocab().items():
            self.ends[at] = piece.endswith("</w>")
        stops = {c: self._plain([c])[0] for c in ".,"}
        self.stops = {c: int(ids[0]) for c, ids in stops.items() if len(ids) == 1}
        #: Where each known part's ids are in ids.
        self.first, self.count, self.ids = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(got.ids, np.uint32) for got in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each word where its own begin in them and how many they are.

        Words of letters go in lines, where each should end with one piece that ends a word; a line that doesn't add up goes word by word.
        """
        first, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        letters = np.array([k for k, w in enumerate(words) if w.isalpha()], np.int64)
        alone = np.array([k for k, w in enumerate(words) if not w.isalpha()], np.int64)
        at, parts = 0, [np.zeros(0, np.uint32)]
        lines = [letters[k : k + 200] for k in range(0, len(letters), 200)]
        for line, ids in zip(lines, self._plain([" ".join([words[k] for k in line.tolist()]) for line in lines]), strict=True):
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(line) and stops[-1] == len(ids):
                first[line] = at + np.r_[0, stops[:-1]]
                count[line] = at + stops - first[line]
                parts.append(ids)
                at += len(ids)
            else:
                alone = np.append(alone, line)
        own = self._plain([words[k] for k in alone.tolist()])
        count[alone] = [len(ids) for ids in own]
        first[alone] = at + np.cumsum(count[alone]) - count[alone]
        return np.concatenate([*parts, *own]), first, count

    def learn(self, new: list[str]) -> None:
        ids, first, count = self._encoded(new)
        self.first, self.count = np.r_[self.first, len(self.ids) + first], np.r_[self.count, count]
        self.ids = np.r_[self.ids, ids]

    def keep(self, kept: np.ndarray) -> None:
        self.ids, self.count = gather(self.ids, self.first[kept], self.count[kept]), self.count[kept]
        self.first = np.cumsum(self.count) - self.count

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has. Null texts have none."""
        parts, begins = parted(texts)
        distinct = parts.dictionary
        stop = np.full(len(distinct), -1, np.int64)
        for c, one in self.stops.items():
            stop[pc.match_substring_regex(distinct, f"[a-z][{c}]$").to_numpy(zero_copy_only=False)] = one
        bare = pc.if_else(pa.array(stop >= 0), pc.utf8_slice_codeunits(distinct, 0, -1), distinct)
        number, at = self.numbers(bare), parts.indices.to_numpy()
        first, count, stop = self.first[number][at], self.count[number][at], stop[at]
        stopped = stop >= 0
        # A stop's place gets some id first, then its own.
        ids = gather(np.append(self.ids, np.uint32(0)), first, count + stopped)
        ends = np.cumsum(count + stopped)
        ids[ends[stopped] - 1] = stop[stopped]
        return ids, np.diff(np.r_[0, ends][begins])

    def encode_long(self, text: str) -> np.ndarray:
        """The ids of one text, SLICE characters at a time, cut at spaces."""
        return np.concatenate([np.zeros(0, np.uint32), *(self.encode(pa.array([x], pa.string()))[0] for x in cut_at_spaces(text, SLICE))])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _batch(columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], NAMES)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = WINDOW) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    docs has doc_id and text; other columns are ignored, whatever their names.  A document is the ids of
    its text, then end_id; a null or empty text is end_id alone.  Documents of
    more than window tokens, however long, are cut into full windows and a rest; other documents stay in
    one piece.  Pieces of a sequence follow each other from offset 0 without gaps; sequence_id
    names the task that packed it and a number within it.  Repeated rows and null ids are
    packed like any others, equal lengths in the order they come; an empty table gives no rows.  ids_crc32 is the CRC-32 of
    the piece's ids as little-endian uint32.

    Best-fit decreasing sees a task's split at once (HELD remainders, beyond which the windows stay open for
    the next ones), so which documents share a sequence depends on how the input is split; how full sequences are hardly does, as
    windows with much room are packed again across tasks.  Runs eagerly but for that second packing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        rooms, windows = Rooms(window), 0
        full = 0  # windows of one piece are numbered downwards from the end
        held: list[tuple] = []
        done: list[tuple] = []

        def placed(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal windows
            ids = pa.array([p[0] for p in held], pa.int64())
            rest = np.array([p[1:] for p in held], np.int64).reshape(-1, 4)
            held.clear()
            where, offset, n = best_fit_decreasing(rest[:, 1], window, rooms, windows)
            named = base + where
            if last:
                left = np.full(n - windows, window, np.int64)
                np.subtract.at(left, where[where >= windows] - windows, rest[where >= windows, 1])
                again = np.r_[np.zeros(windows, bool), left > window // ROOMY][where]
                named, offset = pa.array(named, mask=again), pa.array(offset, mask=again)
            windows = n
            yield _batch([ids, *rest.T, named, offset])

        for batch in batches:
            for row, stop in row_slices(batch.column("text"), SLICE):
                texts = batch.column("text").slice(row, stop - row)
                if stop - row == 1 and len(text := texts[0].as_py() or "") > SLICE:
                    ids = encode.encode_long(text)
                    counts = np.array([len(ids)])
                else:
                    ids, counts = encode.encode(texts)
                raw, at = memoryview(ids.astype("<u4").tobytes()), 0
                for doc, n in zip(batch.column("doc_id").slice(row, stop - row).to_pylist(), counts.tolist(), strict=True):
                    for start in range(0, n + 1, window):
                        length = min(window, n + 1 - start)
                        own = raw[4 * (at + start) : 4 * (at + min(n, start + length))]
                        crc = zlib.crc32(own) if start + length <= n else zlib.crc32(end, zlib.crc32(own))
                        if length == window:
                            full += 1
                            done.append((doc, start, length, crc, n + 1, base + (1 << 36) - full, 0))
                        else:
                            held.append((doc, start, length, crc, n + 1))
                    at += n
                if len(done) >= 10_000:
                    yield _batch(list(zip(*done, strict=True)))
                    done.clear()
                if len(held) >= HELD:
                    yield from placed(False)
        if done:
            yield _batch(list(zip(*done, strict=True)))
        if held:
            yield from placed(True)

    def rerun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (1 << 62) + ((TaskContext.get().partitionId() if TaskContext.get() else 0) << 36)
        if rows := [b for b in batches if b.num_rows]:
            table = pa.Table.from_batches(rows).combine_chunks()
            where, offset, _ = best_fit_decreasing(table.column("length").to_numpy(), window)
            yield _batch([table.column(c).chunk(0) for c in NAMES[:5]] + [base + where, offset])

    pieces = materialize(map_arrow(docs.selectExpr("cast(doc_id as long) as doc_id", "text"), run, PACKED), "pieces")
    loose = pieces.where(F.col("sequence_id").isNull()).select(*NAMES[:5])
    parts = 1 + loose.count() // AGAIN
    return pieces.where(F.col("sequence_id").isNotNull()).unionByName(loose.repartition(parts).mapInArrow(rerun, PACKED))
