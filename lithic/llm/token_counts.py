"""Word-piece token counts by a linear longest-match automaton.

The vocabulary's trie gets failure links: when no longer piece fits, the link of
a state leads to the state that the greedy longest match would be in after its
pieces are split off, and the number of those pieces is precomputed.  So each byte
is looked at a bounded number of times on average and no piece is ever built.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.llm.store import map_arrow
from lithic.llm.words import Remembered, cut_at_spaces, parted, row_slices

#: Fixed value: what this kind of vocabulary writes at the end of a word.
WORD_END = "</w>"
#: Words: runs of letters, single digits, runs of other visible characters.
WORD = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Bytes of text that are looked at together.
SLICE = 1 << 22
_END = 256


class LongestMatch:
    """Greedy longest-match lengths over sequences of symbols (bytes, then the end-of-word symbol).

    A sequence whose greedy match gets stuck counts as one unknown token, as in word-piece.
    """

    def __init__(self, pieces: Iterable[tuple[int, ...]]):
        self.next: list[dict[int, int]] = [{}]
        last: list[bool] = [False]
        for piece in pieces:
            at = 0
            for symbol in piece:
                if symbol not in self.next[at]:
                    self.next[at][symbol] = len(self.next)
                    self.next.append({})
                    last.append(False)
                at = self.next[at][symbol]
            last[at] = at != 0
        # fail: the state after splitting off pieces, -1 if none can be; pops: how many pieces that is.
        self.fail, self.pops = [-1] * len(last), [0] * len(last)
        queue = deque((0, s, child) for s, child in self.next[0].items())
        while queue:
            parent, symbol, at = queue.popleft()
            if last[at]:
                self.fail[at], self.pops[at] = 0, 1
            else:
                back, pops = self.fail[parent], self.pops[parent]
                while back >= 0 and symbol not in self.next[back]:
                    pops += self.pops[back]
                    back = self.fail[back]
                if back >= 0:
                    self.fail[at], self.pops[at] = self.next[back][symbol], pops
            queue.extend((at, s, child) for s, child in self.next[at].items())

    def count(self, symbols: Iterable[int]) -> int:
        """How many pieces the greedy longest match has."""
        at, pieces, some = 0, 0, False
        for symbol in symbols:
            some = True
            while symbol not in self.next[at]:
                if at == 0 or self.fail[at] < 0:
                    return 1
                pieces += self.pops[at]
                at = self.fail[at]
            at = self.next[at][symbol]
        while at:
            if self.fail[at] < 0:
                return 1
            pieces += self.pops[at]
            at = self.fail[at]
        return pieces if some else 0


def _bytes_of_characters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a visible character: itself if it is one, else the next free one from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


def vocabulary_pieces(path: str) -> list[tuple[int, ...]]:
    """The pieces of a byte-level vocabulary file with word ends, special tokens left out."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {x["content"] for x in spec.get("added_tokens", [])}
    as_byte = _bytes_of_characters()
    out = []
    for piece in spec["model"]["vocab"]:
        if piece not in special:
            ends = piece.endswith(WORD_END) and len(piece) > len(WORD_END)
            out.append((*(as_byte[c] for c in (piece.removesuffix(WORD_END) if ends else piece)), *([_END] * ends)))
    return out


class Counter(Remembered):
    """Words and tokens of distinct parts of texts."""

    def __init__(self, path: str):
        super().__init__()
        self.automaton = LongestMatch(vocabulary_pieces(path))
        self.words, self.tokens = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def learn(self, new: list[str]) -> None:
        words = [WORD.findall(part.lower()) for part in new]
        # Parts share words; a word's pieces are counted once for all of these.
        length = {w: self.automaton.count([*w.encode(), _END]) for w in {w for found in words for w in found}}
        self.words = np.r_[self.words, np.fromiter(map(len, words), np.int64, len(words))]
        self.tokens = np.r_[self.tokens, np.fromiter((sum(map(length.__getitem__, found)) for found in words), np.int64, len(words))]

    def keep(self, kept: np.ndarray) -> None:
        self.words, self.tokens = self.words[kept], self.tokens[kept]

    def count(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many words and tokens each text has."""
        parts, begins = parted(texts)
        at = self.numbers(parts.dictionary)[parts.indices.to_numpy()]
        return tuple(np.diff(np.r_[0, np.cumsum(of[at])][begins]) for of in (self.words, self.tokens))


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_tokens.

    docs has doc_id and text; other columns are ignored, whatever their names.  Texts are lower-cased and cut into WORDs;
    n_tokens adds up each word's greedy longest-match pieces over the vocabulary's bytes, the last of which
    carries the word's end.  A word that can't be matched is one token.  Null and blank texts have 0 of both; repeated rows are
    counted each; whole texts count, very long ones a few MB at a time; an empty table gives no rows.  The vocabulary
    is read from a path that every executor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary_path not in _counters:
            _counters[vocabulary_path] = Counter(vocabulary_path)
        counter = _counters[vocabulary_path]
        for batch in batches:
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for row, stop in row_slices(batch.column("text"), SLICE):
                texts = batch.column("text").slice(row, stop - row)
                if stop - row == 1 and len(text := texts[0].as_py() or "") > SLICE:
                    parts = [counter.count(pa.array([x], pa.string())) for x in cut_at_spaces(text, SLICE)]
                    found.append(tuple(sum(x, start=np.zeros(1, np.int64)) for x in zip(*parts, strict=True)))
                else:
                    found.append(counter.count(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.concatenate(x)) for x in zip(*found, strict=True))], ["doc_id", "n_words", "n_tokens"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_words long, n_tokens long")
