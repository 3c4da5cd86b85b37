"""Vectorised words, shingles and their hashes over Arrow string arrays.

Everything works on UTF-8 bytes: the white space that parts words is ASCII, so
no multi-byte character is ever cut.  Hashes depend on the bytes alone and are
equal on every machine.  Memory per call is bounded by the longest single text
plus SLICE bytes of others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Punctuation: every ASCII byte that is no letter, digit or white space.
PUNCT = np.array([b < 128 and not SPACE[b] and not chr(b).isalnum() for b in range(256)])

_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """_BASE**i and its inverse powers modulo 2**64, for i < n at least."""
    if len(_powers[0]) < n:
        size = max(n, SLICE + (SLICE >> 1))
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U64)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def span_hasher(data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function from spans (starts, ends) of data to 64-bit hashes of their bytes: a rolling polynomial, then mix()."""
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * power[: len(data)], out=sums[1:])

    def hashes(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (sums[ends] - sums[starts]) * inverse[starts]
        return mix(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))

    return hashes


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for each span."""
    return span_hasher(data)(starts, ends)


def text_slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows of about limit bytes: first row, bytes, offsets (one more than rows). Null texts are empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type)
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(off, off[row] + limit, "right")) - 1)
        last = min(last, len(texts))
        yield row, data[off[row] : off[last]], off[row : last + 1] - off[row]
        row = last


def _edges(kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal non-zero kind that stay within one text."""
    n = len(kind)
    cut = np.empty(n + 1, bool)
    cut[0] = cut[n] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:n])
    cut[offsets] = True
    at = np.flatnonzero(cut)
    keep = kind[at[:-1]] != 0
    return at[:-1][keep], at[1:][keep]


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of non-white bytes (A-Z lower-cased if lower), and how many each text has."""
    if not len(data):
        return np.zeros(0, U64), np.zeros(len(offsets) - 1, np.int64)
    starts, ends = _edges(~SPACE[data], offsets)
    hashes = span_hashes(LOWER[data] if lower else data, starts, ends)
    return hashes, np.diff(np.searchsorted(starts, offsets))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of letters and digits."""
    return _edges(~(SPACE | PUNCT)[data], offsets) if len(data) else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters and digits, and runs of punctuation: hashes, starts, ends, how many each text has."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, U64), none, none, np.zeros(len(offsets) - 1, np.int64)
    kind = np.where(SPACE[data], 0, np.where(PUNCT[data], 2, 1)).astype(np.int8)
    starts, ends = _edges(kind, offsets)
    return span_hashes(data, starts, ends), starts, ends, np.diff(np.searchsorted(starts, offsets))


def fold(words: np.ndarray, width: int) -> np.ndarray:
    """Order-dependent hashes of every width words in a row; len(words) - width + 1 of them."""
    n = len(words) - width + 1
    out = np.full(n, width * 0x2545F4914F6CDD1D & (1 << 64) - 1, U64)
    for k in range(width):
        out = mix(out * U64(0xD1342543DE82EF95) + words[k : k + n])
    return out


def shingles_of(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's width-word shingles in order, and how many each text has.

    A text of fewer words has its whole sequence as one shingle; one without words has none.
    """
    ends = np.cumsum(counts)
    starts = ends - counts
    many = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    short = np.flatnonzero((counts > 0) & (counts < width))
    full = np.flatnonzero(counts >= width)
    out = np.empty(int(many.sum()), U64)
    first = np.cumsum(many) - many
    if len(full):
        every = fold(words, width)
        size = many[full]
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(first[full], size) + within] = every[np.repeat(starts[full], size) + within]
    for d in short:
        out[first[d]] = fold(words[starts[d] : ends[d]], int(counts[d]))[0]
    return out, many


# ---- distinct parts of texts -------------------------------------------------


def row_slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about limit bytes; a longer text is alone."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < len(size):
        before = size[row - 1] if row else 0
        last = min(len(size), max(row + 1, int(np.searchsorted(size, before + limit, "right"))))
        yield row, last
        row = last


def cut_at_spaces(text: str, limit: int) -> Iterator[str]:
    """A text in pieces of about limit characters, each but the first beginning with the space or line break that it was cut at."""
    at = 0
    while at < len(text):
        end = at + limit
        if end < len(text) and (end := max(text.rfind(" ", at, end), text.rfind("\n", at, end))) <= at:
            later = [x for x in (text.find(" ", at + limit), text.find("\n", at + limit)) if x >= 0]
            end = min(later, default=len(text))
        yield text[at:end]
        at = end


def parted(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All parts of texts between spaces and line breaks, numbered by a hash table, A-Z lower-cased; and where each text's begin.

    Null texts are empty; an empty text has one empty part.
    """
    low = pc.replace_substring(pc.ascii_lower(texts.fill_null("")), "\n", " ")
    parts = pc.split_pattern(low, " ")
    return parts.flatten().dictionary_encode(), parts.offsets.to_numpy()


class Remembered:
    """Numbers of strings, by which something is known of each; beyond LIMIT strings only those in use stay known."""

    LIMIT = 600_000

    def __init__(self) -> None:
        self.known = pa.array([""], pa.string())

    def learn(self, new: list[str]) -> None:
        """Works out what is known of strings that get the next numbers."""
        raise NotImplementedError

    def keep(self, kept: np.ndarray) -> None:
        """Leaves only what is known of these numbers, in their order."""
        raise NotImplementedError

    def numbers(self, strings: pa.Array) -> np.ndarray:
        at = pc.index_in(strings, value_set=self.known)
        new = strings.filter(pc.is_null(at)).dictionary_encode()
        at = pc.fill_null(at, -1).to_numpy().copy()
        if len(new):
            if len(self.known) + len(new.dictionary) > self.LIMIT:
                kept, own = np.unique(np.r_[0, at[at >= 0]], return_inverse=True)
                self.known = self.known.take(pa.array(kept))
                self.keep(kept)
                at[at >= 0] = own[1:]
            at[at < 0] = len(self.known) + new.indices.to_numpy()
            self.learn(new.dictionary.to_pylist())
            self.known = pa.concat_arrays([self.known, new.dictionary])
        return at
