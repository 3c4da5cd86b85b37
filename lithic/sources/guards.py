"""Bounds for files that aren't trusted: checked on footers and page headers before data is decoded.

Rows and bytes are bounded for what is held at once: a row group of the model's columns.  The total
of a table is bounded only where all of it comes to the caller (Scan.to_array), so a scan may be as large as it likes.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithic.plans.model import Column as ModelColumn
from lithic.plans.resolve import InvalidData
from lithic.sources import footer


# The limits' defaults.
@dataclass(frozen=True)
class Limits:
    max_allocation_values: int = 10_000_000
    max_allocation_bytes: int = 256 * 1024 * 1024
    max_dictionary_entries: int = 1_000_000
    max_string_bytes: int = 1_048_576
    max_row_groups: int = 100_000
    max_nesting_depth: int = 64
    max_page_bytes: int = 64 * 1024 * 1024
    max_expansion: int = 500
    max_column_chunks: int = 1_000_000
    max_footer_bytes: int = 64 * 1024 * 1024
    #: Read the page headers of the model's columns too (dictionary sizes, page sizes); costs a seek for each page.
    #: In a store that only Spark reads, page headers can't be reached before the data and the bounds of whole chunks hold alone.
    check_pages: bool = True
    #: Decode the levels of nested columns too, against their bounds and the row groups' rows; reads those columns' pages once more.
    check_levels: bool = False


_WIDTH = {"BOOLEAN": 1, "INT32": 4, "INT64": 8, "FLOAT": 4, "DOUBLE": 8, "INT96": 12, "BYTE_ARRAY": 16, "FIXED_LEN_BYTE_ARRAY": 16}


def _root(path: str) -> str:
    return path.split(".")[0].lower()


def check_footer(path: str, size: int, meta: pq.FileMetaData, limits: Limits, roots: frozenset[str] | None = None) -> None:
    """InvalidData if a footer breaks a bound.  roots: the top-level columns (lower case) that are read; None for all."""

    def fail(what: str) -> None:
        raise InvalidData(f"{path}: {what}")

    if meta.num_row_groups > limits.max_row_groups:
        fail(f"{meta.num_row_groups} row groups; the limit is {limits.max_row_groups}")
    if meta.num_row_groups * meta.num_columns > limits.max_column_chunks:
        fail(f"{meta.num_row_groups * meta.num_columns} column chunks; the limit is {limits.max_column_chunks}")
    for k in range(meta.num_columns):
        if (depth := meta.schema.column(k).path.count(".") + 1) > limits.max_nesting_depth:
            fail(f"column '{meta.schema.column(k).path}' is nested {depth} deep; the limit is {limits.max_nesting_depth}")
    spans: list[tuple[int, int, str]] = []
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        if group.num_rows < 0 or group.num_rows > limits.max_allocation_values:
            fail(f"row group {g} has {group.num_rows} rows; the limit is {limits.max_allocation_values}")
        width = 0
        for c in range(group.num_columns):
            chunk, leaf = group.column(c), meta.schema.column(c)
            if chunk.physical_type != leaf.physical_type:
                fail(f"row group {g}, column '{leaf.path}': {chunk.physical_type} in a column of {leaf.physical_type}")
            if leaf.max_repetition_level == 0 and chunk.num_values != group.num_rows:
                fail(f"row group {g}, column '{leaf.path}': {chunk.num_values} values for {group.num_rows} rows")
            offsets = [x for x in (chunk.dictionary_page_offset, chunk.data_page_offset) if x]
            first, length = min(offsets, default=0), chunk.total_compressed_size
            if length < 0 or first < 4 and length or first + length > size - 8:
                fail(f"row group {g}, column '{leaf.path}': bytes {first} to {first + length} are not in the file's data")
            spans.append((first, first + length, leaf.path))
            if roots is not None and _root(leaf.path) not in roots:
                continue
            if chunk.num_values > limits.max_allocation_values:
                fail(f"row group {g}, column '{leaf.path}': {chunk.num_values} values; the limit is {limits.max_allocation_values}")
            if chunk.total_compressed_size > 0 and chunk.total_uncompressed_size / chunk.total_compressed_size > limits.max_expansion:
                fail(f"row group {g}, column '{leaf.path}' grows {chunk.total_uncompressed_size / chunk.total_compressed_size:.0f} times; the limit is {limits.max_expansion}")
            width += _WIDTH.get(chunk.physical_type, 16)
        if group.num_rows * width > limits.max_allocation_bytes:
            fail(f"row group {g} needs {group.num_rows * width} bytes; the limit is {limits.max_allocation_bytes}")
    spans.sort()
    for (_, end, a), (start, _, b) in zip(spans, spans[1:], strict=False):
        if start < end:
            fail(f"column chunks '{a}' and '{b}' overlap")


def read_footer(path: str, size: int, limits: Limits, roots: frozenset[str] | None = None, tail: bytes | None = None) -> pq.FileMetaData:
    """The footer, if its size and frame are sound; tail has the file's last bytes where tasks can't open it."""
    if size < 12:
        raise InvalidData(f"{path}: {size} bytes are no Parquet file")
    if tail is not None:
        return _read_footer(path, size, limits, roots, pa.BufferReader(b"PAR1" + tail), len(tail) + 4, False)
    with footer.open_file(path) as f:
        return _read_footer(path, size, limits, roots, f, size, limits.check_pages)


def _read_footer(path: str, size: int, limits: Limits, roots: frozenset[str] | None, f: pa.NativeFile, end: int, pages: bool) -> pq.FileMetaData:
    f.seek(end - 8)
    frame = f.read(8)
    length = int.from_bytes(frame[:4], "little")
    if frame[4:] != b"PAR1" or length > min(size, end) - 12 or length > limits.max_footer_bytes:
        raise InvalidData(f"{path}: the footer of {length} bytes is broken or beyond the limit of {limits.max_footer_bytes}")
    f.seek(0)
    try:
        meta = pq.read_metadata(f)
    except (pa.ArrowException, OSError) as e:
        raise InvalidData(f"{path}: {e}") from e
    check_footer(path, size, meta, limits, roots)
    if pages:
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                leaf = meta.schema.column(c)
                if roots is None or _root(leaf.path) in roots:
                    nested = limits.check_levels and (leaf.max_repetition_level or leaf.max_definition_level > 1)
                    _check_pages(path, f, meta.row_group(g).column(c), limits, (leaf, meta.row_group(g).num_rows) if nested else None)
    return meta


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def _skip(data: bytes, at: int, kind: int) -> int:
    if kind in (1, 2):
        return at
    if kind == 3:
        return at + 1
    if kind in (4, 5, 6):
        return _varint(data, at)[1]
    if kind == 7:
        return at + 8
    if kind == 8:
        n, at = _varint(data, at)
        return at + n
    if kind in (9, 10):
        head = data[at]
        n, at = (head >> 4, at + 1) if head >> 4 < 15 else _varint(data, at + 1)
        for _ in range(n):
            at = at + 1 if head & 15 in (1, 2) else _skip(data, at, head & 15)
        return at
    if kind == 12:
        return page_fields(data, at)[1]
    raise InvalidData(f"page header has an unknown field type {kind}")


def page_fields(data: bytes, at: int = 0) -> tuple[dict[int, object], int]:
    """Integers and nested structs of a compact Thrift struct by field id, and where it ends."""
    out: dict[int, object] = {}
    field = 0
    while data[at]:
        head = data[at]
        at += 1
        kind = head & 15
        if head >> 4:
            field += head >> 4
        else:
            n, at = _varint(data, at)
            field = (n >> 1) ^ -(n & 1)
        if kind in (4, 5, 6):
            n, at = _varint(data, at)
            out[field] = (n >> 1) ^ -(n & 1)
        elif kind == 12:
            out[field], at = page_fields(data, at)
        else:
            at = _skip(data, at, kind)
    return out, at + 1


def levels(data: bytes, width: int, n: int) -> np.ndarray:
    """n levels of width bits out of runs and bit-packed groups."""
    out, at, have = [np.zeros(0, np.int64)], 0, 0
    while have < n:
        head, at = _varint(data, at)
        if head & 1:
            size = (head >> 1) * width
            bits = np.unpackbits(np.frombuffer(data[at : at + size], np.uint8), bitorder="little")
            found = bits[: len(bits) // width * width].reshape(-1, width) @ (1 << np.arange(width))
        else:
            size = (width + 7) // 8
            found = np.full(min(head >> 1, n - have), int.from_bytes(data[at : at + size], "little"))
        if not len(found) or at + size > len(data):
            raise IndexError("levels end early")
        at, have = at + size, have + len(found)
        out.append(found)
    return np.concatenate(out)[:n]


def _page_levels(fields: dict, body: bytes, codec: str, leaf: pq.ColumnSchema) -> tuple[np.ndarray, np.ndarray]:
    """Repetition and definition levels of a data page."""
    found = []
    if fields.get(1) == 3:  # the newer pages keep levels apart, uncompressed and without lengths
        own = fields[8]
        n, sizes = own[1], (own.get(6, 0), own.get(5, 0))
        for size, most in zip(sizes, (leaf.max_repetition_level, leaf.max_definition_level), strict=True):
            found.append(levels(body[:size], most.bit_length(), n) if most else np.zeros(n, np.int64))
            body = body[size:]
        return found[0], found[1]
    n = fields[5][1]
    if codec != "UNCOMPRESSED":
        body = pa.Codec({"LZ4": "lz4_raw"}.get(codec, codec.lower())).decompress(body, fields[2]).to_pybytes()
    for most in (leaf.max_repetition_level, leaf.max_definition_level):
        size = int.from_bytes(body[:4], "little") if most else 0
        found.append(levels(body[4 : 4 + size], most.bit_length(), n) if most else np.zeros(n, np.int64))
        body = body[4 + size :] if most else body
    return found[0], found[1]


def _check_pages(path: str, f: pa.NativeFile, chunk: pq.ColumnChunkMetaData, limits: Limits, nested: tuple[pq.ColumnSchema, int] | None = None) -> None:
    """Page sizes, growth and dictionary entries of a column chunk, from its page headers; of a nested one (its leaf and rows) the levels too."""
    rows = 0
    at = min((x for x in (chunk.dictionary_page_offset, chunk.data_page_offset) if x), default=0)
    end = at + chunk.total_compressed_size
    while at < end:
        f.seek(at)
        head = f.read(min(65536, end - at))
        try:
            fields, used = page_fields(head)
        except (IndexError, RecursionError) as e:
            raise InvalidData(f"{path}, column '{chunk.path_in_schema}': broken page header at {at}") from e
        plain, packed = int(fields.get(2, 0)), int(fields.get(3, 0))
        entries = fields.get(7, {}).get(1, 0) if isinstance(fields.get(7), dict) else 0
        if plain < 0 or packed < 0 or plain > limits.max_page_bytes:
            raise InvalidData(f"{path}, column '{chunk.path_in_schema}': a page of {plain} bytes; the limit is {limits.max_page_bytes}")
        if packed and plain / packed > limits.max_expansion:
            raise InvalidData(f"{path}, column '{chunk.path_in_schema}': a page grows {plain / packed:.0f} times; the limit is {limits.max_expansion}")
        if entries > limits.max_dictionary_entries:
            raise InvalidData(f"{path}, column '{chunk.path_in_schema}': {entries} dictionary entries; the limit is {limits.max_dictionary_entries}")
        if nested and fields.get(1) in (0, 3):
            f.seek(at + used)
            try:
                repeats, defined = _page_levels(fields, f.read(packed), chunk.compression, nested[0])
            except (IndexError, KeyError, TypeError, ValueError, pa.ArrowException, OSError) as e:
                raise InvalidData(f"{path}, column '{chunk.path_in_schema}': broken levels at {at}") from e
            for name, found, most in (("repetition", repeats, nested[0].max_repetition_level), ("definition", defined, nested[0].max_definition_level)):
                if len(found) and found.max() > most:
                    raise InvalidData(f"{path}, column '{chunk.path_in_schema}': illegal {name} level {found.max()}; the greatest is {most}")
            rows += int((repeats == 0).sum())
        at += used + packed
    if nested and rows != nested[1]:
        raise InvalidData(f"{path}, column '{chunk.path_in_schema}': levels of {rows} rows in a row group of {nested[1]}")


@dataclass(frozen=True)
class Found:
    """What check_files() found: the distinct schemas as (a file, schema), how many rows, and whether some column is stored as only Arrow reads it."""

    schemas: list[tuple[str, str]]
    rows: int
    by_arrow: bool


#: What check_files() found, by session, files and limits: footers that haven't changed aren't read again.
_checked: OrderedDict[tuple, Found] = OrderedDict()
_REMEMBERED = 256
#: Files, and bytes in all, up to which the driver looks itself.
_FEW, _SMALL = 16, 1 << 28
# A codec and an encoding of Parquet that Spark's scan doesn't know.
_ODD_CODECS, _ODD_ENCODING = ("BROTLI", "LZO"), "BYTE_STREAM_SPLIT"


def _odd(meta: pq.FileMetaData, roots: frozenset[str] | None) -> bool:
    for g in range(meta.num_row_groups):
        for c in range(meta.num_columns):
            chunk = meta.row_group(g).column(c)
            if (roots is None or _root(chunk.path_in_schema) in roots) and (chunk.compression in _ODD_CODECS or _ODD_ENCODING in chunk.encodings):
                return True
    return False


def check_files(spark: SparkSession, path: str | list[str], limits: Limits, roots: frozenset[str] | None = None) -> Found:
    """Checks every file where the executors are; a few files, as Spark reads a few footers when it plans, without a job.

    The answer is remembered as long as the files' paths, lengths and times stay what they are.
    """
    paths = [path] if isinstance(path, str) else list(path)
    few = footer.few_files(spark, paths, _FEW)
    if few is not None and sum(n for _, n, _ in few) > _SMALL:
        few = None
    if few is None:
        state = tuple(footer.files(spark, paths).agg(F.count("*"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first())
    else:
        state = tuple(sorted(few))
    key = (spark.sparkContext.applicationId, tuple(paths), limits, roots, state)
    if key in _checked:
        _checked.move_to_end(key)
        return _checked[key]
    if few is None:
        rows = _look_in_tasks(spark, paths, limits, roots)
    else:
        apart = [None if footer.by_arrow([p]) else footer.tail_of(spark, p, n, limits.max_footer_bytes) for p, n, _ in few]
        with ThreadPoolExecutor(_FEW) as pool:
            seen = list(pool.map(lambda x: _look(x[0][0], x[0][1], limits, roots, x[1]), zip(few, apart, strict=True)))
        rows = [{"path": p, "schema": schema, "wrong": wrong, "rows": n, "odd": odd} for p, schema, wrong, n, odd in sorted(seen)]
    for r in rows:
        if r["wrong"]:
            raise InvalidData(r["wrong"])
    schemas = {r["schema"]: r["path"] for r in reversed(rows)}
    _checked[key] = Found([(p, schema) for schema, p in schemas.items()], sum(r["rows"] for r in rows), any(r["odd"] for r in rows))
    while len(_checked) > _REMEMBERED:
        _checked.popitem(last=False)
    return _checked[key]


def _look(path: str, size: int, limits: Limits, roots: frozenset[str] | None, tail: bytes | None) -> tuple[str, str, str | None, int, bool]:
    """(path, schema, what is wrong, rows, whether only Arrow reads it) of a file."""
    try:
        meta = read_footer(path, size, limits, roots, tail)
        return path, footer.describe_schema(meta), None, meta.num_rows, _odd(meta, roots)
    except InvalidData as e:
        return path, "", str(e), 0, False


def _look_in_tasks(spark: SparkSession, paths: list[str], limits: Limits, roots: frozenset[str] | None) -> list[Row]:
    """_look() at all files, a row for each schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_look(one, size, limits, roots, tail) for one, size, tail in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "tail")), strict=True)]
            kinds = {"path": pa.string(), "schema": pa.string(), "wrong": pa.string(), "rows": pa.int64(), "odd": pa.bool_()}
            columns = list(zip(*found, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))

    found = footer.tails(spark, paths, limits.max_footer_bytes).select("path", "length", "tail").mapInArrow(run, "path string, schema string, wrong string, rows long, odd boolean")
    return found.groupBy("schema").agg(F.min("path").alias("path"), F.min("wrong").alias("wrong"), F.sum("rows").alias("rows"), F.max("odd").alias("odd")).collect()


def _has_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_text(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _has_text(kind.elementType)
    if isinstance(kind, T.MapType):
        return _has_text(kind.keyType) or _has_text(kind.valueType)
    return isinstance(kind, (T.StringType, T.BinaryType))


def _longest(at: Column, kind: T.DataType) -> Column:
    """Bytes of the longest text in a value that has any, at any depth; null if all are null."""
    if isinstance(kind, T.StructType):
        found = [_longest(at.getField(f.name), f.dataType) for f in kind.fields if _has_text(f.dataType)]
        return F.greatest(*found) if len(found) > 1 else found[0]
    if isinstance(kind, T.ArrayType):
        return F.array_max(F.transform(at, lambda x: _longest(x, kind.elementType)))
    if isinstance(kind, T.MapType):
        parts = [(F.map_keys(at), kind.keyType), (F.map_values(at), kind.valueType)]
        found = [_longest(x, T.ArrayType(k)) for x, k in parts if _has_text(k)]
        return F.greatest(*found) if len(found) > 1 else found[0]
    return F.octet_length(at)


def guarded(c: ModelColumn, at: Column, limits: Limits, nulls: bool = True) -> Column:
    """A column that fails when read if a text in it, in structs and lists too, is too long, or if it is required and holds a null.

    The check is part of the column, so a column that nobody asks for takes its check with it and isn't read.
    """
    kind, out = c.spark_type, at
    if _has_text(kind):
        size = _longest(at, kind)
        said = F.concat(F.lit(f"column '{c.name}': a value of "), size.cast("string"), F.lit(f" bytes; the limit is {limits.max_string_bytes}"))
        out = F.when(size > limits.max_string_bytes, F.raise_error(said).cast(kind)).otherwise(out)
    if nulls and c.kind == "leaf" and not c.nullable:
        out = F.when(at.isNull(), F.raise_error(F.lit(f"required column '{c.name}' holds a null")).cast(kind)).otherwise(out)
    return out.alias(c.name)
