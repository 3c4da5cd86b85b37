"""Footers of Parquet files as DataFrames: zone maps, layouts and schemas, read where the executors are.

Files are listed by Spark; their footers are read in parallel, one small task
input for each file, so neither the listing nor a footer's content meets on the driver.
A store that Arrow can't open is read by Spark's own Hadoop file systems: the last bytes of each file, which
hold its footer, go through the driver to the same tasks.
"""

from __future__ import annotations

import datetime
import functools
import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import accumulate

import pyarrow as pa
import pyarrow.fs as pa_fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ZONE_MAP = (
    "path string, row_group int, row_count long, column string, physical_type string, logical_type string, codec string, num_values long, "
    "null_count long, distinct_count long, has_min_max boolean, min_value string, max_value string, compressed_bytes long, uncompressed_bytes long, first_offset long"
)


#: Names that Hadoop has for stores that Arrow knows by another.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}
#: Footers that are read through the driver at once, and before they are handed on.
_THREADS, _AT_ONCE = 32, 4096


def local_uri(path: str) -> str:
    """A file's URI as Arrow spells it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        return "file://" + path[5:]
    scheme, colon, rest = path.partition("://")
    return f"{_SCHEMES.get(scheme, scheme)}{colon}{rest}"


def open_file(path: str) -> pa.NativeFile:
    """A file by its URI or path, in any store that Arrow reads."""
    fs, inner = pa_fs.FileSystem.from_uri(local_uri(path)) if "://" in path or path.startswith("file:") else (pa_fs.LocalFileSystem(), path)
    return fs.open_input_file(inner)


@functools.lru_cache(maxsize=64)
def arrow_reads(scheme: str) -> bool:
    """Whether Arrow has a file system for a URI's scheme; libhdfs is a matter of each machine, so HDFS goes by Spark."""
    return _SCHEMES.get(scheme, scheme) in ("", "file", "s3", "gs", "gcs", "abfs", "abfss")


def by_arrow(paths: list[str]) -> bool:
    return all(arrow_reads(p.partition(":")[0] if "://" in p or p.startswith("file:") else "") for p in paths)


def files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, length, modificationTime) of the data files at path, without their content."""
    listed = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    return listed.where(~F.regexp_like(F.regexp_extract("path", r"([^/]*)$", 1), F.lit(r"^[_.]"))).where("length > 0")


def few_files(spark: SparkSession, paths: list[str], most: int) -> list[tuple[str, int, int]] | None:
    """(path, length, time) of the data files at paths without a Spark job; None if they are more, lie in folders below, or go by a pattern."""
    jvm, out = spark._jvm, []
    for path in paths:
        if any(c in path for c in "*?[]{}"):
            return None
        at = jvm.org.apache.hadoop.fs.Path(path)
        store = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if not store.exists(at):
            return None
        found = store.listStatus(at)
        if len(found) > 2 * most:
            return None
        for status in found:
            name = status.getPath().getName()
            if name.startswith(("_", ".")):
                continue
            if status.isDirectory() or len(out) == most:
                return None
            if status.getLen() > 0:
                out.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return out


def tail_of(spark: SparkSession, path: str, length: int, most: int) -> bytes:
    """A file's footer with its frame, by Spark's file systems; of one that is broken or larger than most, its last 8 bytes alone."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:

        def last(n: int) -> bytes:
            stream.seek(length - n)
            return bytes(stream.readNBytes(n))

        frame = last(min(8, length))
        size = int.from_bytes(frame[:4], "little") + 8
        return last(size) if frame[4:] == b"PAR1" and size <= min(length, most) else frame
    finally:
        stream.close()


def tails(spark: SparkSession, path: str | list[str], most: int = 64 * 1024 * 1024) -> DataFrame:
    """files() with tail, which is null where tasks open the files themselves (Arrow knows the store)."""
    listed = files(spark, path)
    if by_arrow([path] if isinstance(path, str) else list(path)):
        return listed.withColumn("tail", F.lit(None).cast("binary"))
    out, part = None, []

    def read(rows: list) -> DataFrame:
        with ThreadPoolExecutor(_THREADS) as pool:
            found = list(pool.map(lambda r: tail_of(spark, r.path, r.length, most), rows))
        return spark.createDataFrame([(*r, t) for r, t in zip(rows, found, strict=True)], listed.schema.add("tail", "binary"))

    for row in listed.toLocalIterator():
        part.append(row)
        if len(part) == _AT_ONCE:
            out, part = (read(part) if out is None else out.unionByName(read(part))), []
    if part or out is None:
        out = read(part) if out is None else out.unionByName(read(part))
    return out.repartition(max(1, min(spark.sparkContext.defaultParallelism, out.count())))


def metadata_of(path: str, tail: bytes | None) -> pq.FileMetaData:
    """A footer, out of a file's last bytes or of the file."""
    if tail is not None:
        return pq.read_metadata(pa.BufferReader(b"PAR1" + tail))
    with open_file(path) as f:
        return pq.read_metadata(f)


def per_footer(spark: SparkSession, path: str | list[str], rows: Callable[[str, pq.FileMetaData], list[tuple]], schema: pa.Schema) -> DataFrame:
    """What rows() makes of each file's path and footer, in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, tail in zip(batch.column("path").to_pylist(), batch.column("tail").to_pylist(), strict=True):
                if found := rows(one, metadata_of(one, tail)):
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), schema.types, strict=True)], schema=schema)

    from pyspark.sql.pandas.types import from_arrow_schema

    return tails(spark, path).select("path", "tail").mapInArrow(run, from_arrow_schema(schema))


def logical_name(column: pq.ColumnSchema) -> str:
    """The annotation's name, integers as UINT8 and the like."""
    said = json.loads(column.logical_type.to_json())
    kind = said["Type"].upper()
    if kind == "INT":
        return f"{'' if said['isSigned'] else 'U'}INT{said['bitWidth']}"
    return kind


def text_of(value: object) -> str | None:
    """A statistic as text that loses nothing."""
    if value is None:
        return None
    if isinstance(value, bytes):
        return value.hex()
    if isinstance(value, datetime.datetime | datetime.date | datetime.time):
        return value.isoformat()
    return repr(value) if isinstance(value, float) else str(value)


def zone_map_rows(path: str, meta: pq.FileMetaData) -> Iterator[tuple]:
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        for c in range(group.num_columns):
            chunk = group.column(c)
            stats = chunk.statistics
            known = bool(stats is not None and stats.has_min_max)
            low, high = (stats.min, stats.max) if known else (None, None)
            first = min(x for x in (chunk.dictionary_page_offset, chunk.data_page_offset) if x is not None)
            yield (
                path, g, group.num_rows, chunk.path_in_schema, chunk.physical_type, logical_name(meta.schema.column(c)), chunk.compression, chunk.num_values,
                stats.null_count if stats is not None and stats.has_null_count else None, stats.distinct_count if stats is not None and stats.has_distinct_count else None,
                known, text_of(low), text_of(high), chunk.total_compressed_size, chunk.total_uncompressed_size, first,
            )


_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}


def zone_map(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A row for each row group and column: counts, least and greatest value, sizes (see ZONE_MAP)."""
    schema = pa.schema([(n, _KINDS[k]) for n, k in (x.split() for x in ZONE_MAP.split(", "))])
    return per_footer(spark, path, lambda one, meta: list(zone_map_rows(one, meta)), schema)


def row_groups(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A row for each row group: path, row_group, row_count, first_row (its place in the file)."""

    def rows(one: str, meta: pq.FileMetaData) -> list[tuple]:
        counts = [meta.row_group(g).num_rows for g in range(meta.num_row_groups)]
        return [(one, g, n, before) for g, (n, before) in enumerate(zip(counts, accumulate(counts, initial=0)))]

    return per_footer(spark, path, rows, pa.schema([("path", pa.string()), ("row_group", pa.int32()), ("row_count", pa.int64()), ("first_row", pa.int64())]))


def encodings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A row for each row group and column: path, row_group, column, field_id (null if none), encodings, whether there is a dictionary."""

    def rows(one: str, meta: pq.FileMetaData) -> list[tuple]:
        arrow, out = meta.schema.to_arrow_schema(), []
        ids = {f.name: (f.metadata or {}).get(b"PARQUET:field_id") for f in arrow}
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                chunk = meta.row_group(g).column(c)
                at = ids.get(chunk.path_in_schema)
                out.append((one, g, chunk.path_in_schema, None if at is None else int(at), sorted(map(str, chunk.encodings)), chunk.has_dictionary_page))
        return out

    return per_footer(spark, path, rows, pa.schema([("path", pa.string()), ("row_group", pa.int32()), ("column", pa.string()), ("field_id", pa.int32()), ("encodings", pa.list_(pa.string())), ("dictionary", pa.bool_())]))


def schemas(spark: SparkSession, path: str | list[str]) -> list[tuple[str, str]]:
    """The distinct schemas among the files, each with a file that has it; few, whatever the number of files."""
    found = per_footer(spark, path, lambda one, meta: [(one, describe_schema(meta))], pa.schema([("path", pa.string()), ("schema", pa.string())]))
    return [(r["path"], r["schema"]) for r in found.groupBy("schema").agg(F.min("path").alias("path")).collect()]


def describe_schema(meta: pq.FileMetaData) -> str:
    """One line for each leaf: path, physical type, annotation, whether nulls can be, precision and scale, time unit and zone."""
    lines = []
    for k in range(meta.num_columns):
        c = meta.schema.column(k)
        said = json.loads(c.logical_type.to_json())
        digits = f"{said['precision']},{said['scale']}" if said["Type"] == "Decimal" else ""
        time = f"{said.get('timeUnit', '')},{said.get('isAdjustedToUTC', '')}" if said["Type"] in ("Timestamp", "Time") else ""
        lines.append("\t".join([c.path, c.physical_type, logical_name(c), str(c.max_definition_level > 0), digits, time]))
    return "\n".join(lines)

