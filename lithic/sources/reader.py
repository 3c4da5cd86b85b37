"""The scan builder: scan(spark, Model, path) ... to a DataFrame, rows, a row stream or Arrow batches.

Every step returns a new builder.  Footers are checked and schemas resolved by one
distributed job before the first plan is made, and remembered while the files stay as they are; the scan itself is Spark's own Parquet
reader with the model's columns only, so filters and columns reach the files.
"""

from __future__ import annotations

import atexit
import contextlib
import dataclasses
import io
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lithic.operators.pruning import ColumnStatistics, Predicate, RowGroupMetadata, accept_row_group, from_raw
from lithic.plans.model import Model, model_of
from lithic.plans.resolve import InvalidData, resolve
from lithic.sources import footer
from lithic.sources.guards import Found, Limits, check_files, guarded, read_footer


_GROUPS = "path string, row_group int, row_count long, first_row long"
#: Files whose footers the driver reads itself when row groups are chosen.
_FEW = 16


class NotSupported(RuntimeError):
    """Builder steps that don't go together."""


@dataclass(frozen=True)
class ReadOptions:
    limits: Limits = field(default_factory=Limits)
    #: Tasks of the scan at most; -1 for as many as Spark makes.
    max_tasks: int = -1
    #: Whether steps that the strict contract forbids together raise.
    strict: bool = True


@dataclass(frozen=True)
class Scan:
    spark: SparkSession
    model: Model
    paths: tuple[str, ...]
    kind: str = "path"  # or "buffer", or "stream"
    options: ReadOptions = field(default_factory=ReadOptions)
    predicate: Callable[[RowGroupMetadata], bool] | None = None
    condition: Column | None = None
    in_parallel: bool = False

    # ---- steps -------------------------------------------------------------

    def with_options(self, options: ReadOptions) -> Scan:
        if options is None:
            raise ValueError("options must not be None")
        return dataclasses.replace(self, options=options)

    def where(self, predicate: Callable[[RowGroupMetadata], bool]) -> Scan:
        """Only row groups that the predicate accepts, whole: rows may be more than those that match."""
        if predicate is None:
            raise ValueError("predicate must not be None")
        if self.options.strict and self.predicate is not None:
            raise NotSupported("where() was called already")
        if self.options.strict and self.in_parallel:
            raise NotSupported("where() after parallel()")
        return dataclasses.replace(self, predicate=predicate)

    def filter(self, condition: Column) -> Scan:
        """Only rows that match, by Spark's own pushdown; rows that don't aren't checked for long texts and nulls."""
        return dataclasses.replace(self, condition=condition if self.condition is None else self.condition & condition)

    def parallel(self) -> Scan:
        if self.options.strict and self.kind == "stream":
            raise NotSupported("parallel() over a stream")
        if self.options.strict and self.predicate is not None:
            raise NotSupported("parallel() after where()")
        return dataclasses.replace(self, in_parallel=True)

    # ---- results -----------------------------------------------------------

    def to_df(self) -> DataFrame:
        """The scan as a lazy DataFrame with the model's columns in the model's order."""
        return self._frame(False)

    def _checked(self) -> Found:
        return check_files(self.spark, list(self.paths), self.options.limits, frozenset(c.name.lower() for c in self.model.columns))

    def _frame(self, placed: bool) -> DataFrame:
        found = self._checked()
        # A column that is in some files only is null in the others.
        present = [resolve(self.model, schema, path) for path, schema in found.schemas]
        absent = {c.name for c in self.model.columns if present and not any(p[c.name] for p in present)}
        df = self._grouped(lambda batches: batches, self.model.schema) if found.by_arrow else self._native(absent) if self.predicate is None else self._candidates(absent)
        absent = set() if found.by_arrow else absent
        if self.predicate is None and self.options.max_tasks > 0:
            df = df.coalesce(self.options.max_tasks)
        # The condition goes first, on the file's own columns, so it is pushed down.
        named = [F.lit(None).cast(c.spark_type).alias(c.name) if c.name in absent else F.col(f"`{c.name}`") for c in self.model.columns]
        placed = placed and not found.by_arrow  # row groups come in order by themselves
        place = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")] if placed else []
        df = df.select(*named, *place)
        df = df if self.condition is None else df.where(self.condition)
        checked = [F.col(f"`{c.name}`") if c.name in absent else guarded(c, F.col(f"`{c.name}`"), self.options.limits) for c in self.model.columns]
        return df.select(*checked, *(["__file", "__row"] if placed else []))

    def _native(self, absent: set[str]) -> DataFrame:
        """Spark's own scan of the columns that the files have."""
        kept = T.StructType([f for f in self.model.schema.fields if f.name not in absent])
        return self.spark.read.schema(kept).parquet(*self.paths)

    def to_array(self) -> list[Row]:
        """All rows in file order; InvalidData if the files hold more than the limits allow to be held."""
        rows = self._checked().rows
        if self.predicate is None and self.condition is None and rows > self.options.limits.max_allocation_values:
            raise InvalidData(f"{rows} rows for one array; the limit is {self.options.limits.max_allocation_values}")
        return self._ordered().collect()

    def rows(self) -> Iterator[Row]:
        """Rows one after the other in file order; one partition at a time is held."""
        self._not_after_parallel("rows()")
        return self._ordered().toLocalIterator()

    def batches(self) -> Iterator[pa.RecordBatch]:
        """One Arrow batch for each row group, in order; the batches are the caller's own.

        They are read where the executors are, and come one after the other.
        """
        self._may_batch("batches()")

        def shown(batch: pa.RecordBatch) -> pa.RecordBatch:
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            return pa.RecordBatch.from_arrays([pa.array([sink.getvalue()], pa.large_binary() if sink.tell() > 1 << 30 else pa.binary())], ["batch"])

        for row in self.map_batches(shown, "batch binary").toLocalIterator(prefetchPartitions=True):
            yield pa.ipc.open_stream(row.batch).read_next_batch()

    def map_batches(self, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType | str) -> DataFrame:
        """What f makes of each row group's Arrow batch, in the tasks: (schema), a row group at a time, in no promised order of files."""
        self._may_batch("map_batches()")
        for path, found in self._checked().schemas:
            resolve(self.model, found, path)
        return self._grouped(lambda batches: (f(b) for b in batches), schema)

    def _may_batch(self, what: str) -> None:
        self._not_after_parallel(what)
        if self.options.strict and self.predicate is not None:
            raise NotSupported(f"{what} after where()")
        if not self.model.flat:
            raise NotSupported(f"{what} is for models of plain columns")

    def _not_after_parallel(self, what: str) -> None:
        if self.options.strict and self.in_parallel:
            raise NotSupported(f"{what} after parallel()")

    def _ordered(self) -> DataFrame:
        """Rows by file and place in it; whole row groups come in that order by themselves."""
        df = self._frame(self.predicate is None)
        return df.orderBy("__file", "__row").drop("__file", "__row") if "__file" in df.columns else df

    # ---- whole row groups ---------------------------------------------------

    def row_groups(self) -> DataFrame:
        """(path, row_group, row_count, first_row) of the groups that the predicate accepts."""
        if (few := self._few_groups()) is not None:
            return self.spark.createDataFrame(few, _GROUPS)
        accepted = self._accepted()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [g for file in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "tail")), strict=True) for g in accepted(*file)]
                columns = list(zip(*found, strict=True)) or [()] * 4
                kinds = {"path": pa.string(), "row_group": pa.int32(), "row_count": pa.int64(), "first_row": pa.int64()}
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))

        listed = footer.tails(self.spark, list(self.paths), self.options.limits.max_footer_bytes).select("path", "length", "tail")
        return listed.mapInArrow(run, _GROUPS)

    def _accepted(self) -> Callable[[str, int, bytes | None], list[tuple[str, int, int, int]]]:
        """What row_groups() has of a file (path, length, tail); without this scan's session, so that tasks can have it."""
        model, limits = dataclasses.replace(self.model, cls=None), dataclasses.replace(self.options.limits, check_pages=False)
        predicate = self.predicate.group if isinstance(self.predicate, Predicate) else self.predicate

        def of_file(path: str, size: int, tail: bytes | None) -> list[tuple[str, int, int, int]]:
            out, before = [], 0
            for group in group_metadata(read_footer(path, size, limits, frozenset(), tail), model):
                if accept_row_group(model, predicate, group):
                    out.append((path, group.row_group, group.row_count, before))
                before += group.row_count
            return out

        return of_file

    def _few_groups(self) -> list[tuple[str, int, int, int]] | None:
        """row_groups() of few files, without a job."""
        few, paths = footer.few_files(self.spark, list(self.paths), _FEW), list(self.paths)
        if few is None or not footer.by_arrow(paths):
            return None
        accepted = self._accepted()
        with ThreadPoolExecutor(_FEW) as pool:
            return [g for groups in pool.map(lambda f: accepted(f[0], f[1], None), sorted(few)) for g in groups]

    def _grouped(self, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
        """f over the accepted row groups' batches, each read by one task; a task has groups that follow each other."""
        if not footer.by_arrow(list(self.paths)):
            raise NotSupported("row groups as batches: Arrow doesn't open this store")
        model = dataclasses.replace(self.model, cls=None)

        def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path, g in zip(batch.column("path").to_pylist(), batch.column("row_group").to_pylist(), strict=True):
                    with footer.open_file(path) as opened:
                        file = pq.ParquetFile(opened)
                        names = {n.lower(): n for n in reversed(file.schema_arrow.names)}
                        yield _as_model(file.read_row_group(g, columns=[names[c.name.lower()] for c in model.columns if c.name.lower() in names]), model)

        tasks = max(1, self.spark.sparkContext.defaultParallelism)
        if (few := self._few_groups()) is not None:
            rows = [(path, g, k * tasks // len(few)) for k, (path, g, *_) in enumerate(few)]
            spread = self.spark.createDataFrame(rows, "path string, row_group int, task int").repartitionById(tasks, "task").sortWithinPartitions("path", "row_group")
        else:
            spread = self.row_groups().repartitionByRange(tasks, "path", "row_group").sortWithinPartitions("path", "row_group")
        return spread.select("path", "row_group").mapInArrow(lambda batches: f(groups(batches)), schema)

    def _candidates(self, absent: set[str]) -> DataFrame:
        """The rows of the accepted groups: read group by group, or in a store that only Spark opens by their places in the files."""
        if footer.by_arrow(list(self.paths)):
            return self._grouped(lambda batches: batches, self.model.schema)
        chosen = self.row_groups().select("path", F.col("first_row").alias("__first"), (F.col("first_row") + F.col("row_count")).alias("__end"))
        own = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        rows = self._native(absent).select("*", own.alias("__path"), F.col("_metadata.row_index").alias("__at"))
        met = (F.col("__path") == F.col("path")) & (F.col("__at") >= F.col("__first")) & (F.col("__at") < F.col("__end"))
        return rows.join(chosen, met).drop("path", "__path", "__at", "__first", "__end")


def group_metadata(meta: pq.FileMetaData, model: Model) -> Iterator[RowGroupMetadata]:
    """The row groups of a footer with the statistics of the model's prunable columns."""
    at = {meta.schema.column(k).path.lower(): k for k in reversed(range(meta.num_columns))}
    for g in range(meta.num_row_groups):
        group, found = meta.row_group(g), {}
        for c in model.prunable:
            stats = group.column(at[c.name.lower()]).statistics if c.name.lower() in at else None
            if stats is None:
                continue
            low, high = (from_raw(x, c.leaf.name) if stats.has_min_max else None for x in (stats.min, stats.max))
            found[c.name] = ColumnStatistics(low, high, stats.null_count if stats.has_null_count else None, stats.distinct_count if stats.has_distinct_count else None)
        yield RowGroupMetadata(g, group.num_rows, found)


def _as_model(table: pa.Table, model: Model) -> pa.RecordBatch:
    """A row group as one batch with the model's columns and Spark's types; absent columns are null."""
    names = {n.lower(): k for k, n in reversed(list(enumerate(table.column_names)))}
    columns = []
    for c in model.columns:
        kind = arrow_of(c.spark_type)
        if c.name.lower() not in names:
            columns.append(pa.nulls(table.num_rows, kind))
            continue
        got = table.column(names[c.name.lower()]).combine_chunks()
        if pa.types.is_time(got.type):
            got = got.cast(pa.int32() if got.type.bit_width == 32 else pa.int64())
        columns.append(got.cast(kind))
    return pa.RecordBatch.from_arrays(columns, [c.name for c in model.columns])


def arrow_of(kind: T.DataType) -> pa.DataType:
    return to_arrow_type(kind)


def scan(spark: SparkSession, model: Model | type, path: str | list[str]) -> Scan:
    """A scan of the Parquet files at a path or paths."""
    if not path:
        raise ValueError("path must not be empty")
    return Scan(spark, model_of(model), tuple([path] if isinstance(path, str) else path))


def scan_buffer(spark: SparkSession, model: Model | type, data: bytes) -> Scan:
    """A scan of a file in memory, which is put in the shared folder, or a temporary one on a local master."""
    if data is None:
        raise ValueError("data must not be None")
    return dataclasses.replace(scan(spark, model, _spool(spark, io.BytesIO(data))), kind="buffer")


def scan_stream(spark: SparkSession, model: Model | type, stream) -> Scan:
    """A scan of a readable binary stream, copied piece by piece; it can't be read in parallel."""
    if stream is None:
        raise ValueError("stream must not be None")
    return dataclasses.replace(scan(spark, model, _spool(spark, stream)), kind="stream")


_PIECE = 1 << 20


def _spool(spark: SparkSession, data) -> str:
    """The bytes of a readable stream as a file of a new name, which goes when the process ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and not spark.sparkContext.master.startswith("local["):
        raise InvalidData("set spark.checkpoint.dir to a folder that all executors share")
    name = f"lithic-buffer-{uuid.uuid4().hex}.parquet"
    if root is None:
        place = Path(tempfile.mkdtemp(prefix="lithic-"))
        atexit.register(shutil.rmtree, place, ignore_errors=True)
        with (place / name).open("wb") as out:
            shutil.copyfileobj(data, out, _PIECE)
        return str(place / name)
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = store.create(at, False)
    try:
        while piece := data.read(_PIECE):
            out.write(bytearray(piece))
    finally:
        out.close()

    def gone() -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            store.delete(at, False)

    atexit.register(gone)
    return at.toString()
