"""Tables that cut lineage, in the folder that driver and executors share, and Arrow batches of bounded size."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch between Spark and Python, and rows of a batch of Spark's Parquet scan, unless the session says
#: otherwise; a longer row is a batch of its own.
BATCH_BYTES, SCAN_ROWS = "8m", "512"
_BATCH, _SCAN = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
#: Each file costs its store several calls, however small it is.
FILES_PER_CORE = 4
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes up to which a side of a join is broadcast by its size as Spark takes it from files before the query runs: it counts an array
#: as one element and compressed columns as they lie, so an exploded table can be thirty times as large.
GUESSED_BYTES = 256 * 1024
_GUESSED, _MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; on a one-process master (tests) a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="lithic-")
    return _LOCAL[app]


def bound_batches(spark: SparkSession) -> None:
    """Batches for rows that hold whole texts: Spark's own thousands of rows are tens of MB in one array.

    What the session has set to anything but Spark's default stays.
    """
    if spark.conf.get(_BATCH) in ("67108864b", "64m", "64MB"):
        spark.conf.set(_BATCH, BATCH_BYTES)
    if spark.conf.get(_SCAN) == "4096":
        spark.conf.set(_SCAN, SCAN_ROWS)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """df.mapInArrow over batches of bounded size."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


@contextlib.contextmanager
def _writing(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files behind: each query's go when it has ended.

    Up to the session's threshold it broadcasts what has been measured as it was shuffled, but only GUESSED_BYTES of what is guessed.
    """
    most = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    own = {_CLEANUP: "true", _GUESSED: str(min(most, GUESSED_BYTES)), _MEASURED: spark.conf.get(_MEASURED, None) or str(most)}
    was = {key: spark.conf.get(key, None) for key in own}
    for key, value in own.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in was.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def materialize(df: DataFrame, what: str = "table", few: bool = False) -> DataFrame:
    """Write df once to the shared folder and read it back.

    few: for tables that are small beside the input (labels, links, targets): in FILES_PER_CORE files for each core at most,
    by tasks that take several partitions, where the number of cores is settled.  Lost executors lose nothing of it.  The shuffle files that made it go at once; its own files go when the Python process
    ends, or with release().
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_root(spark)}/lithic-{what}-{uuid.uuid4().hex}"
    with _writing(spark):
        settled = spark.conf.get("spark.dynamicAllocation.enabled", "false") != "true"
        out = df.coalesce(FILES_PER_CORE * spark.sparkContext.defaultParallelism) if few and settled else df
        out.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._lithic_path = path
    atexit.register(_delete, spark, path)
    return back


def release(*parts: DataFrame | Broadcast) -> None:
    """Delete materialized tables that no later plan reads, and broadcasts that no later task reads."""
    for part in parts:
        if isinstance(part, Broadcast):
            with contextlib.suppress(Exception):  # gone already
                part.destroy()
        elif path := getattr(part, "_lithic_path", None):
            _delete(part.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # at exit the JVM may be gone already
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
