"""Queries over the driver's tables for each operator of the engine, with the SQL that says the same."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable
from typing import Optional

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.functions import transforms as tr
from lithic.operators.pruning import Predicate, may
from lithic.plans.model import column, record
from lithic.sources import footer
from lithic.sources.arrow_writer import CODECS
from lithic.sources.reader import Scan, scan
from lithic.sources.writer import WriteOptions, write


@record
class Orders:
    status: Optional[str] = column("o_orderstatus")
    key: Optional[int] = column("o_orderkey", sort_key=True)
    total: Optional[float] = column("o_totalprice")


@record
class Lines:
    key: Optional[int] = column("l_orderkey", sort_key=True)
    number: Optional[int] = column("l_linenumber", type="int32")
    quantity: Optional[float] = column("l_quantity")
    price: Optional[float] = column("l_extendedprice")
    discount: Optional[float] = column("l_discount")
    flag: Optional[str] = column("l_returnflag")


@record
class Events:
    event: Optional[int] = column("event_id")
    user: Optional[int] = column("user_id")
    kind: Optional[str] = column("event_type")
    value: Optional[float] = column("value")


@record
class CustomerEvolved:
    note: Optional[str] = column("added_note")
    balance: Optional[float] = column("c_acctbal")
    key: Optional[int] = column("c_custkey")
    count: Optional[int] = column("added_count", type="int32")
    name: Optional[str] = column("c_name")


@record
class Place:
    region: Optional[str]
    key: Optional[int]


@record
class Nested:
    key: Optional[int] = column("key")
    place: Optional[Place] = column("place")
    words: Optional[list[Optional[str]]] = column("words")
    parts: Optional[list[Place]] = column("parts")


@record
class Vectors:
    vec: Optional[int] = column("vec_id")
    embedding: Optional[list[Optional[float]]] = column("embedding", type="float32")
    label: Optional[int] = column("label", type="int32")


FLAGS = {0: "A", 1: "N", 2: "R"}


def _path(sf_dir: str, table: str) -> str:
    return f"{sf_dir}/{table}.parquet"


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all executors share, a temporary one on a local master; what is there goes when the process ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{root or tempfile.gettempdir()}/lithic-{uuid.uuid4().hex}"

    def gone() -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    atexit.register(gone)
    return path


def scan_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared columns only, in the model's order."""
    return scan(spark, Orders, _path(sf_dir, "orders")).to_df()


def scan_evolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A newer model over older files: reordered, absent optional columns null."""
    return scan(spark, CustomerEvolved, _path(sf_dir, "customer")).to_df()


def _lines(spark: SparkSession, sf_dir: str, predicate) -> DataFrame:
    return scan(spark, Lines, _path(sf_dir, "lineitem")).filter(predicate.residual()).to_df().agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(28,4)")).cast("double").alias("quantity"))


def prune_at_least(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, may("l_orderkey").at_least(9000))


def prune_greater_than(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, may("l_orderkey").greater_than(9000))


def prune_at_most(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, may("l_orderkey").at_most(500))


def prune_less_than(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, may("l_orderkey").less_than(500))


def _orders(spark: SparkSession, sf_dir: str, predicate) -> DataFrame:
    return scan(spark, Orders, _path(sf_dir, "orders")).filter(predicate.residual()).to_df()


def prune_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, may("o_orderkey").equal(777))


def prune_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, may("o_orderkey").between(100, 300))


def prune_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, may("o_orderkey").any_of([1, 7, 700, 10**12]))


def prune_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = may("user_id").between(10, 60) & ~may("event_type").equal("click")
    return scan(spark, Events, _path(sf_dir, "events")).filter(some.residual()).to_df().groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def prune_superset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole row groups of a sorted copy, then the rows: the same as the rows alone."""
    at = scratch(spark)
    source = scan(spark, Lines, _path(sf_dir, "lineitem")).to_df()
    write(source.orderBy("l_orderkey"), Lines, at, WriteOptions(row_group_size=1000))
    some = may("l_orderkey").between(2050, 2349)
    kept = scan(spark, Lines, at).where(some).to_df()
    return kept.where(some.residual()).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(28,4)")).cast("double").alias("revenue"))


def zone_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, greatest and null count of integer, floating and text columns out of the footers, over all row groups."""
    rows = footer.zone_map(spark, _path(sf_dir, "orders")).where(F.col("column").isin("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"))
    number = F.col("logical_type") != "STRING"
    low, high = (F.when(number, F.col(c).cast("double")) for c in ("min_value", "max_value"))
    texts = [F.min(F.when(~number, F.col("min_value"))).alias("first_text"), F.max(F.when(~number, F.col("max_value"))).alias("last_text")]
    return rows.groupBy(F.col("column").alias("column_name")).agg(F.min(low).alias("least"), F.max(high).alias("greatest"), *texts, F.sum("null_count").alias("nulls"), F.sum("num_values").alias("n"))


def batch_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of a key range, in ten-thousandths: pushed down, two columns read, added up in generated code."""
    some = scan(spark, Lines, _path(sf_dir, "lineitem")).filter(F.col("l_orderkey") >= 500).to_df()
    return some.agg(F.sum(F.rint(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 10_000).cast("long")).alias("units"), F.count("*").alias("n"))


RANGES = 32
_ranged: dict[tuple[str, str], str] = {}


def ranged_lines(spark: SparkSession, sf_dir: str) -> str:
    """Lines in a row group for each of RANGES ranges of the order key, written once for a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ranged:
        source = spark.read.parquet(_path(sf_dir, "lineitem"))
        width = source.agg(F.max("l_orderkey")).first()[0] // RANGES + 1
        at = scratch(spark)
        rows = source.withColumn("part", F.expr(f"l_orderkey div {width}")).repartition(RANGES, "part")
        write(rows, Lines, at, WriteOptions(row_group_size=10_000_000, partition_by=("part",)))
        _ranged[key] = at
    return _ranged[key]


def _opened(spark: SparkSession, sf_dir: str, predicate) -> DataFrame:
    """Which row groups a predicate opens, what is in them, and what of that its rows are."""
    some = scan(spark, Lines, ranged_lines(spark, sf_dir)).where(predicate)
    match, quantity = predicate.residual(), F.col("l_quantity").cast("decimal(28,4)")
    return some.to_df().agg(*_groups_of(some), F.count("*").alias("read"), F.count(F.when(match, 1)).alias("n"), F.coalesce(F.sum(F.when(match, quantity)), F.lit(0)).cast("double").alias("quantity"))


def _groups_of(some: Scan) -> list[Column]:
    """How many row groups a scan opens and the rows that they hold, as constants."""
    found = some.row_groups().agg(F.count("*").alias("groups"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("candidates")).first()
    return [F.lit(found[c]).cast("long").alias(c) for c in ("groups", "candidates")]


_KEY = may("l_orderkey")
#: Query -> its predicate, and in SQL which ranges g it opens and which rows it means.
GROUPS: dict[str, tuple[Callable[[], Predicate], str, str]] = {
    "groups_equal": (lambda: _KEY.equal(5000), "lo <= 5000 AND hi >= 5000", "l_orderkey = 5000"),
    "groups_at_least": (lambda: _KEY.at_least(9000), "hi >= 9000", "l_orderkey >= 9000"),
    "groups_greater_than": (lambda: _KEY.greater_than(9000), "hi > 9000", "l_orderkey > 9000"),
    "groups_at_most": (lambda: _KEY.at_most(500), "lo <= 500", "l_orderkey <= 500"),
    "groups_less_than": (lambda: _KEY.less_than(500), "lo < 500", "l_orderkey < 500"),
    "groups_between": (lambda: _KEY.between(2050, 2349), "hi >= 2050 AND lo <= 2349", "l_orderkey BETWEEN 2050 AND 2349"),
    "groups_any": (lambda: _KEY.any_of([1, 7, None, 7000, 10**12]), "lo <= 1 AND hi >= 1 OR lo <= 7 AND hi >= 7 OR lo <= 7000 AND hi >= 7000", "l_orderkey IN (1, 7, 7000)"),
    "groups_conjunction": (lambda: _KEY.at_least(1000) & _KEY.less_than(3000) & may("l_linenumber").at_most(2), "hi >= 1000 AND lo < 3000 AND least_line <= 2", "l_orderkey >= 1000 AND l_orderkey < 3000 AND l_linenumber <= 2"),
    "groups_negated": (lambda: ~(_KEY.at_least(1000) & _KEY.at_most(9000)), "lo < 1000 OR hi > 9000", "l_orderkey < 1000 OR l_orderkey > 9000"),
}
_RANGED_SQL = f"""WITH w AS (SELECT max(l_orderkey) // {RANGES} + 1 AS width FROM lineitem),
    g AS (SELECT min(l_orderkey) AS lo, max(l_orderkey) AS hi, min(l_linenumber) AS least_line, count(*) AS n FROM lineitem, w GROUP BY l_orderkey // width)"""


def _groups_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _opened(spark, sf_dir, GROUPS[name][0]())


def _groups_sql(groups: str, rows: str) -> str:
    return f"""{_RANGED_SQL} SELECT (SELECT count(*) FROM g WHERE {groups}) AS groups, CAST((SELECT coalesce(sum(n), 0) FROM g WHERE {groups}) AS BIGINT) AS candidates,
    CAST((SELECT coalesce(sum(n), 0) FROM g WHERE {groups}) AS BIGINT) AS read, count(*) AS n, CAST(coalesce(sum(CAST(l_quantity AS DECIMAL(28,4))), 0) AS DOUBLE) AS quantity FROM lineitem WHERE {rows}"""


@record
class Noted:
    key: Optional[int] = column("l_orderkey")
    note: Optional[str] = column("note")


def groups_without_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prunable column that has no least and greatest value (it is null throughout) keeps every group open."""
    at = scratch(spark)
    source = spark.read.parquet(_path(sf_dir, "lineitem"))
    width = source.agg(F.max("l_orderkey")).first()[0] // RANGES + 1
    rows = source.select("l_orderkey", F.lit(None).cast("string").alias("note"), F.expr(f"l_orderkey div {width}").alias("part")).repartition(RANGES, "part")
    write(rows, Noted, at, WriteOptions(row_group_size=10_000_000, partition_by=("part",)))
    some = scan(spark, Noted, at).where(may("l_orderkey").at_least(10**12))
    return some.to_df().agg(*_groups_of(some), F.count("*").alias("read"), F.count("note").alias("notes"))


def row_group_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columnar batches, one for each row group, added up where they are read."""

    def sums(b: pa.RecordBatch) -> pa.RecordBatch:
        import numpy as np

        price, less = (b.column(k).to_numpy(zero_copy_only=False) for k in ("l_extendedprice", "l_discount"))
        units = int(np.rint(price * (1 - less) * 10_000).astype(np.int64).sum())
        return pa.RecordBatch.from_arrays([pa.array([units], pa.int64()), pa.array([b.num_rows], pa.int64())], ["units", "n"])

    parts = scan(spark, Lines, ranged_lines(spark, sf_dir)).map_batches(sums, "units long, n long")
    return parts.agg(F.count("*").alias("batches"), F.sum("n").alias("n"), F.max("n").alias("largest"), F.sum("units").alias("units"))


def interop_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scan(spark, Events, _path(sf_dir, "events")).to_df()
    return df.agg(F.count("*").alias("n"), F.sum(F.col("event_type").isNull().cast("long")).alias("null_kinds"), F.min("user_id").alias("least"), F.max("user_id").alias("greatest"), F.sum(F.col("value").cast("decimal(28,4)")).cast("double").alias("total"))


def roundtrip_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = scan(spark, Lines, _path(sf_dir, "lineitem")).to_df()
    found = []
    for codec in CODECS:
        at = scratch(spark)
        write(source, Lines, at, WriteOptions(compression=codec))
        found.append(scan(spark, Lines, at).to_df().agg(F.lit(codec).alias("codec"), F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(28,4)")).cast("double").alias("quantity")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def roundtrip_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark)
    write(scan(spark, Orders, _path(sf_dir, "orders")).to_df(), Orders, at, WriteOptions(row_group_size=1000, files=1))
    groups = footer.row_groups(spark, at)
    return groups.agg(F.count("*").alias("row_groups"), F.sum("row_count").alias("n"), F.max("row_count").alias("largest"))


def nested_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structs and lists, with null, empty and null-holding ones, written and read."""
    orders = spark.read.parquet(_path(sf_dir, "orders"))
    k = F.col("o_orderkey")
    place = F.when(k % 5 != 0, F.struct(F.when(k % 3 != 0, F.col("o_orderstatus")).alias("region"), k.alias("key")))
    words = F.when(k % 7 == 0, None).when(k % 7 == 1, F.array().cast("array<string>")).otherwise(F.array(F.col("o_orderpriority"), F.when(k % 2 == 0, F.lit("x"))))
    parts = F.when(k % 4 == 0, None).otherwise(F.array(F.struct(F.col("o_orderstatus").alias("region"), (k * 2).alias("key"))))
    at = scratch(spark)
    write(orders.select(k.alias("key"), place.alias("place"), words.alias("words"), parts.alias("parts")), Nested, at)
    back = scan(spark, Nested, at).to_df()
    return back.select("key", F.col("place").isNull().alias("no_place"), F.col("place.region").alias("region"), F.when(F.col("words").isNotNull(), F.size("words")).otherwise(-1).alias("n_words"), F.get("words", F.lit(0)).alias("first_word"), F.get("words", F.lit(1)).alias("second_word"), F.coalesce(F.get("parts", F.lit(0))["key"], F.lit(-1)).alias("part_key"))


def list_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scan(spark, Vectors, _path(sf_dir, "embeddings")).to_df()
    return df.select("vec_id", F.size("embedding").alias("dims"), F.get("embedding", F.lit(0)).cast("double").alias("first_value"), "label")


def arrow_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table through Arrow, checked, to a file and back."""
    from lithic.sources.writer import write_arrow

    # The dimension table of regions is small by its nature.
    table = spark.read.parquet(_path(sf_dir, "region")).select(F.col("r_regionkey").cast("long").alias("key"), F.col("r_name").alias("region")).toArrow()
    at = scratch(spark)
    write_arrow(spark, table, Place, at)
    return scan(spark, Place, at).to_df()


def ts_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(_path(sf_dir, "events")).select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    micros, millis = tr.to_micros(F.col("ts")), tr.to_millis(F.col("ts"))
    early = tr.micros_to_ticks(micros) - 30_000_000_000_000_007  # some 95 years before, below the microsecond
    return events.select("event_id", micros.alias("micros"), millis.alias("millis"), tr.to_micros(tr.from_micros(micros)).alias("micros_again"), tr.to_micros(tr.from_millis(millis)).alias("millis_again"), tr.micros_to_ticks(micros).alias("ticks"), tr.ticks_to_micros(tr.micros_to_ticks(micros)).alias("ticks_again"), tr.ticks_to_micros(early).alias("early_micros"), tr.ticks_to_millis(early).alias("early_millis"))


def numeric_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return spark.read.parquet(_path(sf_dir, "orders")).select("o_orderkey", tr.scaled(F.col("o_totalprice"), 0.5).alias("half"), tr.scaled(F.col("o_totalprice"), 1.1, single=True).cast("double").alias("single"), tr.widened(k.cast("int"), "long").alias("wide"), tr.narrowed(k * 100_003, 16).alias("low16"), tr.narrowed(k * 4_000_037, 32).alias("low32"))


def null_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice"))
    return spark.read.parquet(_path(sf_dir, "orders")).select(kept.alias("v")).agg(F.sum(tr.level(F.col("v")).cast("long")).alias("present"), F.count("v").alias("packed"), F.count("*").alias("n"))


def enum_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = tr.enum_value(F.col("l_returnflag"), FLAGS)
    lines = scan(spark, Lines, _path(sf_dir, "lineitem")).to_df()
    return lines.select(code.alias("code"), tr.enum_name(code, FLAGS).alias("flag")).groupBy("code", "flag").agg(F.count("*").alias("n"))


def time_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    return spark.read.parquet(_path(sf_dir, "orders")).select("o_orderkey", tr.duration_to_millis(k * 1_234_567 - 5_000_000_000).alias("millis"), tr.time_of_day(k * 1_000_003 % 86_400_000_000).alias("of_day"), tr.date_to_days(day).cast("long").alias("days"), tr.decimal_restored(k * 12_345, 18, 4).cast("string").alias("exact"))


_AGG = "count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(28,4))) AS DOUBLE) AS quantity"
SQL = {
    "scan_project": "SELECT o_orderstatus, o_orderkey, o_totalprice FROM orders",
    "scan_evolved": "SELECT CAST(NULL AS VARCHAR) AS added_note, c_acctbal, c_custkey, CAST(NULL AS INTEGER) AS added_count, c_name FROM customer",
    "prune_at_least": f"SELECT {_AGG} FROM lineitem WHERE l_orderkey >= 9000",
    "prune_greater_than": f"SELECT {_AGG} FROM lineitem WHERE l_orderkey > 9000",
    "prune_at_most": f"SELECT {_AGG} FROM lineitem WHERE l_orderkey <= 500",
    "prune_less_than": f"SELECT {_AGG} FROM lineitem WHERE l_orderkey < 500",
    "prune_point": "SELECT o_orderstatus, o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 777",
    "prune_between": "SELECT o_orderstatus, o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 300",
    "prune_any": "SELECT o_orderstatus, o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 7, 700, 1000000000000)",
    "prune_conjunction": "SELECT event_type, count(*) AS n, min(event_id) AS first_event FROM events WHERE user_id BETWEEN 10 AND 60 AND event_type <> 'click' GROUP BY event_type",
    "prune_superset": "SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(28,4))) AS DOUBLE) AS revenue FROM lineitem WHERE l_orderkey BETWEEN 2050 AND 2349 GROUP BY l_returnflag",
    "zone_map": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {'NULL' if text else f'CAST(min({c}) AS DOUBLE)'} AS least, {'NULL' if text else f'CAST(max({c}) AS DOUBLE)'} AS greatest, {f'min({c})' if text else 'NULL'} AS first_text, {f'max({c})' if text else 'NULL'} AS last_text, CAST(count(*) - count({c}) AS BIGINT) AS nulls, count(*) AS n FROM orders"
        for c, text in (("o_orderkey", False), ("o_custkey", False), ("o_totalprice", False), ("o_orderstatus", True))
    ),
    "batch_revenue": "SELECT CAST(sum(CAST(round_even(l_extendedprice * (1 - l_discount) * 10000, 0) AS BIGINT)) AS BIGINT) AS units, count(*) AS n FROM lineitem WHERE l_orderkey >= 500",
    "interop_summary": "SELECT count(*) AS n, count(*) - count(event_type) AS null_kinds, min(user_id) AS least, max(user_id) AS greatest, CAST(sum(CAST(value AS DECIMAL(28,4))) AS DOUBLE) AS total FROM events",
    "roundtrip_codecs": f"SELECT codec, {_AGG} FROM lineitem, (VALUES ('none'), ('snappy'), ('gzip'), ('lz4'), ('zstd'), ('brotli')) c(codec) GROUP BY codec",
    "roundtrip_row_groups": "SELECT CAST(ceil(count(*) / 1000.0) AS BIGINT) AS row_groups, count(*) AS n, least(1000, count(*)) AS largest FROM orders",
    "nested_roundtrip": """SELECT o_orderkey AS key, o_orderkey % 5 = 0 AS no_place, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 THEN o_orderstatus END AS region,
        CAST(CASE WHEN o_orderkey % 7 = 0 THEN -1 WHEN o_orderkey % 7 = 1 THEN 0 ELSE 2 END AS INTEGER) AS n_words,
        CASE WHEN o_orderkey % 7 > 1 THEN o_orderpriority END AS first_word, CASE WHEN o_orderkey % 7 > 1 AND o_orderkey % 2 = 0 THEN 'x' END AS second_word,
        CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey * 2 ELSE -1 END AS part_key FROM orders""",
    "list_scan": "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dims, CAST(embedding[1] AS DOUBLE) AS first_value, label FROM embeddings",
    "arrow_ingest": "SELECT CAST(r_regionkey AS BIGINT) AS key, r_name AS region FROM region",
    "ts_convert": "SELECT event_id, epoch_us(ts) AS micros, epoch_us(ts) // 1000 AS millis, epoch_us(ts) AS micros_again, epoch_us(ts) // 1000 * 1000 AS millis_again, epoch_us(ts) * 10 + 621355968000000000 AS ticks, epoch_us(ts) AS ticks_again, CAST(sign(epoch_us(ts) * 10 - 30000000000000007) AS BIGINT) * (abs(epoch_us(ts) * 10 - 30000000000000007) // 10) AS early_micros, CAST(sign(epoch_us(ts) * 10 - 30000000000000007) AS BIGINT) * (abs(epoch_us(ts) * 10 - 30000000000000007) // 10000) AS early_millis FROM events",
    "numeric_convert": """SELECT o_orderkey, o_totalprice * 0.5::DOUBLE AS half, CAST(CAST(o_totalprice AS FLOAT) * CAST(1.1 AS FLOAT) AS DOUBLE) AS single, o_orderkey AS wide,
        CAST((o_orderkey * 100003 + 32768) % 65536 - 32768 AS SMALLINT) AS low16, CAST((o_orderkey * 4000037 + 2147483648) % 4294967296 - 2147483648 AS INTEGER) AS low32 FROM orders""",
    "null_pack": "SELECT count(CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END) AS present, count(CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END) AS packed, count(*) AS n FROM orders",
    "enum_map": "SELECT CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS INTEGER) AS code, l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY l_returnflag",
    "time_convert": """SELECT o_orderkey, CAST(trunc((o_orderkey * 1234567 - 5000000000) / 1000.0) AS INTEGER) AS millis, o_orderkey * 1000003 % 86400000000 AS of_day,
        CAST(CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS BIGINT) AS days, printf('%d.%04d', o_orderkey * 12345 // 10000, o_orderkey * 12345 % 10000) AS exact FROM orders""",
}


SQL |= {name: _groups_sql(groups, rows) for name, (_, groups, rows) in GROUPS.items()}
SQL["groups_without_statistics"] = f"{_RANGED_SQL} SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS candidates, CAST(sum(n) AS BIGINT) AS read, CAST(0 AS BIGINT) AS notes FROM g"
SQL["row_group_batches"] = f"""{_RANGED_SQL} SELECT (SELECT count(*) FROM g) AS batches, count(*) AS n, (SELECT max(n) FROM g) AS largest,
    CAST(sum(CAST(round_even(l_extendedprice * (1 - l_discount) * 10000, 0) AS BIGINT)) AS BIGINT) AS units FROM lineitem"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _groups_query(name) if name in GROUPS else globals()[name] for name in SQL}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
