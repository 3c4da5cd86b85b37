import datetime
import uuid
from decimal import Decimal
from typing import Optional

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lithic.functions import transforms as tr
from lithic.operators.pruning import ColumnStatistics, RowGroupMetadata, accept_row_group, from_raw, may
from lithic.plans.model import column, record
from lithic.plans.resolve import InvalidData
from lithic.sources import arrow_bridge, footer
from lithic.sources.guards import Limits
from lithic.sources.reader import NotSupported, ReadOptions, scan, scan_buffer, scan_stream
from lithic.sources.writer import WriteOptions, write, write_arrow, write_chunks, write_rows


@record
class Event:
    key: int = column(sort_key=True)
    bucket: int = column(type="int32")
    payload: Optional[str]


@record
class Base:
    id: int = column(type="int32")
    name: str
    score: Optional[float]


@record
class Extended:
    score: Optional[float]
    id: int = column(type="int32")
    name: str
    note: Optional[str]
    amount: Optional[Decimal] = column(precision=18, scale=4)


@record
class Demands:
    id: int = column(type="int32")
    absent: int


@record
class Widens:
    id: int


@record
class Types:
    flag: bool
    i8: int = column(type="int8")
    u8: int = column(type="uint8")
    u32: Optional[int] = column(type="uint32")
    f32: float = column(type="float32")
    blob: Optional[bytes]
    money: Decimal = column(precision=18, scale=4)
    day: datetime.date
    at: datetime.datetime
    local: datetime.datetime = column(timestamp="local")
    span: Optional[int] = column(type="duration_millis")
    clock: Optional[int] = column(type="time_micros")
    name: Optional[uuid.UUID]


@pytest.fixture(scope="module")
def sorted_events(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("events") / "sorted")
    rows = spark.range(10_000).selectExpr("id as key", "cast(id % 7 as int) as bucket", "concat('p', id) as payload")
    write(rows, Event, at, WriteOptions(row_group_size=100, files=1))
    return at


def groups(s):
    return sorted(r["row_group"] for r in s.row_groups().collect())


def test_pruning_opens_exact_groups(spark, sorted_events):
    s = scan(spark, Event, sorted_events)
    assert groups(s.where(may("key").equal(7531))) == [75]
    assert groups(s.where(may("key").between(2050, 2349))) == [20, 21, 22, 23]
    assert groups(s.where(may("key").any_of([]))) == []
    assert groups(s.where(may("key").less_than(100) | may("key").at_least(9900))) == [0, 99]
    assert groups(s.where(~may("key").less_than(9950))) == [99]
    assert len(groups(s.where(may("key").greater_than(-1) & may("bucket").at_most(3)))) == 100
    kept = s.where(may("key").equal(7531)).to_array()
    assert [r.key for r in kept] == list(range(7500, 7600))


def test_pruning_never_drops_a_match(spark, sorted_events):
    whole = scan(spark, Event, sorted_events).to_df()
    for p in (may("key").at_least(4321), may("key").greater_than(4321), may("key").at_most(17), may("key").less_than(17), may("payload").equal("p5")):
        want = whole.where(p.residual()).count()
        assert scan(spark, Event, sorted_events).where(p).to_df().where(p.residual()).count() == want


def test_statistics_rules():
    s = ColumnStatistics(3, 9)
    assert s.may_contain(3) and s.may_contain(9) and not s.may_contain(10)
    assert s.may_contain_at_least(9) and not s.may_contain_greater_than(9)
    assert s.may_contain_at_most(3) and not s.may_contain_less_than(3)
    assert s.may_contain_between(9, 20) and not s.may_contain_between(10, 20)
    assert s.may_contain_any([1, 4]) and not s.may_contain_any(None)
    assert ColumnStatistics().may_contain_any(None) and ColumnStatistics(float("nan"), 1.0).may_contain(5)
    model = Event.__record__
    full = {c.name: ColumnStatistics("a" if c.name == "payload" else 1, "b" if c.name == "payload" else 2) for c in model.prunable}
    never = lambda m: False
    assert not accept_row_group(model, never, RowGroupMetadata(0, 1, full))
    assert accept_row_group(model, None, RowGroupMetadata(0, 1, full))
    assert accept_row_group(model, never, RowGroupMetadata(0, 1, {k: v for k, v in full.items() if k != "bucket"}))
    assert from_raw(300, "int8") is None and from_raw(200, "uint8") == 200 and from_raw(1.5, "int32") is None and from_raw(b"x", "string") == "x"


def test_three_shapes_agree(spark, sorted_events):
    s = scan(spark, Event, sorted_events)
    array, stream = s.to_array(), list(s.rows())
    batches = list(s.batches())
    assert [r.key for r in array] == list(range(10_000)) and array == stream
    assert [b.num_rows for b in batches] == [100] * 100
    assert sum(sum(b.column("key").to_pylist()) for b in batches) == sum(range(10_000))


def test_builder_rules(spark, sorted_events):
    s, p = scan(spark, Event, sorted_events), may("key").equal(1)
    for wrong in (lambda: s.where(p).parallel(), lambda: s.parallel().where(p), lambda: s.where(p).where(p), lambda: s.parallel().rows(), lambda: next(s.parallel().batches()), lambda: next(s.where(p).batches())):
        with pytest.raises(NotSupported):
            wrong()
    for wrong in (lambda: s.where(None), lambda: s.with_options(None), lambda: scan(spark, Event, "")):
        with pytest.raises(ValueError):
            wrong()
    assert s.with_options(ReadOptions(strict=False)).parallel().where(p).to_df().count() == 100
    assert s.with_options(ReadOptions(max_tasks=1)).to_df().rdd.getNumPartitions() == 1


def test_buffers_and_streams(spark, tmp_path):
    at = tmp_path / "one.parquet"
    pq.write_table(pa.table({"id": pa.array([1, 2], pa.int32()), "name": ["a", "b"], "score": [None, 2.5]}), at)
    assert scan_buffer(spark, Base, at.read_bytes()).to_df().count() == 2
    with at.open("rb") as f:
        s = scan_stream(spark, Base, f)
    assert [r.name for r in s.to_array()] == ["a", "b"]
    with pytest.raises(NotSupported):
        s.parallel()
    with pytest.raises(ValueError):
        scan_buffer(spark, Base, None)


def test_schema_evolution(spark, tmp_path):
    at = str(tmp_path / "base.parquet")
    pq.write_table(pa.table({"extra": [1, 2, 3], "SCORE": [None, 1.5, 2.5], "name": ["a", "b", "c"], "id": pa.array([1, 2, 3], pa.int32())}), at)
    rows = scan(spark, Extended, at).to_array()
    assert [(r.score, r.id, r.name, r.note, r.amount) for r in rows] == [(None, 1, "a", None, None), (1.5, 2, "b", None, None), (2.5, 3, "c", None, None)]
    with pytest.raises(InvalidData, match="absent"):
        scan(spark, Demands, at).to_df()
    with pytest.raises(InvalidData, match="id"):
        scan(spark, Widens, at).to_df()
    pq.write_table(pa.table({"id": pa.array([1], pa.int32()), "name": [["a"]], "score": [1.0]}), str(tmp_path / "group.parquet"))
    with pytest.raises(InvalidData, match="name"):
        scan(spark, Base, str(tmp_path / "group.parquet")).to_df()
    pq.write_table(pa.table({"id": pa.array([1], pa.int32()), "name": ["a"], "amount": pa.array([Decimal("1.00")], pa.decimal128(18, 2))}), str(tmp_path / "scale.parquet"))
    with pytest.raises(InvalidData, match="amount"):
        scan(spark, Extended, str(tmp_path / "scale.parquet")).to_df()
    pq.write_table(pa.table({"id": pa.array([None], pa.int32()), "name": ["a"], "score": [1.0]}), str(tmp_path / "null.parquet"))
    with pytest.raises(Exception, match="holds a null"):
        scan(spark, Base, str(tmp_path / "null.parquet")).to_array()


def test_type_matrix_through_arrow(spark, tmp_path):
    some = uuid.UUID(int=7)
    table = pa.table(
        {
            "flag": [True], "i8": pa.array([-8], pa.int8()), "u8": pa.array([255], pa.uint8()), "u32": pa.array([2**32 - 1], pa.uint32()), "f32": pa.array([1.5], pa.float32()),
            "blob": [b"\0x"], "money": pa.array([Decimal("-123.4567")], pa.decimal128(18, 4)), "day": [datetime.date(1969, 12, 31)],
            "at": pa.array([1_700_000_000_000_001], pa.timestamp("us", "UTC")), "local": pa.array([5], pa.timestamp("us")),
            "span": pa.array([1500], pa.time32("ms")), "clock": pa.array([86_399_999_999], pa.time64("us")), "name": pa.array([some.bytes], pa.binary(16)),
        }
    )
    at = str(tmp_path / "types.parquet")
    pq.write_table(table, at)
    row = scan(spark, Types, at).to_array()[0]
    assert (row.i8, row.u8, row.u32, row.f32, row.money, row.span, row.clock, bytes(row.name)) == (-8, 255, 2**32 - 1, 1.5, Decimal("-123.4567"), 1500, 86_399_999_999, some.bytes)
    assert row.day == datetime.date(1969, 12, 31)
    assert not arrow_bridge.faults(table, Types)
    assert arrow_bridge.to_frame(spark, table, Types).collect()[0].u32 == 2**32 - 1


def test_arrow_faults_come_together(spark):
    bad = pa.table({"id": pa.array([1, None], pa.int32()), "name": pa.array(["a", "b"]).dictionary_encode(), "SCORE": [1.0, 2.0]})
    found = arrow_bridge.faults(bad, Base)
    assert len(found) == 3 and "nulls" in found[0] and "dictionary" in found[1] and "missing" in found[2]
    with pytest.raises(InvalidData, match="dictionary.*missing"):
        arrow_bridge.to_frame(spark, bad, Base)
    assert arrow_bridge.eligible(Base)
    for count, lanes in ((-1, {}), (2, {"id": [1, 2], "name": ["a"], "score": [None, 1.0]}), (1, {"id": [1]})):
        with pytest.raises(ValueError):
            arrow_bridge.batch(Base, count, lanes)
    made = arrow_bridge.batch(Base, 2, {"id": [1, 2], "name": ["a", "b"], "score": [None, 1.0]})
    values, levels = arrow_bridge.packed(made.column("score"))
    assert levels.to_pylist() == [0, 1] and arrow_bridge.filled(values, levels).equals(made.column("score"))


def test_writing(spark, tmp_path):
    at = str(tmp_path / "w")
    write_rows(spark, [{"id": 1, "name": "a", "score": None}, {"id": 2, "name": "b", "score": 0.5}], Base, at, count=2)
    assert scan(spark, Base, at).to_df().count() == 2
    with pytest.raises(ValueError, match="announced"):
        write_rows(spark, [], Base, at, count=1)
    assert write_chunks(spark, iter([[(1, "a", None)], [(2, "b", 1.0)]]), Base, str(tmp_path / "c")) == 2
    assert scan(spark, Base, str(tmp_path / "c")).to_df().count() == 2
    batch = arrow_bridge.batch(Base, 3, {"id": [1, 2, 3], "name": ["a", "b", "c"], "score": [None, 1.0, 2.0]})
    write_arrow(spark, batch, Base, str(tmp_path / "a"), WriteOptions(row_group_size=1))
    assert footer.row_groups(spark, str(tmp_path / "a")).count() == 1
    for codec, shown in (("zstd", "ZSTD"), ("lz4", "LZ4"), ("none", "UNCOMPRESSED")):
        write(scan(spark, Base, at).to_df(), Base, str(tmp_path / codec), WriteOptions(compression=codec, level="fastest" if codec == "zstd" else "optimal"))
        assert {r.codec for r in footer.zone_map(spark, str(tmp_path / codec)).select("codec").collect()} <= {shown, shown + "_RAW"}
    with pytest.raises(Exception, match="is no uint8"):
        record_of = spark.createDataFrame([(300,)], "v int")
        write(record_of, _Small, str(tmp_path / "u"))


@record
class _Small:
    v: int = column(type="uint8")


def test_guards(spark, tmp_path):
    at = str(tmp_path / "g.parquet")
    pq.write_table(pa.table({"id": pa.array(range(1000), pa.int32()), "name": ["x" * 100] * 1000, "score": [1.0] * 1000}), at, row_group_size=100)

    def read(**limits):
        return scan(spark, Base, at).with_options(ReadOptions(limits=Limits(**limits))).to_array()

    assert len(read(check_pages=True)) == 1000
    for limits in ({"max_row_groups": 9}, {"max_allocation_values": 999}, {"max_allocation_bytes": 1000}, {"max_column_chunks": 5}, {"max_nesting_depth": 0}, {"check_pages": True, "max_dictionary_entries": 0}, {"check_pages": True, "max_page_bytes": 10}, {"max_footer_bytes": 10}):
        with pytest.raises(InvalidData):
            read(**limits)
    with pytest.raises(Exception, match="100 bytes"):
        read(max_string_bytes=99)
    raw = bytearray((tmp_path / "g.parquet").read_bytes())
    for name, broken in (("cut", raw[:-20]), ("tail", raw[:-4] + b"PARX"), ("tiny", b"PAR1"), ("length", raw[:-8] + b"\xff\xff\xff\x7fPAR1")):
        (tmp_path / f"{name}.parquet").write_bytes(bytes(broken))
        with pytest.raises(InvalidData):
            scan(spark, Base, str(tmp_path / f"{name}.parquet")).to_df()


def test_guards_by_default(spark, tmp_path):
    """Page bounds need no option, and texts in structs and lists count."""
    from lithic.plans.model import Column, Options
    from lithic.sources.guards import guarded

    at = str(tmp_path / "g.parquet")
    pq.write_table(pa.table({"id": pa.array(range(1000), pa.int32()), "name": ["x" * 100] * 1000, "score": [1.0] * 1000}), at)
    for limits in ({"max_dictionary_entries": 0}, {"max_page_bytes": 10}):
        with pytest.raises(InvalidData):
            scan(spark, Base, at).with_options(ReadOptions(limits=Limits(**limits))).to_array()

    class Odd(Column):
        spark_type = None

    for kind, value in (("struct<a:int,b:array<string>>", (1, ["ok", None, "x" * 100])), ("array<struct<s:string,t:string>>", [("ok", "x" * 100), None]), ("map<string,int>", {"x" * 100: 1})):
        df = spark.createDataFrame([(value,), (None,)], f"v {kind}")
        c = Odd("v", "v", "record", True, Options())
        object.__setattr__(c, "__class__", type("Shown", (Odd,), {"spark_type": df.schema["v"].dataType}))
        assert df.select(guarded(c, F.col("v"), Limits(max_string_bytes=100))).where("v is null").count() == 1
        with pytest.raises(Exception, match="100 bytes"):
            df.select(guarded(c, F.col("v"), Limits(max_string_bytes=99))).collect()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_unused_columns_are_not_read(spark, sorted_events):
    s = scan(spark, Event, sorted_events)
    assert "ReadSchema: struct<bucket:int>" in plan_of(s.to_df().select("bucket"))
    pushed = plan_of(s.filter(F.col("key") >= 9000).to_df().select("bucket"))
    assert "GreaterThanOrEqual(key,9000)" in pushed and "payload" not in pushed.partition("ReadSchema")[2]


def test_tables_may_be_larger_than_a_group(spark, tmp_path):
    """Limits count what is held at once: a scan of more rows than one group may have goes on, an array of them doesn't."""
    at = str(tmp_path / "many.parquet")
    pq.write_table(pa.table({"id": pa.array(range(1000), pa.int32()), "name": ["a"] * 1000, "score": [1.0] * 1000, "wide": ["w"] * 1000}), at, row_group_size=100)
    s = scan(spark, Base, at).with_options(ReadOptions(limits=Limits(max_allocation_values=100, max_allocation_bytes=2800)))
    assert s.to_df().count() == 1000
    with pytest.raises(InvalidData, match="1000 rows"):
        s.to_array()
    with pytest.raises(InvalidData, match="needs 2800 bytes"):
        scan(spark, Base, at).with_options(ReadOptions(limits=Limits(max_allocation_bytes=2799))).to_df()


def test_footers_are_remembered(spark, tmp_path, monkeypatch):
    from lithic.sources import guards

    at = tmp_path / "one.parquet"
    pq.write_table(pa.table({"id": pa.array([1], pa.int32()), "name": ["a"]}), at)
    calls, look = [], guards._look
    monkeypatch.setattr(guards, "_look", lambda *a: calls.append(a) or look(*a))
    for _ in range(3):
        assert scan(spark, Base, str(at)).to_df().count() == 1
    assert len(calls) == 1
    pq.write_table(pa.table({"id": pa.array([1, 2], pa.int64()), "name": ["a", "b"]}), at)
    with pytest.raises(InvalidData, match="id"):
        scan(spark, Base, str(at)).to_df()
    assert len(calls) == 2 and len(guards._checked) <= guards._REMEMBERED


def test_many_files_are_looked_at_in_tasks(spark, tmp_path):
    """More files than the driver looks at itself, one of them broken."""
    for k in range(40):
        pq.write_table(pa.table({"id": pa.array([k], pa.int32()), "name": ["a"], **({"score": [0.5]} if k % 2 else {})}), tmp_path / f"{k}.parquet")
    s = scan(spark, Base, str(tmp_path))
    assert s.to_df().agg(F.sum("id"), F.count("score")).first() == (sum(range(40)), 20)
    assert scan(spark, Base, f"{tmp_path}/1?.parquet").to_df().count() == 10
    (tmp_path / "x.parquet").write_bytes(b"PAR1 and no footer PAR1")
    with pytest.raises(InvalidData, match="x.parquet"):
        s.to_df()
    with pytest.raises(Exception, match="(?i)path does not exist|PATH_NOT_FOUND"):
        scan(spark, Base, str(tmp_path / "nowhere")).to_df()


def test_store_that_only_spark_opens(spark, sorted_events):
    """viewfs is no file system of Arrow's: footers come through Hadoop's, and whole row groups through Spark's scan."""
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.lithictest.link./in", f"file://{sorted_events}")
    s = scan(spark, Event, "viewfs://lithictest/in")
    assert s.to_df().count() == 10_000
    assert groups(s.where(may("key").between(2050, 2349))) == [20, 21, 22, 23]
    kept = s.where(may("key").equal(7531)).to_df()
    assert sorted(r.key for r in kept.collect()) == list(range(7500, 7600))
    assert footer.row_groups(spark, "viewfs://lithictest/in").agg(F.sum("row_count")).first()[0] == 10_000
    with pytest.raises(InvalidData):
        s.with_options(ReadOptions(limits=Limits(max_row_groups=9))).to_df()
    with pytest.raises(NotSupported):
        next(s.batches())


def test_batches_where_the_data_is(spark, sorted_events):
    def show(b):
        return pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([sum(b.column("key").to_pylist())], pa.int64())], ["n", "total"])

    rows = scan(spark, Event, sorted_events).map_batches(show, "n long, total long").collect()
    assert len(rows) == 100 and {r.n for r in rows} == {100} and sum(r.total for r in rows) == sum(range(10_000))
    with pytest.raises(NotSupported):
        scan(spark, Event, sorted_events).where(may("key").equal(1)).map_batches(show, "n long, total long")


def test_buffers_have_names_of_their_own(spark):
    """A scan of a buffer is lazy: another buffer of the same size must not be read in its place."""
    import io

    def data(name):
        out = io.BytesIO()
        pq.write_table(pa.table({"id": pa.array([1], pa.int32()), "name": [name]}), out)
        return out.getvalue()

    first, second = (scan_buffer(spark, Base, data(n)).to_df() for n in "ab")
    assert first.collect()[0].name == "a" and second.collect()[0].name == "b"


def test_broken_levels_say_why(spark):
    from lithic import rule_queries as r

    import io

    lists = io.BytesIO()
    pq.write_table(pa.table({"id": pa.array([1, 2], pa.int32()), "scores": pa.array([[10], [20]], pa.list_(pa.int32()))}), lists, compression="none", use_dictionary=False)
    lists = lists.getvalue()
    checked = ReadOptions(limits=Limits(check_levels=True))
    for broken, said in ((r._bad_levels(lists), "illegal definition level 99"), (r._fewer_rows(lists, of_flat=True), "levels of 2 rows in a row group of 1"), (r._fewer_rows(lists), "2 values for 1 rows")):
        with pytest.raises(InvalidData, match=said):
            scan_buffer(spark, r.Listed, broken).with_options(checked).to_df()
    for how in ({"data_page_version": "2.0"}, {"compression": "zstd"}, {"compression": "snappy", "data_page_version": "2.0"}, {"compression": "lz4"}, {"compression": "gzip"}):
        out = io.BytesIO()
        values = [[1, None, 3], None, [], [None]] * 300 + [list(range(50))] * 40
        pq.write_table(pa.table({"id": pa.array(range(len(values)), pa.int32()), "scores": pa.array(values, pa.list_(pa.int32()))}), out, row_group_size=500, **how)
        assert scan_buffer(spark, r.Listed, out.getvalue()).with_options(checked).to_df().count() == len(values)


def test_footer_bounds():
    """Ranges, overlaps, physical types and counts that no honest writer makes."""
    from types import SimpleNamespace as N

    from lithic.sources.guards import check_footer

    def footer_of(*chunks, rows=10, leaves=("INT32", "INT32")):
        cells = [N(physical_type=c.get("kind", "INT32"), num_values=c.get("n", rows), total_compressed_size=c.get("size", 40), total_uncompressed_size=c.get("plain", 40), dictionary_page_offset=None, data_page_offset=c["at"]) for c in chunks]
        group = N(num_rows=rows, num_columns=len(cells), column=lambda k: cells[k])
        schema = N(column=lambda k: N(path=f"c{k}", physical_type=leaves[k], max_repetition_level=0))
        return N(num_row_groups=1, num_columns=len(cells), schema=schema, row_group=lambda g: group)

    check_footer("f", 200, footer_of({"at": 4}, {"at": 44}), Limits())
    for said, meta in (
        ("overlap", footer_of({"at": 4}, {"at": 43})),
        ("not in the file's data", footer_of({"at": 4}, {"at": 160})),
        ("not in the file's data", footer_of({"at": 2}, {"at": 44})),
        ("not in the file's data", footer_of({"at": 4, "size": -1}, {"at": 44})),
        ("BYTE_ARRAY in a column of INT32", footer_of({"at": 4}, {"at": 44, "kind": "BYTE_ARRAY"})),
        ("9 values for 10 rows", footer_of({"at": 4}, {"at": 44, "n": 9})),
        ("grows 501 times", footer_of({"at": 4}, {"at": 44, "plain": 40 * 501})),
        ("rows; the limit", footer_of({"at": 4}, {"at": 44}, rows=10_000_001)),
        ("rows; the limit", footer_of({"at": 4}, {"at": 44}, rows=-1)),
    ):
        with pytest.raises(InvalidData, match=said):
            check_footer("f", 200, meta, Limits())
    # What isn't read isn't counted.
    check_footer("f", 200, footer_of({"at": 4}, {"at": 44, "plain": 40 * 501}), Limits(), frozenset(["c0"]))


def test_writer_options_in_files(spark, tmp_path):
    """Dictionary pages that outgrow their bound are given up; field ids are in the file."""
    rows = spark.range(2000).selectExpr("id as key", "concat('name ', id % 50) as name").coalesce(1)
    found = {}
    for size in (64, 1 << 24):
        write(rows, _Named, str(tmp_path / f"d{size}"), WriteOptions(dictionary_page_bytes=size))
        found[size] = {r.column: r for r in footer.encodings(spark, str(tmp_path / f"d{size}")).collect()}
    assert found[1 << 24]["name"].dictionary and found[1 << 24]["name"].encodings != found[64]["name"].encodings
    assert found[64]["key"].field_id == 3 and found[64]["name"].field_id is None


def test_arrow_writer(spark, tmp_path):
    """What Spark's writer has no option for: row groups to the row, modes, encodings, levels; nothing is left of the staging folder."""
    rows = spark.range(1050).selectExpr("id as key", "concat('n', id) as name").repartition(3)
    at = str(tmp_path / "a")
    for codec, level in (("brotli", "smallest_size"), ("gzip", "fastest"), ("zstd", "optimal"), ("lz4", "optimal"), ("none", "optimal")):
        write(rows, _Named, at, WriteOptions(row_group_size=100, compression=codec, level=level, mode="overwrite", engine="arrow"))
        assert {r.codec for r in footer.zone_map(spark, at).select("codec").collect()} == {"UNCOMPRESSED" if codec == "none" else codec.upper()}
        sizes = sorted(r.row_count for r in footer.row_groups(spark, at).collect())
        assert sum(sizes) == 1050 and sizes[-1] == 100 and sum(n < 100 for n in sizes) <= 3
        assert [r.key for r in sorted(scan(spark, _Named, at).to_array())] == list(range(1050))
        assert not [p for p in (tmp_path / "a").iterdir() if p.name.startswith("_staging")]
    with pytest.raises(FileExistsError):
        write(rows, _Named, at, WriteOptions(engine="arrow"))
    write(rows, _Named, at, WriteOptions(engine="arrow", mode="append", encodings={"key": "byte_stream_split"}, dictionary_page_bytes=64))
    assert scan(spark, _Named, at).to_df().count() == 2100 and scan(spark, _Named, at).filter(F.col("key") >= 1000).to_df().count() == 100
    found = {(r.column, r.dictionary, "BYTE_STREAM_SPLIT" in r.encodings): r.field_id for r in footer.encodings(spark, at).collect()}
    assert found[("key", False, True)] == 3 and ("key", True, False) in found
    whole = scan(spark, _Named, at).where(may("key").between(5, 6)).to_df()
    assert whole.where("key between 5 and 6").count() == 4
    with pytest.raises(Exception, match="holds a null"):
        write(spark.createDataFrame([(None, "x")], "key long, name string"), _Named, str(tmp_path / "b"), WriteOptions(engine="arrow"))
    assert not [p for p in (tmp_path / "b").iterdir()]
    write(rows.limit(0), _Named, str(tmp_path / "e"), WriteOptions(engine="arrow"))
    assert scan(spark, _Named, str(tmp_path / "e")).to_df().count() == 0


@record
class _Named:
    key: int = column(field_id=3)
    name: Optional[str] = column(encoding="dictionary")


def test_negated_predicates():
    p = may("key")
    stats = lambda lo, hi: RowGroupMetadata(0, 1, {"key": ColumnStatistics(lo, hi)})
    both = ~(p.at_least(10) & p.at_most(20))
    assert both(stats(1, 9)) and both(stats(21, 30)) and both(stats(5, 15)) and not both(stats(10, 20))
    either = ~(p.less_than(10) | p.greater_than(20))
    assert either(stats(10, 20)) and not either(stats(1, 9)) and not either(stats(21, 30))
    assert not (~p.equal(3))(stats(3, 3)) and (~p.equal(3))(stats(3, 4)) and not (~p.between(1, 9))(stats(2, 8))
    assert (~p.any_of([3]))(stats(3, 3)) and p.any_of([None, 3])(stats(1, 4)) and not p.any_of([None])(stats(1, 4))


def test_transforms(spark):
    df = spark.createDataFrame([(-1500,), (1500,), (70_000,)], "v long")
    got = df.select(tr.truncated(F.col("v"), 1000).alias("t"), tr.narrowed(F.col("v"), 16).alias("n"), tr.ticks_to_micros(tr.micros_to_ticks(F.col("v"))).alias("m"), tr.level(F.col("v")).alias("l")).collect()
    assert [r.t for r in got] == [-1, 1, 70] and [r.n for r in got] == [-1500, 1500, 70_000 - 65_536] and [r.m for r in got] == [-1500, 1500, 70_000]
    with pytest.raises(Exception, match="one day"):
        df.select(tr.time_of_day(F.col("v") * 10**9)).collect()
    names = {1: "a", 2: "b"}
    assert spark.range(1, 4).select(tr.enum_name(F.col("id").cast("int"), names).alias("n")).collect()[1].n == "b"
    assert df.select(tr.decimal_restored(F.col("v"), 18, 4).alias("d")).collect()[0].d == Decimal("-0.1500")
    assert df.select(tr.millis_to_duration(F.col("v")).alias("d")).collect()[1].d == datetime.timedelta(milliseconds=1500)
