"""Column types of record models: what they are in Spark, in Parquet files, in Arrow, and in Python."""

from __future__ import annotations

import datetime
import decimal
import enum
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import types as T


@dataclass(frozen=True)
class ColumnType:
    """name: how models spell it.  spark: the type that scans give.  physical: the Parquet physical types that files may have."""

    name: str
    spark: T.DataType
    physical: tuple[str, ...]
    logical: tuple[str, ...]
    arrow: pa.DataType | None
    prunable: bool = False


# Type names, and the Parquet annotations they are stored under.
_SIMPLE = [
    ColumnType("bool", T.BooleanType(), ("BOOLEAN",), ("NONE",), pa.bool_()),
    ColumnType("int8", T.ByteType(), ("INT32",), ("INT8",), pa.int8(), True),
    ColumnType("int16", T.ShortType(), ("INT32",), ("INT16",), pa.int16(), True),
    ColumnType("int32", T.IntegerType(), ("INT32",), ("NONE", "INT32"), pa.int32(), True),
    ColumnType("int64", T.LongType(), ("INT64",), ("NONE", "INT64"), pa.int64(), True),
    ColumnType("uint8", T.ShortType(), ("INT32",), ("UINT8",), pa.uint8(), True),
    ColumnType("uint16", T.IntegerType(), ("INT32",), ("UINT16",), pa.uint16(), True),
    ColumnType("uint32", T.LongType(), ("INT32", "INT64"), ("UINT32",), pa.uint32(), True),
    ColumnType("uint64", T.DecimalType(20, 0), ("INT64", "FIXED_LEN_BYTE_ARRAY"), ("UINT64",), pa.uint64(), True),
    ColumnType("float32", T.FloatType(), ("FLOAT",), ("NONE",), pa.float32(), True),
    ColumnType("float64", T.DoubleType(), ("DOUBLE",), ("NONE",), pa.float64(), True),
    ColumnType("string", T.StringType(), ("BYTE_ARRAY",), ("STRING", "UTF8", "NONE"), pa.string(), True),
    ColumnType("binary", T.BinaryType(), ("BYTE_ARRAY",), ("NONE",), pa.binary()),
    ColumnType("date", T.DateType(), ("INT32",), ("DATE",), pa.date32()),
    ColumnType("timestamp_int96", T.TimestampType(), ("INT96", "INT64"), ("NONE", "TIMESTAMP"), pa.timestamp("us", "UTC")),
    ColumnType("timestamp_micros", T.TimestampType(), ("INT64",), ("TIMESTAMP",), pa.timestamp("us", "UTC")),
    ColumnType("timestamp_local", T.TimestampNTZType(), ("INT64",), ("TIMESTAMP",), pa.timestamp("us")),
    ColumnType("duration_millis", T.IntegerType(), ("INT32",), ("TIME", "NONE", "INT32"), pa.time32("ms")),
    ColumnType("time_micros", T.LongType(), ("INT64",), ("TIME", "NONE", "INT64"), pa.time64("us")),
    ColumnType("uuid", T.BinaryType(), ("FIXED_LEN_BYTE_ARRAY", "BYTE_ARRAY"), ("UUID", "NONE"), pa.binary(16)),
    ColumnType("interval", T.StructType([T.StructField(n, T.IntegerType(), False) for n in ("months", "days", "millis")]), (), (), None),
]
TYPES = {t.name: t for t in _SIMPLE}
#: Bounds of unsigned types, which Spark stores in a wider signed one.
UNSIGNED = {"uint8": 2**8 - 1, "uint16": 2**16 - 1, "uint32": 2**32 - 1, "uint64": 2**64 - 1}
MAX_PRECISION = 38


def decimal_type(precision: int = 38, scale: int = 18) -> ColumnType:
    """An exact decimal; 38 digits, 18 of them after the point, unless said."""
    return ColumnType(f"decimal({precision},{scale})", T.DecimalType(precision, scale), ("INT32", "INT64", "FIXED_LEN_BYTE_ARRAY", "BYTE_ARRAY"), ("DECIMAL",), pa.decimal128(precision, scale))


def from_python(annotation: type) -> str | None:
    """The type name that a plain Python annotation stands for; None if there is none."""
    if isinstance(annotation, type) and issubclass(annotation, enum.IntEnum):
        return "int32"
    return {
        bool: "bool",
        int: "int64",
        float: "float64",
        str: "string",
        bytes: "binary",
        datetime.datetime: "timestamp_micros",
        datetime.date: "date",
        datetime.timedelta: "duration_millis",
        datetime.time: "time_micros",
        decimal.Decimal: "decimal",
        uuid.UUID: "uuid",
    }.get(annotation)
