"""Record arrays as struct columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..meta import SPARK, itemsize, of_spark


def struct_dtype(fields: dict[str, str]) -> T.StructType:
    return T.StructType([T.StructField(name, SPARK[kind]) for name, kind in fields.items()])


def field_names(kind: T.StructType) -> list[str]:
    return kind.fieldNames()


def find_field(kind: T.StructType, name: str) -> int:
    """Place of a field, -1 if there is none."""
    return kind.fieldNames().index(name) if name in kind.fieldNames() else -1


def field_offsets(kind: T.StructType) -> dict[str, int]:
    """Bytes before each field of a packed record."""
    out, at = {}, 0
    for f in kind.fields:
        out[f.name] = at
        at += itemsize(of_spark(f.dataType))
    return out


def struct_itemsize(kind: T.StructType) -> int:
    return sum(itemsize(of_spark(f.dataType)) for f in kind.fields)


def make(**fields: Column) -> Column:
    return F.struct(*(c.alias(name) for name, c in fields.items()))


def get_field(record: Column, name: str) -> Column:
    return record[name]


def set_field(record: Column, name: str, value: Column) -> Column:
    return record.withField(name, value)


def get_record(df: DataFrame, record: str, index: str, i: int, size: int) -> DataFrame:
    """Numeric fields of one record as doubles; a negative place counts from the end."""
    at = i + size if i < 0 else i
    if not 0 <= at < size:
        raise IndexError(i)
    kind = df.schema[record].dataType
    numeric = [f.name for f in kind.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    return df.where(F.col(index) == at).select(*(F.col(f"{record}.{n}").cast("double").alias(n) for n in numeric))


def set_record(df: DataFrame, record: str, index: str, i: int, **values: float) -> DataFrame:
    new = F.col(record)
    for name, v in values.items():
        new = new.withField(name, F.lit(v).cast(df.schema[record].dataType[name].dataType))
    return df.withColumn(record, F.when(F.col(index) == i, new).otherwise(F.col(record)))
