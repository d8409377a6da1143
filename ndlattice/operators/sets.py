"""Sets of values: distinct, sorted by whoever reads them in order; NaN never equals NaN across sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import positions


def _values(df: DataFrame, value: Column) -> DataFrame:
    """The values under one name; -0.0 counts as 0.0."""
    kind = df.select(value.alias("v")).schema["v"].dataType.typeName()
    return df.select((value + F.lit(0.0) if kind in ("double", "float") else value).alias("v"))


def _not_nan(df: DataFrame) -> DataFrame:
    return df.where(~F.isnan("v")) if df.schema["v"].dataType.typeName() in ("double", "float") else df


def unique(df: DataFrame, value: Column, place: Column | None = None) -> DataFrame:
    """v, count, and the first place of each value."""
    rows = _values(df, value) if place is None else df.select(value.alias("v"), place.alias("i"))
    aggregates = [F.count("*").alias("count")] + ([] if place is None else [F.min("i").alias("first")])
    return rows.groupBy("v").agg(*aggregates)


def unique_inverse(df: DataFrame, value: Column, name: str = "inverse") -> DataFrame:
    """df with each row's place among the sorted distinct values."""
    rows = df.withColumn("__v", value)
    ranks = positions(rows.select(F.col("__v").alias("__u")).distinct(), F.col("__u"), name=name)
    return rows.join(ranks, F.col("__v").eqNullSafe(F.col("__u"))).drop("__v", "__u")


def intersect1d(a: DataFrame, va: Column, b: DataFrame, vb: Column) -> DataFrame:
    return _not_nan(_values(a, va)).intersect(_values(b, vb))


def union1d(a: DataFrame, va: Column, b: DataFrame, vb: Column) -> DataFrame:
    return _values(a, va).union(_values(b, vb)).distinct()


def setdiff1d(a: DataFrame, va: Column, b: DataFrame, vb: Column) -> DataFrame:
    return _values(a, va).distinct().join(_not_nan(_values(b, vb)).distinct(), "v", "left_anti")


def setxor1d(a: DataFrame, va: Column, b: DataFrame, vb: Column) -> DataFrame:
    """Values of one side only: one aggregation over both."""
    both = _values(a, va).select("v", F.lit(1).alias("s")).union(_values(b, vb).select("v", F.lit(2).alias("s")))
    return both.groupBy("v").agg(F.min("s").alias("a"), F.max("s").alias("b")).where("a = b").select("v")


def isin(df: DataFrame, value: Column, tests: DataFrame, test: Column, invert: bool = False, name: str = "isin") -> DataFrame:
    """df with a membership flag; every row stays."""
    known = _not_nan(_values(tests, test)).where("v is not null").distinct().select(F.col("v").alias("__t"), F.lit(True).alias("__in"))
    found = df.withColumn("__x", value).join(known, F.col("__x") == F.col("__t"), "left")
    flag = F.coalesce("__in", F.lit(False))
    return found.withColumn(name, ~flag if invert else flag).drop("__x", "__t", "__in")


in1d = isin


def dense_rank(df: DataFrame, by: list[str], value: Column, name: str = "rank") -> DataFrame:
    """Rank of values inside groups, from 0."""
    return df.withColumn(name, F.dense_rank().over(Window.partitionBy(*by).orderBy(value)) - 1)
