"""Delimited numeric text in and out."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import NdFrame, cast
from ..plans.ordered import positions

#: Tokens that genfromtxt reads as missing.
MISSING = ("", "N/A", "NA", "n/a", "nan", "NaN", "NULL", "null", "None")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and byte order: text splits keep both, so positions can be restored."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__at"))
    return rows.withColumn("__n", F.monotonically_increasing_id())


def _numbered(spark: SparkSession, path: str, keep: Column, skip: int = 0) -> DataFrame:
    """Kept lines by their order in the file, the first ``skip`` physical ones left out."""
    rows = _lines(spark, path)
    if skip:
        rows = positions(rows, F.col("__file"), F.col("__at"), F.col("__n"), name="__line").where(F.col("__line") >= skip)
    body = F.trim(F.regexp_replace("value", "#.*$", ""))
    rows = rows.select("__file", "__at", "__n", body.alias("value")).where((F.col("value") != "") & keep)
    return positions(rows, F.col("__file"), F.col("__at"), F.col("__n"))


def _fields(value: Column, delimiter: str | None) -> Column:
    return F.split(value, r"\s+") if not delimiter or not delimiter.strip() else F.split(value, "".join(f"\\{c}" if not c.isalnum() else c for c in delimiter))


def _squeezed(df: DataFrame, rows: int, width: int, dtype: str) -> NdFrame:
    """One row or one column makes a vector."""
    if width == 1:
        return NdFrame(df.select("i0", "v"), (rows,), dtype)
    if rows == 1:
        return NdFrame(df.select(F.col("i1").alias("i0"), "v"), (width,), dtype)
    return NdFrame(df.select("i0", "i1", "v"), (rows, width), dtype)


def _read(spark: SparkSession, path: str, delimiter: str | None, dtype: str, skip: int, most: int | None, missing: bool) -> NdFrame:
    rows = _numbered(spark, path, F.lit(True), skip)
    if most is not None:
        rows = rows.where(F.col("i0") < most)
    rows = rows.select("i0", _fields(F.col("value"), delimiter).alias("f"))
    n, low, high = rows.agg(F.count("*"), F.min(F.size("f")), F.max(F.size("f"))).first()
    if n and low != high:
        raise ValueError("rows differ in their number of columns")
    token = F.trim(F.col("t"))
    number = token.try_cast("double")
    value = F.when(token.isin(*MISSING), math.nan).otherwise(F.coalesce(number, F.lit(math.nan))) if missing else F.when(number.isNotNull(), number).otherwise(F.raise_error(F.concat(F.lit("not a number: "), token)).cast("double"))
    cells = rows.select("i0", F.posexplode("f").alias("i1", "t")).select("i0", F.col("i1").cast("long").alias("i1"), cast(value, "float64", dtype).alias("v"))
    return _squeezed(cells, n, high or 0, dtype)


def loadtxt(spark: SparkSession, path: str, delimiter: str | None = None, dtype: str = "float64") -> NdFrame:
    """Rectangular numbers; comments and blank lines are skipped, ragged rows and other text are errors."""
    return _read(spark, path, delimiter, dtype, 0, None, False)


def genfromtxt(spark: SparkSession, path: str, delimiter: str | None = None, skip_header: int = 0, max_rows: int | None = None, dtype: str = "float64") -> NdFrame:
    """As loadtxt, with a header, a row limit, and NaN for what is missing or no number."""
    return _read(spark, path, delimiter, dtype, skip_header, max_rows, True)


def recfromtxt(spark: SparkSession, path: str, delimiter: str | None = None, skip_header: int = 0) -> DataFrame:
    """Rows as structs of doubles f0, f1, ..."""
    rows = _numbered(spark, path, F.lit(True), skip_header).select("i0", _fields(F.col("value"), delimiter).alias("f"))
    width = rows.agg(F.max(F.size("f"))).first()[0] or 0
    return rows.select("i0", F.struct(*(F.coalesce(F.trim(F.get("f", F.lit(k))).try_cast("double"), F.lit(math.nan)).alias(f"f{k}") for k in range(width))).alias("record"))


def text_lines(a: NdFrame, delimiter: str = " ", fmt: str = "%.18e") -> DataFrame:
    """i0, value: a line for each row of a vector or matrix."""
    if a.ndim > 2 or a.dtype.startswith("complex"):
        raise ValueError("real vectors and matrices only")
    cell = F.col("v").cast("string") if fmt == "%s" else F.format_string(fmt, F.col("v").cast("long" if fmt[-1] in "dxo" else "double"))
    if a.ndim < 2:
        return a.df.select(F.col("i0") if a.ndim else F.lit(0).alias("i0"), cell.alias("value"))
    rows = a.df.groupBy("i0").agg(F.array_sort(F.collect_list(F.struct("i1", cell.alias("t")))).alias("c"))
    return rows.select("i0", F.array_join(F.transform("c", lambda s: s.t), delimiter).alias("value"))


def savetxt(a: NdFrame, path: str, delimiter: str = " ", fmt: str = "%.18e") -> None:
    """Part files in row order."""
    text_lines(a, delimiter, fmt).repartitionByRange("i0").sortWithinPartitions("i0").select("value").write.mode("overwrite").text(path)


def array_to_csv(a: NdFrame, delimiter: str = ",") -> str:
    """A small array as one text on the driver."""
    return "\n".join(r["value"] for r in text_lines(a, delimiter, "%s").orderBy("i0").collect())
