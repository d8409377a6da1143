"""Arrays made from a rule: every cell is an expression over ranges of indices."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import NdFrame, cast
from ..meta import NdMeta, strides


def cells(spark: SparkSession, shape: Sequence[int]) -> DataFrame:
    """i0, ..., ik for every index of the shape, from one range; nothing is joined."""
    meta = NdMeta(tuple(shape), "int64")
    out = [(F.floor(F.col("id") / step) % n).cast("long").alias(f"i{k}") for k, (n, step) in enumerate(zip(shape, meta.strides, strict=True))]
    return spark.range(meta.size).select(*out)


def from_rule(spark: SparkSession, shape: Sequence[int], rule: Callable[..., Column], dtype: str = "float64") -> NdFrame:
    """rule takes one Column for each index."""
    names = [f"i{k}" for k in range(len(shape))]
    return NdFrame(cells(spark, shape).withColumn("v", cast(rule(*map(F.col, names)), "float64", dtype)), shape, dtype)


def fromfunction(spark: SparkSession, f: Callable[..., float], shape: Sequence[int], dtype: str = "float64") -> NdFrame:
    """A Python function over coordinates, in Arrow batches."""
    @F.pandas_udf("double")
    def each(index: pd.DataFrame) -> pd.Series:
        return pd.Series([float(f(*row)) for row in index.itertuples(index=False)])

    return from_rule(spark, shape, lambda *i: each(F.struct(*i)), dtype)


def fromiter(spark: SparkSession, values: Iterable[float], count: int, dtype: str = "float64") -> NdFrame:
    rows = [(i, float(v)) for i, v in zip(range(count), values, strict=False)]
    if len(rows) < count:
        raise ValueError("iterator too short")
    return NdFrame(spark.createDataFrame(rows, "i0 long, v double").withColumn("v", cast(F.col("v"), "float64", dtype)), (count,), dtype)


def full(spark: SparkSession, shape: Sequence[int], value: float, dtype: str = "float64") -> NdFrame:
    return from_rule(spark, shape, lambda *_: F.lit(float(value)), dtype)


def zeros(spark: SparkSession, shape: Sequence[int], dtype: str = "float64") -> NdFrame:
    return full(spark, shape, 0, dtype)


empty = zeros


def ones(spark: SparkSession, shape: Sequence[int], dtype: str = "float64") -> NdFrame:
    return full(spark, shape, 1, dtype)


def full_like(a: NdFrame, value: float) -> NdFrame:
    return NdFrame(a.df.select(*a.idx, cast(F.lit(float(value)), "float64", a.dtype).alias("v")), a.shape, a.dtype)


def zeros_like(a: NdFrame) -> NdFrame:
    return full_like(a, 0)


empty_like = zeros_like


def ones_like(a: NdFrame) -> NdFrame:
    return full_like(a, 1)


def arange(spark: SparkSession, start: float, stop: float, step: float = 1, dtype: str = "float64") -> NdFrame:
    if step == 0:
        raise ValueError("step is 0")
    n = max(0, math.ceil((stop - start) / step))
    return from_rule(spark, (n,), lambda i: F.lit(float(start)) + i * F.lit(float(step)), dtype)


def linspace(spark: SparkSession, start: float, stop: float, num: int = 50, endpoint: bool = True, dtype: str = "float64") -> NdFrame:
    step = (stop - start) / max(1, num - endpoint)
    def at(i: Column) -> Column:
        return F.when((i == num - 1) & F.lit(endpoint and num > 1), float(stop)).otherwise(F.lit(float(start)) + i * F.lit(float(step)))
    return from_rule(spark, (num,), at, dtype)


def logspace(spark: SparkSession, start: float, stop: float, num: int = 50, endpoint: bool = True, base: float = 10.0, dtype: str = "float64") -> NdFrame:
    return linspace(spark, start, stop, num, endpoint).map(lambda v: cast(F.pow(F.lit(float(base)), v), "float64", dtype), dtype)


def geomspace(spark: SparkSession, start: float, stop: float, num: int = 50, endpoint: bool = True, dtype: str = "float64") -> NdFrame:
    if start * stop <= 0:
        raise ValueError("both ends need one sign and neither may be 0")
    sign = -1.0 if start < 0 else 1.0
    out = logspace(spark, math.log10(abs(start)), math.log10(abs(stop)), num, endpoint)
    return out.map(lambda v: cast(sign * v, "float64", dtype), dtype)


def arange_datetime(spark: SparkSession, start: int, stop: int, step: int = 1) -> NdFrame:
    """Ticks of any unit."""
    n = max(0, -((start - stop) // step))
    return NdFrame(spark.range(n).select(F.col("id").alias("i0"), (F.lit(start) + F.col("id") * step).alias("v")), (n,), "datetime64")


def eye(spark: SparkSession, n: int, m: int | None = None, k: int = 0, dtype: str = "float64") -> NdFrame:
    return from_rule(spark, (n, m or n), lambda i, j: F.when(j - i == k, 1.0).otherwise(0.0), dtype)


def identity(spark: SparkSession, n: int, dtype: str = "float64") -> NdFrame:
    return eye(spark, n, dtype=dtype)


def tri(spark: SparkSession, n: int, m: int | None = None, k: int = 0, dtype: str = "float64") -> NdFrame:
    return from_rule(spark, (n, m or n), lambda i, j: F.when(j <= i + k, 1.0).otherwise(0.0), dtype)


def diag(a: NdFrame, k: int = 0) -> NdFrame:
    """A vector as a matrix with it on the k-th diagonal; of a matrix that diagonal."""
    if a.ndim == 2:
        from ..operators.indexing import diagonal

        return diagonal(a, k)
    n, size = a.shape[0], a.shape[0] + abs(k)
    grid = cells(a.df.sparkSession, (size, size))
    own = a.df.select((F.col("i0") + max(0, -k)).alias("i0"), (F.col("i0") + max(0, k)).alias("i1"), "v")
    return NdFrame(grid.join(own, ["i0", "i1"], "left").select("i0", "i1", F.coalesce("v", F.lit(0).cast(own.schema["v"].dataType)).alias("v")), (size, size), a.dtype) if n else zeros(a.df.sparkSession, (size, size), a.dtype)


def diagflat(a: NdFrame, k: int = 0) -> NdFrame:
    return diag(NdFrame(a.df.select(a.flat().alias("i0"), "v"), (a.size,), a.dtype), k)


def vander(x: NdFrame, n: int | None = None, increasing: bool = False) -> NdFrame:
    n = x.shape[0] if n is None else n
    power = F.col("i1") if increasing else n - 1 - F.col("i1")
    rows = x.df.select("i0", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("i1"), F.col("v").cast("double").alias("x"))
    return NdFrame(rows.select("i0", "i1", F.pow("x", power).alias("v")), (x.shape[0], n))


def indices(spark: SparkSession, shape: Sequence[int]) -> NdFrame:
    """Coordinates along a first axis of their own."""
    k = len(shape)
    df = cells(spark, shape).select(*(F.col(f"i{j}").alias(f"i{j + 1}") for j in range(k)), F.posexplode(F.array(*(F.col(f"i{j}") for j in range(k)))).alias("i0", "v"))
    return NdFrame(df.select(F.col("i0").cast("long").alias("i0"), *(f"i{j + 1}" for j in range(k)), "v"), (k, *shape), "int64")


def _steps(start: Sequence[int], stop: Sequence[int], step: Sequence[int]) -> list[int]:
    return [max(0, math.ceil((b - a) / s)) for a, b, s in zip(start, stop, step, strict=True)]


def mgrid(spark: SparkSession, start: Sequence[int], stop: Sequence[int], step: Sequence[int]) -> list[NdFrame]:
    shape = _steps(start, stop, step)
    return [from_rule(spark, shape, lambda *i, k=k: (i[k] * step[k] + start[k]).cast("double")) for k in range(len(shape))]


def ogrid(spark: SparkSession, start: Sequence[int], stop: Sequence[int], step: Sequence[int]) -> list[NdFrame]:
    sizes = _steps(start, stop, step)
    return [from_rule(spark, [n if j == k else 1 for j, n in enumerate(sizes)], lambda *i, k=k: (i[k] * step[k] + start[k]).cast("double")) for k in range(len(sizes))]


def meshgrid(*arrays: NdFrame, sparse: bool = False, indexing: str = "xy") -> list[NdFrame]:
    """Coordinate matrices; each is its vector spread over the other axes."""
    from ..operators.shape import broadcast_to

    order = list(range(len(arrays)))
    if indexing == "xy" and len(arrays) > 1:
        order[0], order[1] = 1, 0
    shape = [0] * len(arrays)
    for a, k in zip(arrays, order, strict=True):
        shape[k] = a.shape[0]
    out = []
    for a, k in zip(arrays, order, strict=True):
        own = [F.col("i0").alias(f"i{j}") if j == k else F.lit(0).cast("long").alias(f"i{j}") for j in range(len(arrays))]
        thin = NdFrame(a.df.select(*own, "v"), [n if j == k else 1 for j, n in enumerate(shape)], a.dtype)
        out.append(thin if sparse else broadcast_to(thin, shape))
    return out


def triu_indices(spark: SparkSession, n: int, k: int = 0, m: int | None = None) -> DataFrame:
    return cells(spark, (n, m or n)).where(F.col("i1") >= F.col("i0") + k)


def tril_indices(spark: SparkSession, n: int, k: int = 0, m: int | None = None) -> DataFrame:
    return cells(spark, (n, m or n)).where(F.col("i1") <= F.col("i0") + k)


def _window(spark: SparkSession, m: int, rule: Callable[[Column], Column]) -> NdFrame:
    return from_rule(spark, (max(0, m),), (lambda i: F.lit(1.0)) if m == 1 else rule)


def bartlett(spark: SparkSession, m: int) -> NdFrame:
    return _window(spark, m, lambda i: 1 - F.abs(2 * i / (m - 1) - 1))


def _cosines(m: int, *weights: float) -> Callable[[Column], Column]:
    def rule(i: Column) -> Column:
        out = F.lit(weights[0])
        for k, w in enumerate(weights[1:], 1):
            out = out + w * F.cos(2 * math.pi * k * i / (m - 1))
        return out

    return rule


def blackman(spark: SparkSession, m: int) -> NdFrame:
    return _window(spark, m, _cosines(m, 0.42, -0.5, 0.08))


def hamming(spark: SparkSession, m: int) -> NdFrame:
    return _window(spark, m, _cosines(m, 0.54, -0.46))


def hanning(spark: SparkSession, m: int) -> NdFrame:
    return _window(spark, m, _cosines(m, 0.5, -0.5))


def kaiser(spark: SparkSession, m: int, beta: float) -> NdFrame:
    from ..functions.special import i0_series

    return _window(spark, m, lambda i: i0_series(beta * F.sqrt(1 - F.pow(2 * i / (m - 1) - 1, 2))) / i0_series(F.lit(float(beta))))


def fftfreq(spark: SparkSession, n: int, d: float = 1.0) -> NdFrame:
    return from_rule(spark, (n,), lambda i: F.when(i < (n + 1) // 2, i).otherwise(i - n) / (n * d))


def rfftfreq(spark: SparkSession, n: int, d: float = 1.0) -> NdFrame:
    return from_rule(spark, (n // 2 + 1,), lambda i: i / (n * d))


def chebpts1(spark: SparkSession, n: int) -> NdFrame:
    return from_rule(spark, (n,), lambda i: F.sin(math.pi / 2 * (2 * i - n + 1) / n))


def chebpts2(spark: SparkSession, n: int) -> NdFrame:
    if n < 2:
        raise ValueError("at least two points are needed")
    return from_rule(spark, (n,), lambda i: -F.cos(math.pi * i / (n - 1)))


def tile(a: NdFrame, reps: Sequence[int]) -> NdFrame:
    """The whole array repeated along each axis; missing axes are added in front."""
    k = max(a.ndim, len(reps))
    reps, shape = (1,) * (k - len(reps)) + tuple(reps), (1,) * (k - a.ndim) + a.shape
    df = a.df.select(*(F.lit(0).cast("long").alias(f"i{j}") for j in range(k - a.ndim)), *(F.col(f"i{j}").alias(f"i{j + k - a.ndim}") for j in range(a.ndim)), "v")
    for j, (r, n) in enumerate(zip(reps, shape, strict=True)):
        if r != 1:
            df = df.withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(r - 1)) if r else F.array().cast("array<int>"))).withColumn(f"i{j}", F.col(f"i{j}") + F.col("__r") * n).drop("__r")
    return NdFrame(df, [r * n for r, n in zip(reps, shape, strict=True)], a.dtype)


def repeat(a: NdFrame, repeats: int, axis: int | None = None) -> NdFrame:
    if axis is None:
        a, axis = NdFrame(a.df.select(a.flat().alias("i0"), "v"), (a.size,), a.dtype), 0
    axis = a.axis(axis)
    name = f"i{axis}"
    df = a.df.withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)) if repeats else F.array().cast("array<int>"))).withColumn(name, F.col(name) * repeats + F.col("__r")).drop("__r")
    return NdFrame(df, [n * repeats if j == axis else n for j, n in enumerate(a.shape)], a.dtype)


def unravel(flat: Column, shape: Sequence[int]) -> list[Column]:
    return [(F.floor(flat / step) if step != 1 else flat) % n for n, step in zip(shape, strides(shape), strict=True)]


