"""Operators along an order: running totals, differences, gradients, convolution.

Over frames they run along an axis, one window a line.  The ``*_table`` forms run over one whole
ordered table in ranges, so that no task holds more than its share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import NdFrame
from ..functions import elementwise as E
from ..meta import SPARK, accumulator
from ..plans.ordered import positions, running
from .shape import ravel


def _line(a: NdFrame, axis: int):
    return Window.partitionBy(*(n for k, n in enumerate(a.idx) if k != axis)).orderBy(f"i{axis}")


def _so_far(a: NdFrame, axis: int):
    return _line(a, axis).rowsBetween(Window.unboundedPreceding, 0)


def _flat(a: NdFrame, axis: int | None) -> tuple[NdFrame, int]:
    return (ravel(a), 0) if axis is None else (a, a.axis(axis))


def cumsum(a: NdFrame, axis: int | None = None) -> NdFrame:
    a, axis = _flat(a, axis)
    to = accumulator(a.dtype)
    if a.ndim == 1:
        return NdFrame(running(a.df, F.col("v"), F.col("i0")).select("i0", F.col("running").alias("v")), a.shape, to)
    return NdFrame(a.df.withColumn("v", F.sum("v").over(_so_far(a, axis))), a.shape, to)


def cumprod(a: NdFrame, axis: int | None = None) -> NdFrame:
    a, axis = _flat(a, axis)
    return NdFrame(a.df.withColumn("v", F.product("v").over(_so_far(a, axis))), a.shape, "float64")


def nancumsum(a: NdFrame, axis: int | None = None) -> NdFrame:
    return cumsum(a.map(lambda v: F.nanvl(v.cast("double"), F.lit(0.0)), "float64"), axis)


def nancumprod(a: NdFrame, axis: int | None = None) -> NdFrame:
    return cumprod(a.map(lambda v: F.nanvl(v.cast("double"), F.lit(1.0)), "float64"), axis)


def diff(a: NdFrame, n: int = 1, axis: int = -1) -> NdFrame:
    axis = a.axis(axis)
    name = f"i{axis}"
    for _ in range(n):
        before = F.lag("v").over(_line(a, axis))
        value = F.col("v") != before if a.dtype == "bool" else F.col("v") - before
        df = a.df.withColumn("v", value).where(F.col(name) > 0).withColumn(name, F.col(name) - 1)
        a = NdFrame(df, [max(0, m - 1) if k == axis else m for k, m in enumerate(a.shape)], a.dtype)
    return a


def ediff1d(a: NdFrame, to_begin: Sequence[float] = (), to_end: Sequence[float] = ()) -> NdFrame:
    """Differences of the flattened array between given ends."""
    from ..frame import from_numpy
    from .joining import concatenate

    spark = a.df.sparkSession
    parts = [from_numpy(spark, list(map(float, x))) if not isinstance(x, NdFrame) else x for x in (to_begin, diff(ravel(a)), to_end) if isinstance(x, NdFrame) or len(x)]
    return concatenate(parts)


def gradient(a: NdFrame, axis: int = -1) -> NdFrame:
    """Half the difference of the neighbours, whole differences at the ends."""
    axis = a.axis(axis)
    if a.shape[axis] < 2:
        raise ValueError("a gradient needs two places")
    line, v = _line(a, axis), F.col("v").cast("double")
    before, after = F.lag(v).over(line), F.lead(v).over(line)
    return NdFrame(a.df.withColumn("v", F.when(before.isNull(), after - v).when(after.isNull(), v - before).otherwise((after - before) / 2)), a.shape)


def trapz(y: NdFrame, x: NdFrame | None = None, dx: float = 1.0, axis: int = -1) -> NdFrame:
    from .reductions import reduce
    from .shape import combine

    axis = y.axis(axis)
    pairs = combine(y, x, lambda a, b: F.struct(a.cast("double").alias("y"), b.cast("double").alias("x"))) if x is not None else y.map(lambda v: F.struct(v.cast("double").alias("y"), (F.col(f"i{axis}") * dx).alias("x")))
    before = F.lag("v").over(_line(pairs, axis))
    area = (F.col("v.y") + before["y"]) / 2 * (F.col("v.x") - before["x"])
    return reduce(NdFrame(pairs.df.withColumn("v", F.coalesce(area, F.lit(0.0))), pairs.shape), axis, F.sum)


def unwrap(a: NdFrame, discont: float = math.pi) -> NdFrame:
    """Jumps beyond half a turn along the last axis are taken out by whole turns."""
    axis, turn = a.ndim - 1, 2 * math.pi
    limit = max(discont, math.pi)
    step = F.col("v") - F.lag("v").over(_line(a, axis))
    wrapped = E.mod(step + math.pi, turn) - math.pi
    wrapped = F.when((wrapped == -math.pi) & (step > 0), math.pi).otherwise(wrapped)
    fixed = F.when(F.abs(step) < limit, 0.0).otherwise(wrapped - step)
    df = a.df.withColumn("__fix", F.coalesce(fixed, F.lit(0.0)))
    return NdFrame(df.withColumn("v", F.col("v") + F.sum("__fix").over(_so_far(a, axis))).drop("__fix"), a.shape)


#: Cells in one block of a convolution.
BLOCK = 8192


def convolve(a: NdFrame, kernel: NdFrame, mode: str = "full") -> NdFrame:
    """Both arrays are cut into blocks; every pair of blocks is convolved by itself and the overlaps add up.

    A kernel of one block is broadcast, its size being known; a longer one is joined block by block.
    """
    if kernel.size > a.size:
        a, kernel = kernel, a
    n, m = a.size, kernel.size
    taps = _blocks(kernel, "kernel_block", "taps")
    rows = _blocks(a, "block", "cells").withColumn("kernel_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((m - 1) // BLOCK).cast("long"))))
    rows = rows.join(F.broadcast(taps) if m <= BLOCK else taps, "kernel_block")
    low, size = {"full": (0, n + m - 1), "same": ((m - 1) // 2, n), "valid": (m - 1, n - m + 1)}[mode]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x, y in zip((batch.column(0).to_numpy() + batch.column(1).to_numpy()) * BLOCK - low, batch.column(2), batch.column(3), strict=True):
                v = np.convolve(x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False))
                i = np.arange(at, at + len(v))
                inside = (i >= 0) & (i < size)
                yield pa.RecordBatch.from_arrays([pa.array(i[inside]), pa.array(v[inside])], names=["i0", "v"])

    parts = rows.select("block", "kernel_block", "cells", "taps").mapInArrow(work, "i0 long, v double")
    return NdFrame(parts.groupBy("i0").agg(F.sum("v").alias("v")).select("i0", F.col("v").cast(SPARK[a.dtype])), (size,), a.dtype)


def _blocks(a: NdFrame, number: str, name: str) -> DataFrame:
    cells = F.array_sort(F.collect_list(F.struct("i0", F.col("v").cast("double").alias("v"))))
    return a.df.groupBy(F.floor(F.col("i0") / BLOCK).alias(number)).agg(F.transform(cells, lambda c: c["v"]).alias(name))


def correlate(a: NdFrame, kernel: NdFrame, mode: str = "valid") -> NdFrame:
    from .shape import flip

    if kernel.size > a.size:
        return flip(correlate(kernel, a, mode))
    return convolve(a, flip(kernel), mode)


def softmax(a: NdFrame, axis: int = -1) -> NdFrame:
    axis = a.axis(axis)
    line = Window.partitionBy(*(n for k, n in enumerate(a.idx) if k != axis))
    e = F.exp(F.col("v") - F.max("v").over(line))
    return NdFrame(a.df.withColumn("v", e).withColumn("v", F.col("v") / F.sum("v").over(line)), a.shape)


def log_softmax(a: NdFrame, axis: int = -1) -> NdFrame:
    axis = a.axis(axis)
    line = Window.partitionBy(*(n for k, n in enumerate(a.idx) if k != axis))
    df = a.df.withColumn("v", F.col("v") - F.max("v").over(line))
    return NdFrame(df.withColumn("v", F.col("v") - F.ln(F.sum(F.exp("v")).over(line))), a.shape)


def sliding_window_view(a: NdFrame, size: int, axis: int = -1) -> NdFrame:
    """A further last axis over the places of a window; each cell is sent to the windows it lies in."""
    axis = a.axis(axis)
    name, n = f"i{axis}", a.shape[axis]
    if not 0 < size <= n:
        raise ValueError("the window must fit the axis")
    spread = a.df.withColumn("__w", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))))
    rows = spread.withColumn(name, F.col(name) - F.col("__w")).where((F.col(name) >= 0) & (F.col(name) <= n - size))
    return NdFrame(rows.select(*a.idx, F.col("__w").alias(f"i{a.ndim}"), "v"), [*(n - size + 1 if k == axis else m for k, m in enumerate(a.shape)), size], a.dtype)


# --- over ordered tables ----------------------------------------------------------------------


def cumsum_table(df: DataFrame, value: Column, *order: Column, name: str = "running") -> DataFrame:
    return running(df, value, *order, name=name)


def diff_table(df: DataFrame, value: Column, *order: Column, name: str = "diff") -> DataFrame:
    """Difference to the row before, null for the first: rows meet their successor by position."""
    return _shifted(df, value, order, lambda v, before, after: v - before, name)


def gradient_table(df: DataFrame, value: Column, *order: Column, name: str = "gradient") -> DataFrame:
    return _shifted(df, value, order, lambda v, before, after: F.when(before.isNull(), after - v).when(after.isNull(), v - before).otherwise((after - before) / 2), name)


def _shifted(df: DataFrame, value: Column, order, f, name: str) -> DataFrame:
    """Blocks of consecutive rows, each with one borrowed row on either side."""
    block = 1 << 14
    rows = positions(df.withColumn("__v", value), *order, name="__row")
    own = F.floor(F.col("__row") / block)
    lent = rows.withColumn("__block", F.explode(F.array_distinct(F.array(own, F.floor((F.col("__row") - 1) / block), F.floor((F.col("__row") + 1) / block)))))
    line = Window.partitionBy("__block").orderBy("__row")
    out = lent.withColumn(name, f(F.col("__v"), F.lag("__v").over(line), F.lead("__v").over(line)))
    return out.where(F.col("__block") == own).drop("__row", "__block", "__v")
