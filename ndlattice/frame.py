"""NdFrame: an n-dimensional array as a table of cells (i0, ..., ik, v) with its shape and type."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .meta import MAX_RANK, SPARK, NdMeta, can_cast, checked_axis, of_spark, strides
from .plans.ordered import positions


class NdFrame:
    """Cells are dense: one row for every index.  Frames never change; writers return new ones."""

    def __init__(self, df: DataFrame, shape: Sequence[int], dtype: str = "float64"):
        if len(shape) > MAX_RANK:
            raise ValueError("too many dimensions")
        self.df, self.meta = df, NdMeta(tuple(int(n) for n in shape), dtype)

    shape = property(lambda self: self.meta.shape)
    ndim = property(lambda self: self.meta.ndim)
    size = property(lambda self: self.meta.size)
    dtype = property(lambda self: self.meta.dtype)
    nbytes = property(lambda self: self.meta.nbytes)
    strides = property(lambda self: self.meta.strides)

    @property
    def idx(self) -> list[str]:
        return [f"i{k}" for k in range(self.ndim)]

    def flat(self) -> Column:
        """Place in row-major order."""
        out = F.lit(0).cast("long")
        for name, step in zip(self.idx, self.strides, strict=True):
            out = out + F.col(name) * step
        return out

    def where_index(self, index: Sequence[int]) -> Column:
        """Condition for one cell; negative places count from the end."""
        if len(index) != self.ndim:
            raise IndexError("one place for each axis is needed")
        out = F.lit(True)
        for name, i, n in zip(self.idx, index, self.shape, strict=True):
            if not -n <= i < n:
                raise IndexError(i)
            out = out & (F.col(name) == i % n)
        return out

    def map(self, f, dtype: str | None = None) -> NdFrame:
        """Cell by cell; f takes and gives a Column."""
        return NdFrame(self.df.select(*self.idx, f(F.col("v")).alias("v")), self.shape, dtype or self.dtype)

    def indexed(self, index: dict[str, Column], shape: Sequence[int], where: Column | None = None) -> NdFrame:
        """The same cells under new index columns."""
        df = self.df if where is None else self.df.where(where)
        return NdFrame(df.select(*(F.col(c).alias(n) if isinstance(c, str) else c.cast("long").alias(n) for n, c in index.items()), "v"), shape, self.dtype)

    def axis(self, axis: int) -> int:
        return checked_axis(axis, self.ndim)

    # --- scalars and host values --------------------------------------------------------------

    def item(self, *index: int):
        """One value by its index, or by its flat place."""
        if len(index) == 1 and self.ndim != 1:
            i, found = index[0] % self.size, []
            for step in self.strides:
                found.append(i // step)
                i %= step
            index = tuple(found)
        return self.df.where(self.where_index(index)).select("v").first()[0]

    def with_item(self, index: Sequence[int], value) -> NdFrame:
        return self.map_where(self.where_index(index), F.lit(value))

    def map_where(self, condition: Column, value: Column) -> NdFrame:
        new = F.when(condition, value.cast(SPARK[self.dtype])).otherwise(F.col("v"))
        return NdFrame(self.df.select(*self.idx, new.alias("v")), self.shape, self.dtype)

    def to_numpy(self) -> np.ndarray:
        """All cells on the driver: for small results and tests."""
        kind = "complex128" if self.dtype.startswith("complex") else None if self.dtype in ("str", "bytes") else self.dtype.replace("64", "64", 1)
        out = np.empty(self.shape, object if kind is None or self.dtype in ("datetime64", "timedelta64") else kind)
        for *index, v in self.df.select(*self.idx, "v").collect():
            out[tuple(index)] = complex(v["re"], v["im"]) if self.dtype.startswith("complex") else v
        return out

    def tolist(self) -> list:
        return self.to_numpy().ravel().tolist()

    def tobytes(self) -> bytes:
        return self.to_numpy().tobytes()

    def astype(self, dtype: str, casting: str = "unsafe") -> NdFrame:
        if not can_cast(self.dtype, dtype, casting):
            raise TypeError(f"cannot cast {self.dtype} to {dtype} by {casting}")
        return self.map(lambda v: cast(v, self.dtype, dtype), dtype)

    def broadcastable(self, shape: Sequence[int]) -> bool:
        from .meta import can_broadcast

        return can_broadcast(self.shape, shape)


#: Cells up to which a frame may be broadcast.
BROADCAST_CELLS = 100_000


def matched(left: DataFrame, right: DataFrame, on: Sequence[str], left_size: int, right_size: int) -> DataFrame:
    """Inner join of cells on their indices; a side may only be broadcast if its known size allows it.

    Spark takes an exploded range or array for as large as what it is made from, and would send millions of cells through the driver.
    """
    if min(left_size, right_size) > BROADCAST_CELLS:
        return left.join(right.hint("merge"), list(on))
    if left_size > BROADCAST_CELLS:
        return left.join(F.broadcast(right), list(on))
    return (F.broadcast(left) if right_size > BROADCAST_CELLS else left).join(right, list(on))


def cast(v: Column, source: str, target: str) -> Column:
    """A value in another type; integers wrap, complex values lose their imaginary part."""
    from .functions.elementwise import cast_wrapping

    if source.startswith("complex") and not target.startswith("complex"):
        v, source = v["re"], "float64"
    if target.startswith("complex"):
        return v if source.startswith("complex") else F.struct(v.cast("double").alias("re"), F.lit(0.0).alias("im"))
    if target == "bool":
        return v.cast("double") != 0
    whole = v.cast("long") if source in ("float16", "float32", "float64", "bool") else v
    if target in ("int8", "int16", "int32"):
        return cast_wrapping(whole, int(target[3:])).cast(SPARK[target])
    if target in ("uint8", "uint16", "uint32"):
        return F.pmod(whole.cast("long"), F.lit(1 << int(target[4:]))).cast(SPARK[target])
    return v.cast(SPARK[target])


def from_numpy(spark: SparkSession, a, dtype: str | None = None) -> NdFrame:
    """An array of the driver as a frame: for literals and tests."""
    a = np.asarray(a, dtype)
    name = {"U": "str", "S": "bytes", "M": "datetime64", "m": "timedelta64"}.get(a.dtype.kind, a.dtype.name)
    def plain(x):
        return {"re": float(x.real), "im": float(x.imag)} if name.startswith("complex") else x
    rows = [(*map(int, i), plain(a[i].item() if hasattr(a[i], "item") else a[i])) for i in np.ndindex(a.shape)]
    kind = SPARK[name].simpleString()
    return NdFrame(spark.createDataFrame(rows, ", ".join([*(f"i{k} long" for k in range(a.ndim)), f"v {kind}"])), a.shape, name)


def from_column(df: DataFrame, value: Column, *order: Column, size: int | None = None) -> NdFrame:
    """A column as a 1-D array in an order; ties need a further key to be repeatable."""
    cells = positions(df.select(value.alias("v"), *(o.alias(f"__o{j}") for j, o in enumerate(order))), *(F.col(f"__o{j}") for j in range(len(order)))).select("i0", "v")
    return NdFrame(cells, (cells.count() if size is None else size,), of_spark(cells.schema["v"].dataType))


def from_columns(df: DataFrame, columns: Sequence[str], *order: Column) -> NdFrame:
    """Numeric columns as a 2-D array, one row for each row of the table."""
    cells = positions(df.select(*columns, *(o.alias(f"__o{j}") for j, o in enumerate(order))), *(F.col(f"__o{j}") for j in range(len(order))))
    out = cells.select("i0", F.posexplode(F.array(*(F.col(c).cast("double") for c in columns))).alias("i1", "v"))
    return NdFrame(out.select("i0", F.col("i1").cast("long").alias("i1"), "v"), (cells.count(), len(columns)))


def from_arrays(df: DataFrame, row: str, array: str, width: int) -> NdFrame:
    """An array column as a 2-D array; row holds the places from 0."""
    return NdFrame(df.select(F.col(row).cast("long").alias("i0"), F.posexplode(array).alias("i1", "v")).select("i0", F.col("i1").cast("long").alias("i1"), F.col("v").cast("double").alias("v")), (df.count(), width))
