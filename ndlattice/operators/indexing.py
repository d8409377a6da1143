"""Gathers, scatters, masks and slices over frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import NdFrame
from ..functions import elementwise as E
from ..meta import SPARK
from ..plans.ordered import positions
from .joining import concatenate
from .shape import ravel, split


def _flat(a: NdFrame, axis: int | None) -> tuple[NdFrame, int]:
    return (ravel(a), 0) if axis is None else (a, a.axis(axis))


def _resized(a: NdFrame, df: DataFrame, axis: int, n: int) -> NdFrame:
    return NdFrame(df, [n if k == axis else m for k, m in enumerate(a.shape)], a.dtype)


def array_slice(a: NdFrame, slices: Sequence[slice]) -> NdFrame:
    """start, stop, step for each axis; negative steps run backwards."""
    keep, index, shape = F.lit(True), [], []
    for k, n in enumerate(a.shape):
        start, stop, step = slices[k].indices(n) if k < len(slices) else (0, n, 1)
        size, i = len(range(start, stop, step)), F.col(f"i{k}")
        low, high = min(start, start + (size - 1) * step), max(start, start + (size - 1) * step)
        keep = keep & (F.lit(size > 0) & (i >= low) & (i <= high) & ((i - start) % abs(step) == 0))
        index.append(F.call_function("div", i - start, F.lit(step)).alias(f"i{k}"))
        shape.append(size)
    return NdFrame(a.df.where(keep).select(*index, "v"), shape, a.dtype)


def take(a: NdFrame, indices: Sequence[int], axis: int | None = None) -> NdFrame:
    """The given places along an axis; negative ones count from the end."""
    a, axis = _flat(a, axis)
    n = a.shape[axis]
    if any(not -n <= i < n for i in indices):
        raise IndexError("index out of bounds")
    spark = a.df.sparkSession
    wanted = spark.createDataFrame([(j, int(i) % n) for j, i in enumerate(indices)], "__to long, __from long")
    df = a.df.join(F.broadcast(wanted), F.col(f"i{axis}") == F.col("__from")).withColumn(f"i{axis}", F.col("__to")).drop("__to", "__from")
    return _resized(a, df, axis, len(indices))


def take_frame(a: NdFrame, indices: NdFrame) -> NdFrame:
    """Gather from a vector by a frame of places of any size: a join."""
    n = a.size
    wanted = indices.df.select(*indices.idx, F.pmod("v", F.lit(n)).alias("__from"))
    return NdFrame(wanted.join(ravel(a).df.select(F.col("i0").alias("__from"), F.col("v").alias("__v")), "__from").select(*indices.idx, F.col("__v").alias("v")), indices.shape, a.dtype)


def take_along_axis(a: NdFrame, indices: NdFrame, axis: int) -> NdFrame:
    axis = a.axis(axis)
    name = f"i{axis}"
    rest = [n for n in a.idx if n != name]
    wanted = indices.df.select(*indices.idx, F.pmod("v", F.lit(a.shape[axis])).alias("__from"))
    source = a.df.select(*rest, F.col(name).alias("__from"), F.col("v").alias("__v"))
    return NdFrame(wanted.join(source, [*rest, "__from"]).select(*indices.idx, F.col("__v").alias("v")), indices.shape, a.dtype)


def compress(a: NdFrame, mask: Sequence[bool], axis: int | None = None) -> NdFrame:
    return take(a, [i for i, keep in enumerate(mask) if keep], axis)


def extract(a: NdFrame, condition: Column) -> NdFrame:
    """Cells where a condition over the index columns and v holds, as a vector in row-major order."""
    kept = positions(a.df.where(condition).select(a.flat().alias("__f"), "v"), F.col("__f")).select("i0", "v")
    return NdFrame(kept, (kept.count(),), a.dtype)


def boolean_index(a: NdFrame, mask: NdFrame) -> NdFrame:
    kept = a.df.join(mask.df.where("v").drop("v"), a.idx, "left_semi")
    return extract(NdFrame(kept, a.shape, a.dtype), F.lit(True))


def nonzero(a: NdFrame) -> DataFrame:
    """Index columns of the cells that are not 0."""
    return a.df.where(E.truth(F.col("v"))).select(*a.idx)


argwhere = where_indices = nonzero


def flatnonzero(a: NdFrame) -> DataFrame:
    return a.df.where(E.truth(F.col("v"))).select(a.flat().alias("i0"))


def delete(a: NdFrame, places: Sequence[int], axis: int | None = None) -> NdFrame:
    a, axis = _flat(a, axis)
    n = a.shape[axis]
    if any(not -n <= i < n for i in places):
        raise IndexError("index out of bounds")
    gone = {i % n for i in places}
    return take(a, [i for i in range(n) if i not in gone], axis) if n <= 100_000 else _delete_long(a, sorted(gone), axis)


def _delete_long(a: NdFrame, gone: list[int], axis: int) -> NdFrame:
    """Long axes: every place moves down by the deleted ones before it."""
    from .sorting import place_in

    name = f"i{axis}"
    df = a.df.where(~F.col(name).isin(gone)).withColumn(name, F.col(name) - place_in(F.col(name), gone))
    return _resized(a, df, axis, a.shape[axis] - len(gone))


def insert(a: NdFrame, place: int, values: NdFrame, axis: int | None = None) -> NdFrame:
    """Values before a place."""
    a, axis = _flat(a, axis)
    n = a.shape[axis]
    if not -n <= place <= n:
        raise IndexError(place)
    before, after = split(a, [place + n if place < 0 else place], axis)
    return concatenate([before, values, after], axis)


def put(a: NdFrame, places: Sequence[int], values: Sequence[float], mode: str = "raise") -> NdFrame:
    """Scatter by flat place; values are cycled, the last write to a place stays."""
    n, last = a.size, {}
    for k, i in enumerate(places):
        if mode == "raise" and not -n <= i < n:
            raise IndexError(i)
        last[min(max(i, 0), n - 1) if mode == "clip" else i % n] = values[k % len(values)]
    return _written(a, last)


def _written(a: NdFrame, new: dict[int, float]) -> NdFrame:
    if not new:
        return a
    rows = a.df.sparkSession.createDataFrame([(int(i), float(v)) for i, v in new.items()], "__f long, __v double")
    df = a.df.withColumn("__f", a.flat()).join(F.broadcast(rows), "__f", "left")
    return NdFrame(df.select(*a.idx, F.coalesce(F.col("__v").cast(SPARK[a.dtype]), F.col("v")).alias("v")), a.shape, a.dtype)


def put_along_axis(a: NdFrame, indices: NdFrame, values: NdFrame, axis: int) -> NdFrame:
    """Scatter along an axis; of several writes to one cell that with the greatest place stays."""
    axis = a.axis(axis)
    name = f"i{axis}"
    rest = [n for n in a.idx if n != name]
    writes = indices.df.join(values.df.withColumnRenamed("v", "__v"), a.idx).groupBy(*rest, F.pmod("v", F.lit(a.shape[axis])).alias(name)).agg(F.max_by("__v", name).alias("__v"))
    return NdFrame(a.df.join(writes, a.idx, "left").select(*a.idx, F.coalesce("__v", "v").alias("v")), a.shape, a.dtype)


def putmask(a: NdFrame, condition: Column, values: Sequence[float]) -> NdFrame:
    """Where the condition holds, the value of the cell's own flat place, cycled."""
    cycle = F.array(*(F.lit(float(v)) for v in values))
    return a.map_where(condition, F.get(cycle, (a.flat() % len(values)).cast("int")))


def place(a: NdFrame, condition: Column, values: Sequence[float]) -> NdFrame:
    """Where the condition holds, the values one after another, cycled."""
    cells = a.df.withColumn("__f", a.flat())
    hits = positions(cells.where(condition).select("__f"), F.col("__f"), name="__n")
    cycle = F.array(*(F.lit(float(v)) for v in values))
    new = F.get(cycle, (F.col("__n") % len(values)).cast("int")).cast(SPARK[a.dtype])
    return NdFrame(cells.join(hits, "__f", "left").select(*a.idx, F.coalesce(new, F.col("v")).alias("v")), a.shape, a.dtype)


def fill_diagonal(a: NdFrame, value: float) -> NdFrame:
    same = F.lit(True)
    for one, two in zip(a.idx[:-1], a.idx[1:], strict=True):
        same = same & (F.col(one) == F.col(two))
    return a.map_where(same, F.lit(value))


def copyto(target: NdFrame, source: NdFrame, casting: str = "same_kind") -> NdFrame:
    from .shape import broadcast_to

    return broadcast_to(source.astype(target.dtype, casting), target.shape)


def trim_zeros(a: NdFrame, trim: str = "fb") -> NdFrame:
    low, high = a.df.where(E.truth(F.col("v"))).agg(F.min("i0"), F.max("i0")).first()
    if low is None:
        low, high = 0, -1
    start, stop = (low if "f" in trim else 0), (high + 1 if "b" in trim else a.shape[0])
    stop = max(start, stop) if high >= 0 else start
    return array_slice(a, [slice(start, stop)])


def unravel_index(flat: Column, shape: Sequence[int]) -> list[Column]:
    from ..sources.creation import unravel

    size = 1
    for n in shape:
        size *= n
    checked = F.when((flat >= 0) & (flat < size), flat).otherwise(F.raise_error(F.lit("index out of bounds")).cast("long"))
    return [c.cast("long") for c in unravel(checked, shape)]


def ravel_multi_index(index: Sequence[Column], shape: Sequence[int]) -> Column:
    from ..meta import strides

    out = F.lit(0).cast("long")
    for i, n, step in zip(index, shape, strides(shape), strict=True):
        out = out + F.when((i >= 0) & (i < n), i).otherwise(F.raise_error(F.lit("index out of bounds")).cast("long")) * step
    return out


def diagonal(a: NdFrame, offset: int = 0, one: int = 0, two: int = 1) -> NdFrame:
    """The diagonal of two axes as a last axis."""
    one, two = a.axis(one), a.axis(two)
    rest = [k for k in range(a.ndim) if k not in (one, two)]
    i, j = F.col(f"i{one}"), F.col(f"i{two}")
    n = max(0, min(a.shape[one] + min(offset, 0), a.shape[two] - max(offset, 0)))
    df = a.df.where(j - i == offset).select(*(F.col(f"i{k}").alias(f"i{m}") for m, k in enumerate(rest)), (i + min(offset, 0)).alias(f"i{len(rest)}"), "v")
    return NdFrame(df, [*(a.shape[k] for k in rest), n], a.dtype)


def trace(a: NdFrame, offset: int = 0, one: int = 0, two: int = 1) -> NdFrame:
    from .reductions import sum as total

    return total(diagonal(a, offset, one, two), -1)


def as_strided(a: NdFrame, shape: Sequence[int], steps: Sequence[int]) -> NdFrame:
    """Steps in cells over the flattened array: every new cell looks its source up."""
    from ..sources.creation import cells

    at = F.lit(0).cast("long")
    for k, step in enumerate(steps):
        at = at + F.col(f"i{k}") * step
    names = [f"i{k}" for k in range(len(shape))]
    grid = cells(a.df.sparkSession, shape).withColumn("__f", at)
    return NdFrame(grid.join(ravel(a).df.select(F.col("i0").alias("__f"), "v"), "__f").select(*names, "v"), shape, a.dtype)


def iterate(a: NdFrame):
    """(index, value) in row-major order, a partition at a time on the driver."""
    for *index, v in a.df.orderBy(*a.idx).select(*a.idx, "v").toLocalIterator():
        yield tuple(index), v


ndenumerate = iterate


def packbits(a: NdFrame, axis: int | None = None, order: str = "big") -> NdFrame:
    a, axis = _flat(a, axis)
    name = f"i{axis}"
    at = F.col(name) % 8
    bit = F.when(E.truth(F.col("v")), F.call_function("shiftleft", F.lit(1), (7 - at if order == "big" else at).cast("int"))).otherwise(0)
    rest = [F.call_function("div", F.col(n), F.lit(8)).alias(n) if n == name else F.col(n) for n in a.idx]
    return NdFrame(a.df.select(*rest, bit.alias("b")).groupBy(*a.idx).agg(F.sum("b").cast("short").alias("v")), [-(-n // 8) if k == axis else n for k, n in enumerate(a.shape)], "uint8")


def unpackbits(a: NdFrame, axis: int | None = None, count: int | None = None, order: str = "big") -> NdFrame:
    a, axis = _flat(a, axis)
    name, n = f"i{axis}", 8 * a.shape[axis] if count is None else count
    rows = a.df.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(7))))
    bit = F.getbit(F.col("v").cast("int"), 7 - F.col("__b") if order == "big" else F.col("__b")).cast("short")
    rows = rows.select(*((F.col(name) * 8 + F.col("__b")).alias(name) if c == name else c for c in a.idx), bit.alias("v")).where(F.col(name) < n)
    return NdFrame(rows, [n if k == axis else m for k, m in enumerate(a.shape)], "uint8")
