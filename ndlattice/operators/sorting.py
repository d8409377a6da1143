"""Sorting, ranking and lookup in sorted arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import NdFrame
from ..plans.ordered import positions
from .shape import ravel


def _flat(a: NdFrame, axis: int | None) -> tuple[NdFrame, int]:
    return (ravel(a), 0) if axis is None else (a, a.axis(axis))


def _ranked(a: NdFrame, axis: int, *keys: Column) -> DataFrame:
    """Cells with their rank along the axis; a vector is ranked in ranges, lines by a window each."""
    if a.ndim == 1:
        return positions(a.df, *keys, F.col("i0"), name="__rank")
    line = Window.partitionBy(*(n for k, n in enumerate(a.idx) if k != axis)).orderBy(*keys, f"i{axis}")
    return a.df.withColumn("__rank", (F.row_number().over(line) - 1).cast("long"))


def sort(a: NdFrame, axis: int | None = -1) -> NdFrame:
    """Stable; NaN last."""
    a, axis = _flat(a, axis)
    name = f"i{axis}"
    return NdFrame(_ranked(a, axis, F.col("v")).withColumn(name, F.col("__rank")).drop("__rank"), a.shape, a.dtype)


def msort(a: NdFrame) -> NdFrame:
    return sort(a, 0)


def argsort(a: NdFrame, axis: int | None = -1) -> NdFrame:
    a, axis = _flat(a, axis)
    name = f"i{axis}"
    ranked = _ranked(a, axis, F.col("v"))
    return NdFrame(ranked.select(*(F.col("__rank").alias(n) if n == name else n for n in a.idx), F.col(name).alias("v")), a.shape, "int64")


def partition(a: NdFrame, kth: int | Sequence[int], axis: int | None = -1) -> NdFrame:
    """A whole sort: every kth place then holds what it must."""
    _checked(a, kth, axis)
    return sort(a, axis)


def argpartition(a: NdFrame, kth: int | Sequence[int], axis: int | None = -1) -> NdFrame:
    _checked(a, kth, axis)
    return argsort(a, axis)


def _checked(a: NdFrame, kth: int | Sequence[int], axis: int | None) -> None:
    n = a.size if axis is None else a.shape[a.axis(axis)]
    for k in [kth] if isinstance(kth, int) else kth:
        if not -n <= k < n:
            raise ValueError(f"kth {k} is out of bounds")


def lexsort(df: DataFrame, keys: Sequence[Column], place: Column) -> DataFrame:
    """i0, v: the places in the order of the keys, the last one first."""
    rows = df.select(*(k.alias(f"__k{j}") for j, k in enumerate(keys)), place.alias("v"))
    return positions(rows, *(F.col(f"__k{j}") for j in reversed(range(len(keys)))), F.col("v")).select("i0", "v")


def sort_complex(a: NdFrame) -> NdFrame:
    """Along the last axis by real, then imaginary part; the result is complex."""
    z = a.astype("complex128")
    name = f"i{a.ndim - 1}"
    ranked = _ranked(z, a.ndim - 1, F.isnan("v.re") | F.isnan("v.im"), F.col("v.re"), F.col("v.im"))
    return NdFrame(ranked.withColumn(name, F.col("__rank")).drop("__rank"), a.shape, "complex128")


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """A bounded report: every task keeps its k first rows."""
    return df.orderBy(*order).limit(k)


# --- lookup -----------------------------------------------------------------------------------


def searchsorted(values: DataFrame, value: Column, sorted_values: Sequence[float], side: str = "left", name: str = "place") -> DataFrame:
    """Places in a sorted list known to the driver."""
    return values.withColumn(name, place_in(value, sorted_values, side))


def place_in(value: Column, sorted_values: Sequence[float], side: str = "left") -> Column:
    """How many of the sorted values lie before the value; NaN comes last."""
    if side not in ("left", "right"):
        raise ValueError("side is left or right")
    v = value.cast("double")
    bins = F.array(*(F.lit(float(x)) for x in sorted_values)).cast("array<double>")
    return F.size(F.filter(bins, lambda b: b < v if side == "left" else b <= v)).cast("long")


def searchsorted_join(values: DataFrame, value: str, bins: DataFrame, bin_value: str, side: str = "left", name: str = "place") -> DataFrame:
    """Places in a sorted column of any size: both are ordered together and the bins before counted."""
    first = F.lit(0 if side == "right" else 1)
    both = bins.select(F.col(bin_value).cast("double").alias("__x"), first.alias("__turn"), F.lit(1).alias("__is_bin"), *(F.lit(None).cast(t).alias(c) for c, t in values.dtypes))
    both = both.unionByName(values.select(F.col(value).cast("double").alias("__x"), (1 - first).alias("__turn"), F.lit(0).alias("__is_bin"), *values.columns))
    from ..plans.ordered import running

    return running(both, F.col("__is_bin"), F.col("__x"), F.col("__turn"), name=name).where("__is_bin = 0").drop("__x", "__turn", "__is_bin")


def digitize(value: Column, bins: Sequence[float], right: bool = False) -> Column:
    """Bin of a value among bounds that rise or fall."""
    up = all(a <= b for a, b in zip(bins[:-1], bins[1:], strict=True))
    if not up and not all(a >= b for a, b in zip(bins[:-1], bins[1:], strict=True)):
        raise ValueError("bins must rise or fall")
    if up:
        return place_in(value, bins, "left" if right else "right")
    return F.lit(len(bins)).cast("long") - place_in(value, bins[::-1], "left" if right else "right")


def interp(value: Column, xp: Sequence[float], fp: Sequence[float], left: float | None = None, right: float | None = None) -> Column:
    """Linear between points known to the driver; NaN stays NaN."""
    if any(x != x for x in xp) or not xp:
        raise ValueError("points must be numbers")
    v, n = value.cast("double"), len(xp)
    x, f = (F.array(*(F.lit(float(y)) for y in ys)) for ys in (xp, fp))
    i = F.greatest(F.lit(1), F.least(F.lit(n - 1), place_in(v, xp, "right").cast("int")))
    low, high = F.get(x, i - 1), F.get(x, i)
    inside = F.get(f, i - 1) + (F.get(f, i) - F.get(f, i - 1)) * F.try_divide(v - low, high - low)
    ends = F.when(F.isnan(v), v).when(v < xp[0], float(fp[0] if left is None else left)).when(v > xp[-1], float(fp[-1] if right is None else right))
    return ends.when(v == xp[-1], float(fp[-1])).otherwise(F.coalesce(inside, F.lit(float(fp[-1]))))


def asof_join(left: DataFrame, right: DataFrame, on: str, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """left with the columns of the latest right row at or before it, in groups of ``by``; one sort of both sides together."""
    theirs = right.select(*by, on, F.struct(*columns).alias("__found"), F.lit(0).alias("__mine"), *(F.lit(None).cast(t).alias(c) for c, t in left.dtypes if c not in (*by, on)))
    mine = left.select(*by, on, F.lit(None).cast(theirs.schema["__found"].dataType).alias("__found"), F.lit(1).alias("__mine"), *(c for c in left.columns if c not in (*by, on)))
    line = Window.partitionBy(*by).orderBy(on, "__mine").rowsBetween(Window.unboundedPreceding, 0)
    rows = theirs.unionByName(mine).withColumn("__found", F.last("__found", ignorenulls=True).over(line)).where("__mine = 1")
    return rows.select(*left.columns, *(F.col(f"__found.{c}").alias(c) for c in columns))


def range_join(left: DataFrame, right: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Rows with low <= value < high: both sides are cut to cells of a width, joined by cell and tested."""
    cells = right.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return left.withColumn("__cell", F.floor(F.col(value) / width)).join(cells, "__cell").where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("__cell")


