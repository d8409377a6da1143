"""Reductions along an axis or over all cells: one partial and one final aggregation.

Aggregates are also exported as Column functions (``agg_*``) for ordinary grouped tables.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import NdFrame, cast
from ..functions import elementwise as E
from ..meta import SPARK, accumulator, checked_axis

NAN = float("nan")


# --- aggregates -------------------------------------------------------------------------------


def agg_sum(v: Column) -> Column:
    return F.sum(v)


def agg_prod(v: Column) -> Column:
    return F.product(v)


def agg_mean(v: Column) -> Column:
    return F.avg(v)


def agg_average(v: Column, w: Column) -> Column:
    """Weighted mean; weights that sum to 0 are an error."""
    total = F.sum(w)
    return F.when(total == 0, F.raise_error(F.lit("weights sum to zero"))).otherwise(F.try_divide(F.sum(v * w), total))


def agg_var(v: Column, ddof: int = 0) -> Column:
    n = F.count(v)
    return F.var_pop(v) if ddof == 0 else F.when(n > ddof, F.try_divide(F.var_pop(v) * n, n - ddof)).otherwise(NAN)


def agg_std(v: Column, ddof: int = 0) -> Column:
    return F.sqrt(agg_var(v, ddof))


def agg_max(v: Column) -> Column:
    return F.max(v)  # NaN is Spark's largest number and so propagates


def agg_min(v: Column) -> Column:
    return F.when(F.bool_or(F.isnan(v.cast("double"))), NAN).otherwise(F.min(v))


def agg_argmax(v: Column, place: Column) -> Column:
    """First place of the greatest value; NaN counts as greatest."""
    return F.max_by(place, F.struct(v, -place))


def agg_argmin(v: Column, place: Column) -> Column:
    """First place of the least value, or of the first NaN."""
    number = ~F.isnan(v.cast("double"))
    return F.min_by(place, F.struct(number, v, place))


def agg_ptp(v: Column) -> Column:
    return agg_max(v) - agg_min(v)


def agg_any(v: Column) -> Column:
    return F.coalesce(F.bool_or(E.truth(v)), F.lit(False))


def agg_all(v: Column) -> Column:
    return F.coalesce(F.bool_and(E.truth(v)), F.lit(True))


def agg_count_nonzero(v: Column) -> Column:
    return F.count_if(E.truth(v))


def _numbers(v: Column) -> Column:
    v = v.cast("double")
    return F.when(~F.isnan(v), v)


def agg_nansum(v: Column) -> Column:
    return F.coalesce(F.sum(_numbers(v)), F.lit(0.0))


def agg_nanprod(v: Column) -> Column:
    return F.coalesce(F.product(_numbers(v)), F.lit(1.0))


def agg_nanmean(v: Column) -> Column:
    return F.coalesce(F.avg(_numbers(v)), F.lit(NAN))


def agg_nanvar(v: Column, ddof: int = 0) -> Column:
    return F.coalesce(agg_var(_numbers(v), ddof), F.lit(NAN))


def agg_nanstd(v: Column, ddof: int = 0) -> Column:
    return F.sqrt(agg_nanvar(v, ddof))


def agg_nanmax(v: Column) -> Column:
    return F.coalesce(F.max(_numbers(v)), F.lit(NAN))


def agg_nanmin(v: Column) -> Column:
    return F.coalesce(F.min(_numbers(v)), F.lit(NAN))


def _all_nan(v: Column, found: Column) -> Column:
    return F.when(F.count(_numbers(v)) == 0, F.raise_error(F.lit("all-NaN slice"))).otherwise(found)


def agg_nanargmax(v: Column, place: Column) -> Column:
    return _all_nan(v, F.max_by(place, F.when(~F.isnan(v.cast("double")), F.struct(v, -place))))


def agg_nanargmin(v: Column, place: Column) -> Column:
    return _all_nan(v, F.min_by(place, F.when(~F.isnan(v.cast("double")), F.struct(v, place))))


def agg_quantile(v: Column, q: float) -> Column:
    """Exact, linear between neighbours; a NaN makes the result NaN."""
    if not 0 <= q <= 1:
        raise ValueError("quantiles reach from 0 to 1")
    return F.when(F.bool_or(F.isnan(v.cast("double"))), NAN).otherwise(F.percentile(v.cast("double"), F.lit(float(q))))


def agg_nanquantile(v: Column, q: float) -> Column:
    if not 0 <= q <= 1:
        raise ValueError("quantiles reach from 0 to 1")
    return F.coalesce(F.percentile(_numbers(v), F.lit(float(q))), F.lit(NAN))


def agg_percentile(v: Column, q: float) -> Column:
    return agg_quantile(v, q / 100)


def agg_median(v: Column) -> Column:
    return agg_quantile(v, 0.5)


def agg_nanmedian(v: Column) -> Column:
    return agg_nanquantile(v, 0.5)


# --- over frames ------------------------------------------------------------------------------


def reduce(a: NdFrame, axis: int | Sequence[int] | None, f: Callable[..., Column], dtype: str | None = None, keepdims: bool = False, place: bool = False) -> NdFrame:
    """One aggregate over the given axes; place also hands it the position along them."""
    gone = list(range(a.ndim)) if axis is None else sorted({checked_axis(x, a.ndim) for x in ([axis] if isinstance(axis, int) else axis)})
    if place and 0 in [a.shape[k] for k in gone]:
        raise ValueError("an empty sequence has no extremum")
    keep = [k for k in range(a.ndim) if k not in gone]
    at = a.flat() if axis is None else F.col(f"i{gone[0]}") if gone else F.lit(0)
    value = f(F.col("v"), at) if place else f(F.col("v"))
    df = a.df.groupBy(*(f"i{k}" for k in keep)).agg(value.alias("v"))
    if keepdims:
        return NdFrame(df.select(*(F.col(f"i{k}") if k in keep else F.lit(0).cast("long").alias(f"i{k}") for k in range(a.ndim)), "v"), [1 if k in gone else n for k, n in enumerate(a.shape)], dtype or a.dtype)
    return NdFrame(df.select(*(F.col(f"i{k}").alias(f"i{j}") for j, k in enumerate(keep)), "v"), [a.shape[k] for k in keep], dtype or a.dtype)


def sum(a: NdFrame, axis: int | None = None, dtype: str | None = None, keepdims: bool = False) -> NdFrame:  # noqa: A001
    """Narrow integers add up as wrapping 32-bit ones."""
    to = dtype or accumulator(a.dtype)
    source = a.dtype if a.dtype.startswith(("float", "int", "uint")) else "int64"
    total = lambda v: F.coalesce(cast(F.sum(v.cast("long") if source != a.dtype or source[0] in "iu" and source != "uint64" else v), source if source[0] == "f" else "int64", to), F.lit(0).cast(SPARK[to]))
    return reduce(a, axis, total, to, keepdims)


#: Factors that are multiplied in one go.
FACTORS = 4096


def prod(a: NdFrame, axis: int | None = None, dtype: str | None = None) -> NdFrame:
    """Integers multiply exactly and wrap: some thousand factors at a time, then their products."""
    to = dtype or accumulator(a.dtype)
    if to.startswith("float"):
        return reduce(a, axis, lambda v: F.coalesce(F.product(v), F.lit(1.0)).cast(SPARK[to]), to)
    gone = list(range(a.ndim)) if axis is None else [checked_axis(axis, a.ndim)]
    keys = [f"i{k}" for k in range(a.ndim) if k not in gone]
    left = math.prod(a.shape[k] for k in gone)
    at = F.lit(0).cast("long")
    for k in gone:
        at = at * a.shape[k] + F.col(f"i{k}")
    rows = a.df.select(*keys, at.alias("__at"), F.col("v").cast("long").alias("v"))
    exact = F.aggregate(F.collect_list("v"), F.lit(1).cast("long"), lambda x, y: x * y).alias("v")
    while left > FACTORS:
        left = -(-left // FACTORS)
        rows = rows.groupBy(*keys, F.pmod("__at", F.lit(left)).alias("__at")).agg(exact)
    rows = rows.groupBy(*keys).agg(exact)
    return NdFrame(rows.select(*(F.col(k).alias(f"i{j}") for j, k in enumerate(keys)), cast(F.col("v"), "int64", to).alias("v")), [n for k, n in enumerate(a.shape) if k not in gone], to)


def _float(a: NdFrame) -> str:
    return "float32" if a.dtype == "float32" else "float64"


def _real(f: Callable[..., Column], a: NdFrame, axis: int | None, keepdims: bool = False) -> NdFrame:
    to = _float(a)
    return reduce(a, axis, lambda v: f(v.cast("double")).cast(SPARK[to]), to, keepdims)


def mean(a: NdFrame, axis: int | None = None, keepdims: bool = False) -> NdFrame:
    return _real(lambda v: F.coalesce(F.avg(v), F.lit(NAN)), a, axis, keepdims)


def average(a: NdFrame, axis: int | None = None, weights: NdFrame | None = None) -> NdFrame:
    if weights is None:
        return mean(a, axis)
    from .shape import combine, expand_dims

    if weights.ndim == 1 and a.ndim > 1:
        for _ in range(a.ndim - 1 - checked_axis(axis, a.ndim)):
            weights = expand_dims(weights, weights.ndim)
    pairs = combine(a, weights, lambda v, w: F.struct(v.cast("double").alias("v"), w.cast("double").alias("w")))
    return reduce(pairs, axis, lambda s: agg_average(s["v"], s["w"]), "float64")


def var(a: NdFrame, axis: int | None = None, ddof: int = 0) -> NdFrame:
    return _real(lambda v: agg_var(v, ddof), a, axis)


def std(a: NdFrame, axis: int | None = None, ddof: int = 0) -> NdFrame:
    return _real(lambda v: agg_std(v, ddof), a, axis)


def max(a: NdFrame, axis: int | None = None) -> NdFrame:  # noqa: A001
    if a.size == 0:
        raise ValueError("an empty array has no maximum")
    return reduce(a, axis, agg_max)


def min(a: NdFrame, axis: int | None = None) -> NdFrame:  # noqa: A001
    if a.size == 0:
        raise ValueError("an empty array has no minimum")
    return reduce(a, axis, agg_min if a.dtype.startswith("float") else F.min)


amax, amin = max, min


def argmax(a: NdFrame, axis: int | None = None) -> NdFrame:
    return reduce(a, axis, agg_argmax, "int64", place=True)


def argmin(a: NdFrame, axis: int | None = None) -> NdFrame:
    return reduce(a, axis, agg_argmin, "int64", place=True)


def ptp(a: NdFrame, axis: int | None = None) -> NdFrame:
    return reduce(a, axis, agg_ptp)


def any(a: NdFrame, axis: int | None = None) -> NdFrame:  # noqa: A001
    return reduce(a, axis, agg_any, "bool")


def all(a: NdFrame, axis: int | None = None) -> NdFrame:  # noqa: A001
    return reduce(a, axis, agg_all, "bool")


def count_nonzero(a: NdFrame, axis: int | None = None, keepdims: bool = False) -> NdFrame:
    return reduce(a, axis, agg_count_nonzero, "int64", keepdims)


def nansum(a: NdFrame, axis: int | None = None) -> NdFrame:
    return _real(agg_nansum, a, axis)


def nanprod(a: NdFrame, axis: int | None = None) -> NdFrame:
    return _real(agg_nanprod, a, axis)


def nanmean(a: NdFrame, axis: int | None = None) -> NdFrame:
    return _real(agg_nanmean, a, axis)


def nanstd(a: NdFrame, axis: int | None = None, ddof: int = 0) -> NdFrame:
    return _real(lambda v: agg_nanstd(v, ddof), a, axis)


def nanvar(a: NdFrame, axis: int | None = None, ddof: int = 0) -> NdFrame:
    return _real(lambda v: agg_nanvar(v, ddof), a, axis)


def nanmax(a: NdFrame, axis: int | None = None) -> NdFrame:
    return _real(agg_nanmax, a, axis)


def nanmin(a: NdFrame, axis: int | None = None) -> NdFrame:
    return _real(agg_nanmin, a, axis)


def nanargmax(a: NdFrame, axis: int | None = None) -> NdFrame:
    return reduce(a, axis, agg_nanargmax, "int64", place=True)


def nanargmin(a: NdFrame, axis: int | None = None) -> NdFrame:
    return reduce(a, axis, agg_nanargmin, "int64", place=True)


def quantile(a: NdFrame, q: float, axis: int | None = None) -> NdFrame:
    return _real(lambda v: agg_quantile(v, q), a, axis)


def percentile(a: NdFrame, q: float, axis: int | None = None) -> NdFrame:
    return quantile(a, q / 100, axis)


def nanquantile(a: NdFrame, q: float, axis: int | None = None) -> NdFrame:
    return _real(lambda v: agg_nanquantile(v, q), a, axis)


def nanpercentile(a: NdFrame, q: float, axis: int | None = None) -> NdFrame:
    return nanquantile(a, q / 100, axis)


def median(a: NdFrame, axis: int | None = None) -> NdFrame:
    return quantile(a, 0.5, axis)


def nanmedian(a: NdFrame, axis: int | None = None) -> NdFrame:
    return nanquantile(a, 0.5, axis)


# --- whole-array tests ------------------------------------------------------------------------


def allclose(a: NdFrame, b: NdFrame, rtol: float = 1e-5, atol: float = 1e-8, equal_nan: bool = False) -> bool:
    from .shape import combine

    near = combine(a, b, lambda x, y: E.isclose(x, y, rtol, atol, equal_nan), "bool")
    return bool(near.df.agg(F.coalesce(F.bool_and("v"), F.lit(True))).first()[0])


def array_equal(a: NdFrame, b: NdFrame) -> bool:
    return a.shape == b.shape and array_equiv(a, b)


def array_equiv(a: NdFrame, b: NdFrame) -> bool:
    from .shape import combine

    if not a.broadcastable(b.shape):
        return False
    same = combine(a, b, lambda x, y: E.equal(x, y) if a.dtype != "str" else x == y, "bool")
    return bool(same.df.agg(F.coalesce(F.bool_and("v"), F.lit(True))).first()[0])


def assert_array_almost_equal(a: NdFrame, b: NdFrame, decimal: int = 6) -> None:
    if not allclose(a, b, 0.0, 1.5 * 10.0**-decimal):
        raise AssertionError(f"arrays differ beyond {decimal} decimals")


# --- histograms and moments -------------------------------------------------------------------


def histogram_bin(v: Column, bins: int, low: float, high: float) -> Column:
    """Bin of equal width by the plain floor formula, the last one closed; null outside the range."""
    at = F.floor((v - low) / (high - low) * bins)
    return F.when((v >= low) & (v <= high), F.least(at, F.lit(bins - 1)))


def histogram(df: DataFrame, value: Column, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """bin, count for every bin, empty ones too; the range is taken from the data if not given."""
    if low is None or high is None or low >= high:
        low, high = df.agg(F.min(value.cast("double")), F.max(value.cast("double"))).first()
        if low is None or not abs(low) + abs(high) < float("inf"):
            raise ValueError("the automatic range is not finite")
        low, high = (low - 0.5, high + 0.5) if low == high else (low, high)
    found = df.select(histogram_bin(value.cast("double"), bins, low, high).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("count"))


def histogram2d(df: DataFrame, x: Column, y: Column, bins: int) -> DataFrame:
    """x_bin, y_bin, count as a double for every pair of bins."""
    x, y = x.cast("double"), y.cast("double")
    xl, xh, yl, yh = df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    found = df.select(histogram_bin(x, bins, xl, xh).alias("x_bin"), histogram_bin(y, bins, yl, yh).alias("y_bin")).groupBy("x_bin", "y_bin").agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins * bins).select(F.call_function("div", F.col("id"), F.lit(bins)).alias("x_bin"), (F.col("id") % bins).alias("y_bin"))
    return every.join(found, ["x_bin", "y_bin"], "left").select("x_bin", "y_bin", F.coalesce("n", F.lit(0)).cast("double").alias("count"))


def bincount(df: DataFrame, value: Column, weights: Column | None = None, minlength: int = 0) -> DataFrame:
    """value, count for 0 to the greatest value; negative values are an error."""
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is not None and low < 0:
        raise ValueError("values must not be negative")
    size = -1 if high is None else int(high)
    n = F.count("*") if weights is None else F.sum(weights.cast("double"))
    found = df.groupBy(value.cast("long").alias("value")).agg(n.alias("n"))
    zero = F.lit(0) if weights is None else F.lit(0.0)
    every = df.sparkSession.range(size + 1 if size + 1 > minlength else minlength).withColumnRenamed("id", "value")
    return every.join(found, "value", "left").select("value", F.coalesce("n", zero).alias("count"))


def cov(df: DataFrame, columns: Sequence[str], ddof: int = 1) -> DataFrame:
    """i, j, cov for every pair of columns, from one pass."""
    return _moments(df, columns, lambda x, y: F.covar_pop(x, y) * F.count("*") / (F.count("*") - ddof) if ddof else F.covar_pop(x, y), "cov")


def corrcoef(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _moments(df, columns, lambda x, y: F.corr(x, y), "corr")


def _moments(df: DataFrame, columns: Sequence[str], f: Callable[[Column, Column], Column], name: str) -> DataFrame:
    pairs = [(i, j) for i in range(len(columns)) for j in range(len(columns))]
    real = [F.col(c).cast("double") for c in columns]
    one = df.agg(*(f(real[i], real[j]).alias(f"m{i}_{j}") for i, j in pairs))
    return one.select(F.inline(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"m{i}_{j}").alias(name)) for i, j in pairs))))
