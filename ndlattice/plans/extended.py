"""More registered queries: axis reductions, shapes, transforms, factorisations, files and types, each with its SQL."""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import checks, meta, printing
from ..frame import NdFrame, from_column, from_columns, from_numpy, matched
from ..functions import complexes as Z
from ..functions import dates as D
from ..functions import elementwise as E
from ..functions import masked as K
from ..functions import polynomials as P
from ..functions import records
from ..functions import special as S
from ..functions import strings as T
from ..operators import apply, fft, indexing, joining, linalg, products, random, reductions, shape, sorting, windows
from ..sources import binary, creation, text
from ..streaming import windows as streams
from . import ordered
from .queries import CKEY, ORACLES, PKEY, QUERIES, _created, _d, _grid, _i, _M, _N, _NUMBERED, _orders, _r, _ranged, _s, _shaped, c, query, rowwise, table  # noqa: F401

_MAT = _M.replace("@", _NUMBERED)


def _matrix10(spark, sf) -> NdFrame:
    """Order prices by date, ten a row."""
    a = _orders(spark, sf)
    return shape.reshape(a, (a.size // 10, 10))


def _side_by_side(frames: dict[str, NdFrame], digits: int = 4) -> DataFrame:
    """One row a place, one column a frame; whole numbers and truths stay what they are."""
    def one(name: str, a: NdFrame) -> DataFrame:
        v = c("v") if a.dtype in ("bool", "str") else c("v").cast("long") if a.dtype.startswith("int") else _r(c("v"), digits)
        return a.df.select(*a.idx, v.alias(name))

    parts, first = [one(name, a) for name, a in frames.items()], next(iter(frames.values()))
    return functools.reduce(lambda x, y: matched(x, y, first.idx, first.size, first.size), parts)


def _by_row(name: str, f: Callable[[NdFrame], dict[str, NdFrame]], sql: str, digits: int = 4) -> None:
    """Reductions of the rows of the price matrix against a GROUP BY over them."""
    QUERIES[name] = lambda spark, sf: _side_by_side(f(_matrix10(spark, sf)), digits)
    ORACLES[name] = f"SELECT CAST(r AS BIGINT) AS i0, {sql} FROM {_MAT} GROUP BY r"


# --- reductions along an axis -----------------------------------------------------------------------

_by_row("axis_prod", lambda m: {"p": reductions.prod(m.map(lambda v: v / 300000), 1), "w": reductions.prod(m.map(lambda v: F.floor(v) % 7 + 1, "int64"), 1)}, "round(product(p / 300000), 6) AS p, CAST(product(CAST(floor(p) AS BIGINT) % 7 + 1) AS BIGINT) AS w", 6)
_by_row("axis_extrema", lambda m: {"mx": reductions.amax(m, 1), "mn": reductions.amin(m, 1), "ax": reductions.argmax(m, 1), "an": reductions.argmin(m, 1), "range": reductions.ptp(m, 1)}, "round(max(p), 4) AS mx, round(min(p), 4) AS mn, CAST(arg_max(k, (p, -k)) AS BIGINT) AS ax, CAST(arg_min(k, (p, k)) AS BIGINT) AS an, round(max(p) - min(p), 4) AS range")
_by_row("axis_truth", lambda m: (lambda b: {"some": reductions.any(b, 1), "every": reductions.all(b, 1), "n": reductions.count_nonzero(b, 1)})(m.map(lambda v: F.floor(v / 100000))), "bool_or(p >= 100000) AS some, bool_and(p >= 100000) AS every, CAST(count(*) FILTER (p >= 100000) AS BIGINT) AS n")
_by_row("axis_spread", lambda m: {"v": reductions.var(m, 1, 1), "s": reductions.std(m, 1)}, "round(var_samp(p), 2) AS v, round(stddev_pop(p), 2) AS s", 2)
_by_row("axis_quantiles", lambda m: {"lo": reductions.percentile(m, 25, 1), "hi": reductions.quantile(m, 0.75, 1), "md": reductions.median(m, 1)}, "round(quantile_cont(p, 0.25), 4) AS lo, round(quantile_cont(p, 0.75), 4) AS hi, round(median(p), 4) AS md")


def _holes(m: NdFrame) -> NdFrame:
    return m.map(lambda v: F.when(v >= 100000, v / 99991).otherwise(math.nan))


_P = "CASE WHEN p >= 100000 THEN p / 99991.0 END"
_by_row("axis_nan", lambda m: (lambda h: {"total": reductions.nansum(h, 1), "p": reductions.nanprod(h, 1), "m": reductions.nanmean(h, 1), "s": reductions.nanstd(h, 1), "v": reductions.nanvar(h, 1), "mx": reductions.nanmax(h, 1), "mn": reductions.nanmin(h, 1)})(_holes(m)), f"round(coalesce(sum({_P}), 0), 4) AS total, round(coalesce(product({_P}), 1), 4) AS p, round(avg({_P}), 4) AS m, round(stddev_pop({_P}), 4) AS s, round(var_pop({_P}), 4) AS v, round(max({_P}), 4) AS mx, round(min({_P}), 4) AS mn")
_by_row("axis_nan_order", lambda m: (lambda h: {"md": reductions.nanmedian(h, 1), "lo": reductions.nanpercentile(h, 30, 1), "hi": reductions.nanquantile(h, 0.9, 1)})(_holes(m)), f"round(median({_P}), 4) AS md, round(quantile_cont({_P}, 0.3), 4) AS lo, round(quantile_cont({_P}, 0.9), 4) AS hi")
_by_row("axis_nan_places", lambda m: (lambda h: {"ax": reductions.nanargmax(h, 1), "an": reductions.nanargmin(h, 1)})(m.map(lambda v: F.when((c("i1") == 0) | (v >= 100000), v).otherwise(math.nan))), "CAST(arg_max(k, (p, -k)) FILTER (k = 0 OR p >= 100000) AS BIGINT) AS ax, CAST(arg_min(k, (p, k)) FILTER (k = 0 OR p >= 100000) AS BIGINT) AS an")


@query(f"SELECT CAST(0 AS BIGINT) AS k, round(sum(p), 2) AS v FROM {_MAT} WHERE r = k UNION ALL SELECT 1, round(sum(p), 2) FROM {_MAT} WHERE k - r = 2")
def traces(spark, sf):
    m = _matrix10(spark, sf)
    return indexing.trace(m).df.select(F.lit(0).cast("long").alias("k"), F.round("v", 2).alias("v")).union(indexing.trace(m, 2).df.select(F.lit(1).cast("long"), F.round("v", 2)))


@query(f"WITH s AS (SELECT sum(p) AS t FROM {_MAT}) SELECT 'equal' AS test, true AS v UNION ALL SELECT 'equiv', true UNION ALL SELECT 'close', true UNION ALL SELECT 'moved', t < 0 FROM s UNION ALL SELECT 'almost', true UNION ALL SELECT 'apart', false")
def whole_array_tests(spark, sf):
    """Tests of whole arrays: equal to itself, to a row that is broadcast, close to a slightly moved copy, and unlike a reversed one."""
    a = _orders(spark, sf)
    near = a.map(lambda v: v * (1 + 1e-9))
    ones = creation.ones_like(a)
    found = {"equal": reductions.array_equal(a, a), "equiv": reductions.array_equiv(ones, creation.ones(spark, (1,))), "close": reductions.allclose(a, near), "moved": reductions.array_equal(a, shape.flip(a)), "apart": reductions.allclose(a, a.map(lambda v: v + 1), 0.0, 0.5)}
    reductions.assert_array_almost_equal(a, near, 2)
    checks.assert_allclose(a, near, 1e-6)
    checks.assert_array_equal(a, checks.copy(checks.asarray_chkfinite(a)))
    for broken in (lambda: checks.assert_allclose(a, shape.flip(a)), lambda: checks.assert_array_equal(a, near)):
        try:
            broken()
        except AssertionError:
            continue
        found["equal"] = False
    return spark.createDataFrame([*found.items(), ("almost", True)], "test string, v boolean")


# --- running operators along an axis ----------------------------------------------------------------

_LINE = "OVER (PARTITION BY r ORDER BY k ROWS UNBOUNDED PRECEDING)"


@query(f"SELECT CAST(r AS BIGINT) AS i0, CAST(k AS BIGINT) AS i1, round(sum(p / 99991.0) {_LINE}, 4) AS s, round(product(p / 99991.0) {_LINE}, 4) AS p, round(sum(coalesce({_P}, 0)) {_LINE}, 4) AS ns, round(product(coalesce({_P}, 1)) {_LINE}, 4) AS np FROM {_MAT}")
def axis_running(spark, sf):
    m = _matrix10(spark, sf)
    m, h = m.map(lambda v: v / 99991), _holes(m)
    return _side_by_side({"s": windows.cumsum(m, 1), "p": windows.cumprod(m, 1), "ns": windows.nancumsum(h, 1), "np": windows.nancumprod(h, 1)})


_shaped("ediff1d", lambda a: windows.ediff1d(a, [1.0], [2.0, 3.0]), "SELECT CAST(i AS BIGINT) AS i0, CASE WHEN i = 0 THEN 1.0 ELSE round(o_totalprice - lag(o_totalprice) OVER (ORDER BY i), 2) END AS v FROM @ UNION ALL SELECT #n, 2.0 UNION ALL SELECT #n + 1, 3.0")


@query(f"SELECT CAST(r AS BIGINT) AS i0, CAST(k AS BIGINT) AS i1, round(exp((p - m) / 100000) / s, 8) AS soft, round((p - m) / 100000 - ln(s), 6) AS log FROM (SELECT *, sum(exp((p - m) / 100000)) OVER (PARTITION BY r) AS s FROM (SELECT *, max(p) OVER (PARTITION BY r) AS m FROM {_MAT}))")
def softmax_rows(spark, sf):
    m = _matrix10(spark, sf).map(lambda v: v / 100000)
    return windows.softmax(m, 1).df.withColumnRenamed("v", "a").join(windows.log_softmax(m, 1).df.withColumnRenamed("v", "b"), m.idx).select("i0", "i1", _r(c("a"), 8).alias("soft"), _r(c("b"), 6).alias("log"))


@query(f"SELECT CAST(r AS BIGINT) AS i0, CAST(row_number() OVER w - 1 AS BIGINT) AS i1, CAST(k AS BIGINT) AS a, CAST(k AS BIGINT) AS p, round(p, 2) AS s FROM {_MAT} WINDOW w AS (PARTITION BY r ORDER BY p, k)")
def sort_rows(spark, sf):
    m = _matrix10(spark, sf)
    return _side_by_side({"a": sorting.argsort(m, 1), "p": sorting.argpartition(m, 4, 1), "s": sorting.sort(m, 1)}, 2)


@query(f"SELECT CAST(row_number() OVER (PARTITION BY k ORDER BY p, r) - 1 AS BIGINT) AS i0, CAST(k AS BIGINT) AS i1, round(p, 2) AS v FROM {_MAT}")
def msort(spark, sf):
    return sorting.msort(_matrix10(spark, sf)).df.select("i0", "i1", _r(c("v"), 2).alias("v"))


@query("SELECT CAST(row_number() OVER (ORDER BY floor(c_acctbal / 1000), c_custkey) - 1 AS BIGINT) AS i0, CAST(floor(c_acctbal / 1000) AS DOUBLE) AS re, CAST(c_custkey AS DOUBLE) AS im FROM customer")
def sort_complex(spark, sf):
    rows = table(spark, sf, "customer")
    a = from_column(rows, Z.make(F.floor(c("c_acctbal") / 1000).cast("double"), c("c_custkey").cast("double")), -c("c_custkey"))
    return sorting.sort_complex(a).df.select("i0", "v.re", "v.im")


# --- shapes ------------------------------------------------------------------------------------------


def _matrix_shaped(name: str, f: Callable[[NdFrame], NdFrame], sql: str) -> None:
    _shaped(name, lambda a: f(shape.reshape(a, (a.size // 10, 10))), sql)


_R = "(#n // 10)"
_matrix_shaped("ravel_orders", lambda m: joining.concatenate([shape.ravel(m), shape.ravel(m, "F")]), f"SELECT CAST(r * 10 + k AS BIGINT) AS i0, round(p, 2) AS v FROM {_M} UNION ALL SELECT CAST(#n + k * {_R} + r AS BIGINT), round(p, 2) FROM {_M}")
_matrix_shaped("rollaxis", lambda m: shape.rollaxis(shape.reshape(m, (m.shape[0], 5, 2)), 2, 0), f"SELECT CAST(k % 2 AS BIGINT) AS i0, CAST(r AS BIGINT) AS i1, CAST(k // 2 AS BIGINT) AS i2, round(p, 2) AS v FROM {_M}")
_matrix_shaped("einsum_transpose", products.einsum_transpose, f"SELECT CAST(k AS BIGINT) AS i0, CAST(r AS BIGINT) AS i1, round(p, 2) AS v FROM {_M}")
_matrix_shaped("at_least", lambda m: shape.atleast_3d(shape.atleast_2d(shape.atleast_1d(m))), f"SELECT CAST(r AS BIGINT) AS i0, CAST(k AS BIGINT) AS i1, CAST(0 AS BIGINT) AS i2, round(p, 2) AS v FROM {_M}")
_matrix_shaped("flip_sides", lambda m: shape.fliplr(shape.flipud(m)), f"SELECT CAST({_R} - 1 - r AS BIGINT) AS i0, CAST(9 - k AS BIGINT) AS i1, round(p, 2) AS v FROM {_M}")
_shaped("ifftshift", shape.ifftshift, "SELECT CAST((i + #n - #n // 2) % #n AS BIGINT) AS i0, round(o_totalprice, 2) AS v FROM @")
_matrix_shaped("split_columns", lambda m: joining.hstack([shape.hsplit(m, 5)[3], shape.hsplit(m, [1, 4])[1]]), f"SELECT CAST(r AS BIGINT) AS i0, CAST(k - 6 AS BIGINT) AS i1, round(p, 2) AS v FROM {_M} WHERE k IN (6, 7) UNION ALL SELECT CAST(r AS BIGINT), CAST(k + 1 AS BIGINT), round(p, 2) FROM {_M} WHERE k BETWEEN 1 AND 3")
_matrix_shaped("split_rows", lambda m: shape.vsplit(m, [5, 9])[1], f"SELECT CAST(r - 5 AS BIGINT) AS i0, CAST(k AS BIGINT) AS i1, round(p, 2) AS v FROM {_M} WHERE r BETWEEN 5 AND 8")
_matrix_shaped("split_depth", lambda m: shape.dsplit(shape.reshape(m, (m.shape[0], 2, 5)), [2])[1], f"SELECT CAST(r AS BIGINT) AS i0, CAST(k // 5 AS BIGINT) AS i1, CAST(k % 5 - 2 AS BIGINT) AS i2, round(p, 2) AS v FROM {_M} WHERE k % 5 >= 2")
_shaped("array_split", lambda a: shape.array_split(a, 7)[6], "SELECT CAST(i - (#n - #n // 7) AS BIGINT) AS i0, round(o_totalprice, 2) AS v FROM @ WHERE i >= #n - #n // 7")
_shaped("stack_depth", lambda a: joining.dstack([a, shape.flip(a)]), "SELECT CAST(0 AS BIGINT) AS i0, CAST(i AS BIGINT) AS i1, CAST(0 AS BIGINT) AS i2, round(o_totalprice, 2) AS v FROM @ UNION ALL SELECT 0, CAST(#n - 1 - i AS BIGINT), 1, round(o_totalprice, 2) FROM @")
_shaped("stack_columns", lambda a: joining.column_stack([a, shape.flip(a)]), "SELECT CAST(i AS BIGINT) AS i0, CAST(0 AS BIGINT) AS i1, round(o_totalprice, 2) AS v FROM @ UNION ALL SELECT CAST(#n - 1 - i AS BIGINT), 1, round(o_totalprice, 2) FROM @")
_shaped("stack_rows", lambda a: joining.vstack([a, shape.flip(a)]), "SELECT CAST(0 AS BIGINT) AS i0, CAST(i AS BIGINT) AS i1, round(o_totalprice, 2) AS v FROM @ UNION ALL SELECT 1, CAST(#n - 1 - i AS BIGINT), round(o_totalprice, 2) FROM @")
_matrix_shaped("bmat", lambda m: joining.bmat([[m, m], [m, m]]), f"SELECT CAST(r + {_R} * a AS BIGINT) AS i0, CAST(k + 10 * b AS BIGINT) AS i1, round(p, 2) AS v FROM {_M}, range(2) x(a), range(2) y(b)")
_shaped("trim_zeros", lambda a: indexing.trim_zeros(shape.pad(a, 4)), "SELECT CAST(i AS BIGINT) AS i0, round(o_totalprice, 2) AS v FROM @")
_shaped("broadcast_rows", lambda a: shape.broadcast_to(a, (3, a.size)), "SELECT CAST(t AS BIGINT) AS i0, CAST(i AS BIGINT) AS i1, round(o_totalprice, 2) AS v FROM @, range(3) x(t)")
_shaped("broadcast_both", lambda a: (lambda x, y: shape.combine(x, y, E.add))(*shape.broadcast_arrays(a, creation.from_rule(a.df.sparkSession, (2, 1), lambda i, j: (i + 1).cast("double")))), "SELECT CAST(t AS BIGINT) AS i0, CAST(i AS BIGINT) AS i1, round(o_totalprice + t + 1, 2) AS v FROM @, range(2) x(t)")
_matrix_shaped("take_along_axis", lambda m: indexing.take_along_axis(m, sorting.argsort(m, 1), 1), f"SELECT CAST(r AS BIGINT) AS i0, CAST(row_number() OVER (PARTITION BY r ORDER BY p, k) - 1 AS BIGINT) AS i1, round(p, 2) AS v FROM {_M}")
_matrix_shaped("put_along_axis", lambda m: indexing.put_along_axis(m, shape.expand_dims(reductions.argmax(m, 1), 1), shape.expand_dims(creation.full_like(reductions.argmax(m, 1).astype("float64"), -1.0), 1), 1), f"SELECT CAST(r AS BIGINT) AS i0, CAST(k AS BIGINT) AS i1, CASE WHEN k = first_value(k) OVER (PARTITION BY r ORDER BY p DESC, k) THEN -1.0 ELSE round(p, 2) END AS v FROM {_M}")
_matrix_shaped("boolean_index", lambda m: indexing.boolean_index(m, m.map(lambda v: v > 250000, "bool")), f"SELECT CAST(row_number() OVER (ORDER BY r, k) - 1 AS BIGINT) AS i0, round(p, 2) AS v FROM {_M} WHERE p > 250000")
_shaped("copyto", lambda a: indexing.copyto(creation.zeros_like(a), from_numpy(a.df.sparkSession, [2.5])), "SELECT CAST(i AS BIGINT) AS i0, 2.5 AS v FROM @")
_shaped("like_another", lambda a: joining.vstack([creation.zeros_like(a), creation.ones_like(a), creation.full_like(a, 7.5)]), "SELECT CAST(t AS BIGINT) AS i0, CAST(i AS BIGINT) AS i1, CASE t WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 7.5 END AS v FROM @, range(3) x(t)")


@query(f"SELECT CAST(r AS BIGINT) AS i0, CAST(k AS BIGINT) AS i1, CAST(r * 10 + k AS BIGINT) AS flat FROM {_MAT} WHERE p > 400000")
def argwhere_flatnonzero(spark, sf):
    m = _matrix10(spark, sf).map(lambda v: v > 400000, "bool")
    flat = indexing.flatnonzero(m).select(c("i0").alias("flat"), F.floor(c("i0") / 10).alias("i0"), (c("i0") % 10).alias("i1"))
    return indexing.argwhere(m).join(flat, ["i0", "i1"]).join(indexing.where_indices(m), ["i0", "i1"], "left_semi").select("i0", "i1", "flat")


_created("identity_diagflat", lambda s: shape.combine(creation.identity(s, 12), creation.diagflat(creation.arange(s, 1, 12), 1), E.add), _grid(12, 12, "CASE WHEN i = j THEN 1 WHEN j - i = 1 THEN i + 1 ELSE 0 END"))
_created("array_new_empty", lambda s: joining.concatenate([creation.empty(s, (5,)), creation.empty_like(creation.ones(s, (4,)))]), _ranged(9, "0"))
_created("kaiser_window", lambda s: creation.kaiser(s, 101, 14.0), _ranged(101, "list_sum(list_transform(range(60), lambda k: pow(7.0 * sqrt(greatest(0.0, 1 - pow(2.0 * i / 100 - 1, 2))), 2 * k) / pow(gamma(k + 1), 2))) / list_sum(list_transform(range(60), lambda k: pow(7.0, 2 * k) / pow(gamma(k + 1), 2)))", 6), 6)
QUERIES.pop("kaiser", None)

# --- transforms: every one against its definition ----------------------------------------------------

_WAVE = "((i * 7 + j * 3) % 11)"
_TURN = "2 * pi() * {} / {}"


def _wave(spark) -> NdFrame:
    return creation.from_rule(spark, (6, 8), lambda i, j: ((i * 7 + j * 3) % 11).cast("double"))


def _spectrum(name: str, f: Callable[[NdFrame], NdFrame], sql: str) -> None:
    """A complex result as two columns."""
    def run(spark, sf):
        out = f(_wave(spark))
        return out.df.select(*out.idx, _r(c("v.re"), 6).alias("re"), _r(c("v.im"), 6).alias("im"))

    QUERIES[name], ORACLES[name] = run, sql


def _dft_rows(width: int, scale: str = "1", sign: int = -1) -> str:
    turn = "2 * pi() * j * q / 8"
    return f"SELECT CAST(i AS BIGINT) AS i0, CAST(q AS BIGINT) AS i1, round(sum({_WAVE} * cos({turn})) * {scale}, 6) + 0.0 AS re, round({sign} * sum({_WAVE} * sin({turn})) * {scale}, 6) + 0.0 AS im FROM range(6) a(i), range(8) b(j), range({width}) d(q) GROUP BY i, q"


_spectrum("fft_rows", fft.fft, _dft_rows(8))
_spectrum("ifft_rows", fft.ifft, _dft_rows(8, "0.125", 1))
_spectrum("rfft_rows", fft.rfft, _dft_rows(5))
_spectrum("ihfft_rows", fft.ihfft, _dft_rows(5, "0.125", 1))


def _dft_both(width: int, scale: str = "1", sign: int = -1) -> str:
    turn = "2 * pi() * (j * q / 8.0 + i * o / 6.0)"
    return f"SELECT CAST(o AS BIGINT) AS i0, CAST(q AS BIGINT) AS i1, round(sum({_WAVE} * cos({turn})) * {scale}, 6) + 0.0 AS re, round({sign} * sum({_WAVE} * sin({turn})) * {scale}, 6) + 0.0 AS im FROM range(6) a(i), range(8) b(j), range(6) e(o), range({width}) d(q) GROUP BY o, q"


_spectrum("fft2_both", fft.fft2, _dft_both(8))
_spectrum("fftn_both", fft.fftn, _dft_both(8))
_spectrum("ifft2_both", fft.ifft2, _dft_both(8, "(1 / 48.0)", 1))
_spectrum("ifftn_both", fft.ifftn, _dft_both(8, "(1 / 48.0)", 1))
_spectrum("rfftn_both", fft.rfftn, _dft_both(5))
_created("irfft_rows", lambda s: fft.irfft(fft.rfft(_wave(s))), _grid(6, 8, _WAVE))
_created("irfftn_both", lambda s: fft.irfftn(fft.rfftn(_wave(s))), _grid(6, 8, _WAVE))
_created("hfft_rows", lambda s: fft.hfft(_wave(s)), f"SELECT CAST(i AS BIGINT) AS i0, CAST(q AS BIGINT) AS i1, round(sum({_WAVE} * CASE WHEN j = 0 THEN 1 WHEN j = 7 THEN cos(pi() * q) ELSE 2 * cos(2 * pi() * j * q / 14) END), 6) + 0.0 AS v FROM range(6) a(i), range(8) b(j), range(14) d(q) GROUP BY i, q", 6)

# --- factorisations: two by two matrices, whose results have a closed form -----------------------------

_TWO = "(SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS n, 2.0 + c_custkey % 7 AS a, 3.0 + c_custkey % 5 AS d, c_acctbal / 9973.0 AS b FROM customer)"


def _two(spark, sf) -> NdFrame:
    """Symmetric positive matrices ((a, b), (b, d)), one for each customer."""
    rows = ordered.positions(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), c("c_custkey"), name="n")
    a, d, b = 2.0 + c("c_custkey") % 7, 3.0 + c("c_custkey") % 5, c("c_acctbal") / 9973.0
    flat = rows.select(c("n").alias("i0"), F.posexplode(F.array(a, b, b, d)).alias("at", "v"))
    df = flat.select("i0", F.floor(c("at") / 2).alias("i1"), (c("at") % 2).cast("long").alias("i2"), "v")
    return NdFrame(df, (rows.count(), 2, 2))


_ROOT = "sqrt((a - d) * (a - d) / 4 + b * b)"
_HIGH, _LOW = f"((a + d) / 2 + {_ROOT})", f"((a + d) / 2 - {_ROOT})"


@query(f"SELECT CAST(n AS BIGINT) AS i0, round(a * d - b * b, 5) AS det, 1.0 AS sign, round(ln(a * d - b * b), 5) AS logdet, round({_HIGH} / {_LOW}, 5) AS cond, CAST(2 AS DOUBLE) AS rank, round(a * a + 2 * b * b + d * d, 5) AS fro FROM {_TWO}")
def linalg_numbers(spark, sf):
    m = _two(spark, sf)
    sign, logdet = linalg.slogdet(m)
    return _side_by_side({"det": linalg.det(m), "sign": sign, "logdet": logdet, "cond": linalg.cond(m), "rank": linalg.matrix_rank(m), "fro": linalg.matrix_norm(m).map(lambda v: v * v)}, 5)


@query(f"SELECT CAST(n AS BIGINT) AS i0, CAST(k AS BIGINT) AS i1, round(CASE k WHEN 0 THEN {_LOW} ELSE {_HIGH} END, 5) AS eigh, round(CASE k WHEN 0 THEN {_HIGH} ELSE {_LOW} END, 5) AS svd, round(CASE k WHEN 0 THEN {_LOW} ELSE {_HIGH} END, 5) AS eig, round(CASE k WHEN 0 THEN (d - 2 * b) ELSE (2 * a - b) END / (a * d - b * b), 5) AS x FROM {_TWO}, range(2) t(k)")
def linalg_vectors(spark, sf):
    m = _two(spark, sf)
    b = NdFrame(m.df.where("i1 = i2").select("i0", "i1", (c("i1") + 1.0).alias("v")), m.shape[:2])
    found = linalg.eigvals(m)
    eig = sorting.sort(NdFrame(found.df.withColumn("v", c("v.re")), found.shape), 1)
    both = linalg.eig(m)[0]
    again = sorting.sort(NdFrame(both.df.withColumn("v", c("v.re")), both.shape), 1)
    eigh = linalg.eigh(m)[0]
    out = _side_by_side({"eigh": eigh, "svd": linalg.svdvals(m), "eig": eig, "x": linalg.solve(m, b)}, 5)
    same = _side_by_side({"one": linalg.eigvalsh(m, True), "two": linalg.svd(m)[1], "three": again}, 5)
    return matched(out, same, b.idx, b.size, b.size).where((F.abs(c("one") - c("eigh")) < 1e-4) & (F.abs(c("two") - c("svd")) < 1e-4) & (F.abs(c("three") - c("eig")) < 1e-4)).select("i0", "i1", "eigh", "svd", "eig", "x")


@query(f"SELECT CAST(n AS BIGINT) AS i0, CAST(r AS BIGINT) AS i1, CAST(k AS BIGINT) AS i2, round(CASE r + k WHEN 0 THEN d WHEN 1 THEN -b ELSE a END / (a * d - b * b), 5) + 0.0 AS inv, round(CASE r + k WHEN 0 THEN d WHEN 1 THEN -b ELSE a END / (a * d - b * b), 5) + 0.0 AS pinv, round(CASE WHEN r = 0 AND k = 0 THEN sqrt(a) WHEN r = 1 AND k = 0 THEN b / sqrt(a) WHEN r = 1 THEN sqrt(d - b * b / a) ELSE 0 END, 5) + 0.0 AS cholesky, round(CASE WHEN r = 0 AND k = 0 THEN sqrt(a * a + b * b) WHEN r = 0 THEN abs(a * b + b * d) / sqrt(a * a + b * b) WHEN k = 1 THEN (a * d - b * b) / sqrt(a * a + b * b) ELSE 0 END, 5) + 0.0 AS qr, round(CASE r + k WHEN 0 THEN a WHEN 1 THEN b ELSE d END, 5) + 0.0 AS whole FROM {_TWO}, range(2) t(r), range(2) u(k)")
def linalg_matrices(spark, sf):
    m = _two(spark, sf)
    q, r = linalg.qr(m)
    u, s, vt = linalg.svd(m)
    values, vectors = linalg.eigh(m)
    whole = products.einsum("nij,nj,nkj->nik", vectors, values, vectors)
    other = products.matmul(products.einsum("nij,nj->nij", u, s), vt)
    out = _side_by_side({"inv": linalg.inv(m), "pinv": linalg.pinv(m), "cholesky": linalg.cholesky(m), "qr": r.map(F.abs), "whole": whole}, 5)
    same = _side_by_side({"one": products.matmul(q, r), "two": other}, 5)
    return matched(out, same, m.idx, m.size, m.size).where((F.abs(c("one") - c("whole")) < 1e-4) & (F.abs(c("two") - c("whole")) < 1e-4)).select("i0", "i1", "i2", "inv", "pinv", "cholesky", "qr", "whole")


_created("tensor_solve", lambda s: linalg.tensorsolve(creation.from_rule(s, (2, 3, 6), lambda i, j, k: F.when(k == i * 3 + j, 2.0).otherwise(0.0)), creation.from_rule(s, (2, 3), lambda i, j: (i + j).cast("double"))), "SELECT CAST(k AS BIGINT) AS i0, (k // 3 + k % 3) / 2.0 AS v FROM range(6) t(k)")
_created("tensor_inverse", lambda s: linalg.tensorinv(creation.from_rule(s, (2, 3, 6), lambda i, j, k: F.when(k == i * 3 + j, 2.0).otherwise(0.0)), 2), "SELECT CAST(k AS BIGINT) AS i0, CAST(i AS BIGINT) AS i1, CAST(j AS BIGINT) AS i2, CASE WHEN k = i * 3 + j THEN 0.5 ELSE 0.0 END AS v FROM range(6) x(k), range(2) t(i), range(3) u(j)")
_created("einsum_diag_inner", lambda s: joining.concatenate([products.einsum_diag(creation.from_rule(s, (7, 7), lambda i, j: (i * 7 + j).cast("double"))), products.inner(creation.from_rule(s, (3, 5), lambda i, j: (i + j).cast("double")), creation.arange(s, 0, 5))]), "SELECT CAST(i AS BIGINT) AS i0, CAST(i * 8 AS DOUBLE) AS v FROM range(7) t(i) UNION ALL SELECT CAST(7 + i AS BIGINT), CAST(sum((i + j) * j) AS DOUBLE) FROM range(3) t(i), range(5) u(j) GROUP BY i")


@query("SELECT 'x' AS part, CAST(0 AS BIGINT) AS i0, round(regr_intercept(l_extendedprice, l_quantity), 2) AS v FROM lineitem UNION ALL SELECT 'x', 1, round(regr_slope(l_extendedprice, l_quantity), 2) FROM lineitem UNION ALL SELECT 'rank', 0, 2.0")
def lstsq(spark, sf):
    """Least squares of the whole table from one aggregation, and the same from the normal equations as small dense arrays."""
    x = linalg.lstsq_table(table(spark, sf, "lineitem").withColumn("one", F.lit(1.0)), ["one", "l_quantity"], "l_extendedprice")
    g = linalg.gram(table(spark, sf, "lineitem").withColumn("one", F.lit(1.0)), ["one", "l_quantity", "l_extendedprice"])
    small = linalg.lstsq(from_numpy(spark, g[:2, :2]), from_numpy(spark, g[:2, 2]))
    found = small["x"].df.select(F.lit("x").alias("part"), "i0", _r(c("v"), 2).alias("v"))
    assert np.allclose(x, small["x"].to_numpy(), rtol=1e-6)
    return found.union(small["rank"].df.select(F.lit("rank"), F.lit(0).cast("long"), _r(c("v"))))


# --- series and special functions ----------------------------------------------------------------------

_SERIES = {
    "polysub": (P.polysub([3, 2, 1], [1, 1]), (3, 1, 0)), "polydiv": (P.polydiv([1, -3, 2], [1, -1])[0], (1, -2)), "poly": (P.poly([1, 2]), (1, -3, 2)),
    "polyfromroots": (P.polyfromroots([1, 2]), (2, -3, 1)), "polyroots": (np.sort(P.polyroots([2, -3, 1])), (1, 2)), "chebadd": (P.chebadd([1, 2], [3]), (4, 2)), "chebsub": (P.chebsub([1, 2], [3]), (-2, 2)),
    "chebmul": (P.chebmul([0, 1], [0, 1]), (0.5, 0, 0.5)), "legmul": (P.legmul([0, 1], [0, 1]), (1 / 3, 0, 2 / 3)), "hermmul": (P.hermmul([0, 1], [0, 1]), (2, 0, 1)), "lagmul": (P.lagmul([0, 1], [0, 1]), (1, -2, 2)),
    "chebder": (P.chebder([0, 0, 1]), (0, 4)), "chebint": (P.chebint([0, 1]), (0.25, 0, 0.25)), "legder": (P.legder([0, 0, 1]), (0, 3)), "hermder": (P.hermder([0, 0, 1]), (0, 4)), "lagder": (P.lagder([0, 0, 1]), (-1, -1)),
    "poly2cheb": (P.poly2cheb([0, 0, 1]), (0.5, 0, 0.5)), "leg2poly": (P.leg2poly([0, 0, 1]), (-0.5, 0, 1.5)), "poly2leg": (P.poly2leg([0, 0, 1]), (1 / 3, 0, 2 / 3)),
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{op}', CAST({k} AS BIGINT), CAST({round(v, 6)} AS DOUBLE))" for op, (_, want) in _SERIES.items() for k, v in enumerate(want)) + ") t(op, k, v)")
def series_rules(spark, sf):
    """Coefficient arithmetic against values worked out by hand."""
    return spark.createDataFrame([(op, k, round(float(v), 6) + 0.0) for op, (found, _) in _SERIES.items() for k, v in enumerate(found)], "op string, k long, v double")


_SLOPE, _BASE = "regr_slope(l_extendedprice, l_quantity)", "regr_intercept(l_extendedprice, l_quantity)"


@query(f"SELECT * FROM (SELECT 'cheb' AS basis, round({_BASE}, 2) AS base, round({_SLOPE}, 3) AS slope FROM lineitem UNION ALL SELECT 'leg', round({_BASE}, 2), round({_SLOPE}, 3) FROM lineitem UNION ALL SELECT 'herm', round({_BASE}, 2), round({_SLOPE} / 2, 3) FROM lineitem UNION ALL SELECT 'lag', round({_BASE} + {_SLOPE}, 2), round(-{_SLOPE}, 3) FROM lineitem)")
def series_fits(spark, sf):
    df = table(spark, sf, "lineitem")
    fits = {"cheb": P.chebfit, "leg": P.legfit, "herm": P.hermfit, "lag": P.lagfit}
    return spark.createDataFrame([(name, *(round(float(x), d) for x, d in zip(f(df, "l_quantity", "l_extendedprice", 1), (2, 3), strict=True))) for name, f in fits.items()], "basis string, base double, slope double")


def _erf_terms(x: Column) -> Column:
    """2 / sqrt(pi) * sum of (-1)^k x^(2k+1) / (k! (2k+1)), in the JVM."""
    return sum((x ** (2 * k + 1) * ((-1) ** k / (math.factorial(k) * (2 * k + 1))) for k in range(40)), F.lit(0.0)) * (2 / math.sqrt(math.pi))


def _sql_series(x: str, term: str, n: int) -> str:
    return f"list_sum(list_transform(range({n}), lambda k: {term.replace('@', x)}))"


_ERF = _sql_series("(p_size / 25.0)", "(CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * pow(@, 2 * k + 1) / (gamma(k + 1) * (2 * k + 1))", 40) + " * 2 / sqrt(pi())"
rowwise("error_functions", "part", PKEY, _d("e", lambda: S.erf(c("p_size") / 25), _ERF, 6), _d("ec", lambda: S.erfc(c("p_size") / 25), f"1 - {_ERF}", 6), _d("inv", lambda: S.erfinv(_erf_terms(c("p_size") / 50)), "p_size / 50.0", 6))
rowwise("bessel_first_kind", "part", PKEY, _d("j0", lambda: S.j0(c("p_size") / 10), _sql_series("(p_size / 20.0)", "(CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * pow(@, 2 * k) / pow(gamma(k + 1), 2)", 30), 6), _d("j1", lambda: S.j1(c("p_size") / 10), _sql_series("(p_size / 20.0)", "(CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * pow(@, 2 * k + 1) / (gamma(k + 1) * gamma(k + 2))", 30), 6), _d("far", lambda: S.j0(c("p_size") + 40.0), "list_sum(list_transform(range(400), lambda t: cos((p_size + 40.0) * sin((t + 0.5) * pi() / 400)))) / 400", 6), _d("i0", lambda: S.i0(c("p_size") / 10), _sql_series("(p_size / 20.0)", "pow(@, 2 * k) / pow(gamma(k + 1), 2)", 40), 5))
rowwise("digamma_zeta", "part", PKEY, _d("d", lambda: S.digamma(c("p_size")), "-0.5772156649015329 + list_sum(list_transform(range(1, 60), lambda k: CASE WHEN k < p_size THEN 1.0 / k ELSE 0 END))", 6), _d("z", lambda: S.zeta(c("p_size") % 5 + 2), "list_sum(list_transform(range(1, 2000), lambda k: pow(k, -(p_size % 5 + 2.0)))) + pow(1999.5, -(p_size % 5 + 1.0)) / (p_size % 5 + 1.0)", 6))
rowwise("float_steps", "part", PKEY, _d("up", lambda: (S.nextafter(c("p_retailprice"), F.lit(1e9)) - c("p_retailprice")) * 2**43, "pow(2, floor(log2(p_retailprice)) - 9)", 6), _d("s", lambda: S.spacing(c("p_retailprice")) * 2**43, "pow(2, floor(log2(p_retailprice)) - 9)", 6), _d("down", lambda: E.true_divide(S.spacing(F.lit(1.0)), F.lit(2.0**-52)), "1.0"))
rowwise("emath_power_arccos", "customer", CKEY, _d("re", lambda: Z.emath_power(c("c_acctbal") / 1000, 2.0)["re"], "pow(c_acctbal / 1000, 2)", 6), _d("root", lambda: Z.emath_power(c("c_acctbal") / 1000, 0.5)["im"], "CASE WHEN c_acctbal < 0 THEN sqrt(-c_acctbal / 1000) ELSE 0 END", 6), _d("ac", lambda: Z.emath_arccos(c("c_acctbal") / 1000)["re"], "CASE WHEN c_acctbal > 1000 THEN 0 WHEN c_acctbal < -1000 THEN pi() ELSE acos(greatest(-1.0, least(1.0, c_acctbal / 1000))) END", 6))


@query("SELECT c_custkey, round(c_acctbal, 2) AS v, round(-2.0, 2) AS conj FROM customer")
def real_if_close(spark, sf):
    z = table(spark, sf, "customer").select("c_custkey", Z.make(c("c_acctbal"), 1e-18).alias("v"), Z.imag(Z.conjugate(Z.make(1.0, 2.0))).alias("conj"))
    return Z.real_if_close(z, "v").select("c_custkey", F.round("v", 2).alias("v"), F.round("conj", 2).alias("conj"))


# --- files: written, read again, and compared with the table ---------------------------------------------


def _folder(spark, name: str) -> str:
    """A new folder in the warehouse, which all executors share."""
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/arrays/{name}-{uuid.uuid4().hex}"


def _read_back(name: str, f: Callable[..., NdFrame], sql: str, digits: int = 2) -> None:
    def run(spark, sf):
        out = f(spark, _orders(spark, sf), _folder(spark, name))
        return out.df.select(*out.idx, F.round("v", digits).alias("v"))

    QUERIES[name], ORACLES[name] = run, sql.replace("@", _NUMBERED).replace("#n", _N)


_VECTOR = "SELECT CAST(i AS BIGINT) AS i0, round(o_totalprice, 2) AS v FROM @"


def _after(write: Callable, read: Callable):
    write()
    return read()


_read_back("npy_file", lambda spark, a, path: _after(lambda: binary.save(a, f"{path}/a.npy"), lambda: binary.load(spark, f"{path}/a.npy")), _VECTOR)
_read_back("npz_file", lambda spark, a, path: _after(lambda: binary.savez(spark, f"{path}/a.npz", a, second=shape.flip(a)), lambda: (lambda z: joining.vstack([z["arr_0"], z["second"]]))(binary.loadz(spark, f"{path}/a.npz"))), "SELECT CAST(0 AS BIGINT) AS i0, CAST(i AS BIGINT) AS i1, round(o_totalprice, 2) AS v FROM @ UNION ALL SELECT 1, CAST(#n - 1 - i AS BIGINT), round(o_totalprice, 2) FROM @")
_read_back("raw_file", lambda spark, a, path: _after(lambda: binary.tofile(a, f"{path}/a.bin"), lambda: binary.fromfile(spark, f"{path}/a.bin", "float64", a.size - 5, 16)), "SELECT CAST(i - 2 AS BIGINT) AS i0, round(o_totalprice, 2) AS v FROM @ WHERE i >= 2 AND i < #n - 3")
_read_back("memmap_file", lambda spark, a, path: _after(lambda: binary.tofile(a, f"{path}/a.bin"), lambda: binary.memmap(spark, f"{path}/a.bin", (a.size // 10, 10))), f"SELECT CAST(r AS BIGINT) AS i0, CAST(k AS BIGINT) AS i1, round(p, 2) AS v FROM {_M}")
_read_back("text_file", lambda spark, a, path: _after(lambda: text.savetxt(shape.reshape(a, (a.size // 10, 10)), path, ";", "%.2f"), lambda: text.loadtxt(spark, path, ";")), f"SELECT CAST(r AS BIGINT) AS i0, CAST(k AS BIGINT) AS i1, round(p, 2) AS v FROM {_M}")
_read_back("text_with_holes", lambda spark, a, path: _after(lambda: text.text_lines(shape.reshape(a, (a.size // 10, 10)), ",", "%.2f").orderBy("i0").select(F.regexp_replace("value", "^[^,]*", "N/A").alias("value")).coalesce(1).write.text(path), lambda: text.genfromtxt(spark, path, ",", 2).map(lambda v: E.nan_to_num(v, -1.0))), f"SELECT CAST(r - 2 AS BIGINT) AS i0, CAST(k AS BIGINT) AS i1, CASE WHEN k = 0 THEN -1 ELSE round(p, 2) END AS v FROM {_M} WHERE r >= 2")


@query("SELECT CAST(n_nationkey AS BIGINT) AS i0, CAST(n_nationkey AS DOUBLE) AS f0, CAST(n_regionkey AS DOUBLE) AS f1 FROM nation")
def record_file(spark, sf):
    path = _folder(spark, "records")
    text.savetxt(from_columns(table(spark, sf, "nation"), ["n_nationkey", "n_regionkey"], c("n_nationkey")), path, ",", "%d")
    return text.recfromtxt(spark, path, ",").select("i0", "record.f0", "record.f1")


@query("SELECT string_agg(CAST(n_regionkey AS VARCHAR) || '.0', chr(10) ORDER BY n_nationkey) AS csv, CAST(sum(n_regionkey) AS DOUBLE) AS total, CAST(count(*) * 8 AS BIGINT) AS bytes FROM nation")
def to_text_and_bytes(spark, sf):
    a = from_column(table(spark, sf, "nation"), c("n_regionkey").cast("double"), c("n_nationkey"))
    return spark.createDataFrame([(text.array_to_csv(a), float(sum(a.tolist())), len(a.tobytes()))], "csv string, total double, bytes long")


@query("SELECT CAST(i AS BIGINT) AS i0, CAST(i * i AS DOUBLE) / 8 AS v FROM range(200) t(i)")
def buffers(spark, sf):
    """A buffer read as numbers, swapped to the other byte order and back, through half precision patterns and back."""
    a = binary.frombuffer(spark, (np.arange(200.0) ** 2 / 8).tobytes())
    twice = binary.newbyteorder(binary.newbyteorder(a))
    halves = twice.df.select("i0", binary.half_to_float(binary.float_to_half(c("v") / 4096)).alias("h"), "v")
    return halves.select("i0", F.when(F.abs(c("h") * 4096 - c("v")) <= c("v") / 1000 + 0.01, c("v")).alias("v"))


@query("SELECT c_custkey, CAST(c_custkey * 3 AS BIGINT) AS first, CAST(c_custkey % 100 AS INTEGER) AS second FROM customer")
def byte_fields(spark, sf):
    """Fields set in binary records and read from them."""
    raw = checks.setfield(checks.setfield(F.unhex(F.lit("00" * 12)), c("c_custkey") * 3, "int64", 0), c("c_custkey") % 100, "int32", 8)
    rows = table(spark, sf, "customer").select("c_custkey", raw.alias("first"), raw.alias("second"))
    return binary.getfield(binary.getfield(rows, "first", "int64", 0), "second", "int32", 8)


# --- types, scalars, records, dates, masks ------------------------------------------------------------------

_TYPES = {
    "kind": (meta.kind("uint16"), "u"), "itemsize": (str(meta.itemsize("complex128")), "16"), "dtype": (meta.dtype("int32").char, "i"), "cast": (str(meta.can_cast("int64", "float32")), "False"), "same kind": (str(meta.can_cast("float64", "float32", "same_kind")), "True"),
    "promote": (meta.promote("int8", "uint8"), "int16"), "result": (meta.promote("int64", "float32"), "float64"), "common": (meta.common_type("int8", "float32"), "float64"), "least": (meta.min_scalar_type(3.5), "float16"),
    "eps": (repr(meta.finfo("float64")["eps"]), "2.220446049250313e-16"), "greatest": (repr(meta.finfo("float32")["max"]), "3.4028234663852886e+38"), "whole": (str(meta.iinfo("int16")), "(-32768, 32767)"), "complex": (str(meta.iscomplex("complex64")), "True"),
    "shapes": (str(meta.broadcast_shapes((3, 1), (4,))), "(3, 4)"), "can": (str(meta.can_broadcast((3, 2), (4,))), "False"), "scalar": (str(checks.isscalar(3)), "True"), "evaluated": (repr(T.safe_eval("0x1f")), "31.0"),
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{name}', '{want}')" for name, (_, want) in _TYPES.items()) + ") t(name, value)")
def type_rules(spark, sf):
    return spark.createDataFrame([(name, found) for name, (found, _) in _TYPES.items()], "name string, value string")


@query(f"SELECT CAST(count(*) AS BIGINT) AS size, CAST(2 AS BIGINT) AS ndim, CAST(8 AS BIGINT) AS itemsize, CAST(count(*) * 8 AS BIGINT) AS nbytes, CAST(10 AS BIGINT) AS stride, round(max(p) FILTER (r = 3 AND k = 4), 2) AS item, round(max(p) FILTER (r = 3 AND k = 4), 2) AS flat, -7.0 AS new, CAST(max(CAST(trunc(p) AS BIGINT)) FILTER (r = 0 AND k = 1) AS BIGINT) AS whole FROM {_MAT}")
def cells_and_facts(spark, sf):
    m = _matrix10(spark, sf)
    changed = m.with_item((3, 4), -7.0)
    whole = checks.require(m, "int64", "CA").item(0, 1)
    row = (m.size, m.ndim, meta.itemsize(m.dtype), m.nbytes, m.strides[0], round(m.item(3, 4), 2), round(checks.view(m).item(34), 2), changed.item(3, 4), whole)
    return spark.createDataFrame([row], "size long, ndim long, itemsize long, nbytes long, stride long, item double, flat double, new double, whole long")


@query(f"SELECT CAST(i AS BIGINT) AS i0, CAST(trunc(o_totalprice) AS BIGINT) AS whole, CAST(o_totalprice AS FLOAT)::DOUBLE AS single, (CAST(trunc(o_totalprice) AS BIGINT) % 256) AS byte, o_totalprice > 0 AS truth FROM {_NUMBERED}")
def astype(spark, sf):
    a = _orders(spark, sf)
    parts = {"whole": a.astype("int64").df, "single": a.astype("float32").df.withColumn("v", c("v").cast("double")), "byte": a.astype("uint8").df.withColumn("v", c("v").cast("long")), "truth": a.astype("bool").df}
    return functools.reduce(lambda x, y: x.join(y, "i0"), [df.withColumnRenamed("v", name) for name, df in parts.items()])


_KIND = records.struct_dtype({"identifier": "int64", "score": "float64", "flag": "int8"})


@query("SELECT CAST(17 AS BIGINT) AS itemsize, CAST(3 AS BIGINT) AS nfields, 'identifier,score,flag' AS names, CAST(16 AS BIGINT) AS at, CAST(1 AS BIGINT) AS place, CAST(max(c_custkey) FILTER (n = 3) AS DOUBLE) AS identifier, 9.5 AS score FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS n FROM customer)")
def record_types(spark, sf):
    rows = ordered.positions(table(spark, sf, "customer").select(records.make(identifier=c("c_custkey"), score=c("c_acctbal")).alias("r"), c("c_custkey").alias("k")), c("k"))
    n = rows.count()
    one = records.get_record(records.set_record(rows, "r", "i0", 3, score=9.5), "r", "i0", 3 - n, n)
    return one.select(F.lit(records.struct_itemsize(_KIND)).cast("long").alias("itemsize"), F.lit(len(records.field_names(_KIND))).cast("long").alias("nfields"), F.lit(",".join(records.field_names(_KIND))).alias("names"), F.lit(records.field_offsets(_KIND)["flag"]).cast("long").alias("at"), F.lit(records.find_field(_KIND, "score")).cast("long").alias("place"), "identifier", "score")


rowwise("datetime_from_time", "events", ("event_id", lambda: c("event_id"), "event_id"), _i("t", lambda: D.from_time(F.year("ts"), F.month("ts"), F.dayofmonth("ts"), F.hour("ts"), F.minute("ts"), F.second("ts"), "s"), "epoch_us(ts) // 1000000"), ("past", lambda: D.now("s") > D.from_timestamp(c("ts"), "s"), "ts < now()::TIMESTAMP"))
rowwise("masked_not_equal", "customer", CKEY, _d("n", lambda: K.masked_not_equal(c("c_custkey") % 2, 0.0, -1.0).filled(), "CASE WHEN c_custkey % 2 <> 0 THEN -1 ELSE 0 END"), _d("w", lambda: K.masked_equal(c("c_acctbal"), 0.0, -1.0).with_mask(c("c_acctbal") > 0).filled(), "CASE WHEN c_acctbal > 0 THEN -1 ELSE c_acctbal END"))


@query("SELECT CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS i0, round(c_acctbal, 2) AS v FROM customer WHERE c_acctbal >= 0")
def masked_compressed(spark, sf):
    return K.masked_less(c("c_acctbal"), 0.0).compressed(table(spark, sf, "customer"), c("c_custkey")).select("i0", F.round("v", 2).alias("v"))


@query("SELECT CAST(r_regionkey AS BIGINT) AS i0, CAST(r_regionkey * 2 + 10 AS DOUBLE) AS v, '[0. 1. 2. 3. 4.]' AS text FROM region")
def iterate_and_print(spark, sf):
    a = from_column(table(spark, sf, "region"), c("r_regionkey").cast("double"), c("r_regionkey"))
    pairs = checks.MultiIter(a, a.map(lambda v: v + 10))
    rows = [(int(place[0]), float(x + y)) for (place, _), (x, y) in zip(indexing.ndenumerate(a), pairs, strict=True)]
    return spark.createDataFrame(rows, "i0 long, v double").withColumn("text", F.lit(printing.array2string(a)))


# --- callbacks, random numbers -----------------------------------------------------------------------------


@query(f"SELECT CAST(0 AS BIGINT) AS i0, CAST(k AS BIGINT) AS i1, round(max(p), 2) AS v FROM {_MAT} GROUP BY k")
def apply_over_axes(spark, sf):
    return apply.apply_over_axes(np.max, [0], _matrix10(spark, sf)).df.select("i0", "i1", F.round("v", 2).alias("v"))


rowwise("frompyfunc", "orders", ("o_orderkey", lambda: c("o_orderkey"), "o_orderkey"), _d("v", lambda: apply.frompyfunc(lambda x: x % 1000)(c("o_totalprice")), "o_totalprice - floor(o_totalprice / 1000) * 1000", 2))

#: Fixed moments of the distributions: arguments, mean, variance.
_MOMENTS = {
    "normal": ((2.0, 3.0), 2.0, 9.0), "standard_normal": ((), 0.0, 1.0), "uniform": ((2.0, 5.0), 3.5, 0.75), "randint": ((2, 5), 3.0, 2 / 3), "integers": ((2, 4), 3.0, 2 / 3), "rand": ((), 0.5, 1 / 12), "randn": ((), 0.0, 1.0),
    "exponential": ((2.0,), 2.0, 4.0), "rayleigh": ((1.0,), math.sqrt(math.pi / 2), 2 - math.pi / 2), "weibull": ((2.0,), math.gamma(1.5), 1 - math.gamma(1.5) ** 2), "laplace": ((1.0, 1.0), 1.0, 2.0), "logistic": ((1.0, 1.0), 1.0, math.pi**2 / 3),
    "gumbel": ((0.0, 1.0), 0.5772156649, math.pi**2 / 6), "geometric": ((0.3,), 1 / 0.3, 0.7 / 0.09), "triangular": ((0.0, 1.0, 2.0), 1.0, 1 / 6), "power": ((2.0,), 2 / 3, 1 / 18), "pareto": ((9.0,), 1 / 8, 9 / (64 * 7)),
    "gamma": ((2.0, 1.0), 2.0, 2.0), "beta": ((2.0, 3.0), 0.4, 0.04), "chisquare": ((3.0,), 3.0, 6.0), "standard_t": ((9.0,), 0.0, 9 / 7), "f": ((5.0, 20.0), 20 / 18, 2 * 400 * 23 / (5 * 324 * 16)), "noncentral_chisquare": ((3.0, 1.0), 4.0, 10.0),
    "wald": ((1.0, 2.0), 1.0, 0.5), "binomial": ((10, 0.3), 3.0, 2.1), "negative_binomial": ((3.0, 0.4), 4.5, 11.25), "hypergeometric": ((10, 8, 5), 50 / 18, 5 * 80 * 13 / (324 * 17)), "poisson": ((3.0,), 3.0, 3.0), "logseries": ((0.5,), 1.4426950409, 0.8040211),
}
_DRAWN = 40_000


def _drawn(spark, name: str, args: tuple) -> NdFrame:
    shape_ = (_DRAWN,)
    direct = {"normal": random.normal, "standard_normal": random.standard_normal, "uniform": random.uniform, "randint": random.randint, "integers": random.integers}
    if name in direct:
        return direct[name](spark, *args, shape_)
    if name in ("rand", "randn"):
        return (random.matlib_rand if name == "rand" else random.matlib_randn)(spark, 200, _DRAWN // 200)
    if name in random.SAMPLERS:
        return random.sample(spark, name, shape_, *args)
    return random.inverse(spark, name, shape_, *args)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{name}', true, true)" for name in _MOMENTS) + ") t(name, mean, variance)")
def random_moments(spark, sf):
    """Mean and variance of many draws within five and eight standard errors of the distribution's own."""
    out = None
    for name, (args, mean, variance) in _MOMENTS.items():
        v = c("v").cast("double")
        near = F.abs(F.avg(v) - mean) <= 5 * math.sqrt(variance / _DRAWN)
        wide = F.abs(F.var_pop(v) / variance - 1) <= 8 * F.sqrt((F.avg(F.pow(v - mean, F.lit(4.0))) / variance**2 - 1) / _DRAWN)
        one = _drawn(spark, name, args).df.agg(F.lit(name).alias("name"), near.alias("mean"), wide.alias("variance"))
        out = one if out is None else out.union(one)
    return out


@query("SELECT 'cauchy' AS name, true AS inside UNION ALL SELECT 'vonmises', true UNION ALL SELECT 'zipf', true UNION ALL SELECT 'noncentral_f', true UNION ALL SELECT 'dirichlet', true UNION ALL SELECT 'multinomial', true UNION ALL SELECT 'multivariate_normal', true UNION ALL SELECT 'seed', true UNION ALL SELECT 'shuffle', true UNION ALL SELECT 'bytes', true")
def random_shapes(spark, sf):
    """What is known of draws without a variance, of joint ones, and of the seed."""
    n = 20_000
    q = lambda a, p: a.df.agg(F.percentile(c("v").cast("double"), F.lit(p))).first()[0]
    cauchy = random.inverse(spark, "standard_cauchy", (n,))
    rows = random.dirichlet(spark, [1.0, 2.0, 3.0], 3000)
    counts = random.multinomial(spark, 20, [0.2, 0.3, 0.5], 3000)
    joint = random.multivariate_normal(spark, [0.0, 1.0], [[2.0, 1.0], [1.0, 2.0]], 8000)
    pairs = joint.df.groupBy("i0").pivot("i1", [0, 1]).agg(F.first("v"))
    a = creation.arange(spark, 0, 500)
    random.random_seed(7)
    one, two = random.random(spark, (50,)).tolist(), random.random(spark, (50,)).tolist()
    mixed = random.permutation(a).tolist()
    random.random_seed(12345)
    other = random.random(spark, (50,)).tolist()
    found = {
        "cauchy": abs(q(cauchy, 0.75) - 1) < 0.08 and abs(q(cauchy, 0.5)) < 0.05,
        "vonmises": random.sample(spark, "vonmises", (n,), 0.0, 2.0).df.agg(F.max(F.abs("v")) <= math.pi).first()[0],
        "zipf": abs(random.sample(spark, "zipf", (n,), 3.0).df.agg(F.avg((c("v") == 1).cast("double"))).first()[0] - 1 / 1.2020569) < 0.02,
        "noncentral_f": abs(random.sample(spark, "noncentral_f", (n,), 3.0, 25.0, 1.0).df.agg(F.avg("v")).first()[0] - 25 * 4 / (3 * 23)) < 0.1,
        "dirichlet": rows.df.groupBy("i0").agg(F.sum("v").alias("s")).agg(F.max(F.abs(c("s") - 1)) < 1e-9).first()[0],
        "multinomial": counts.df.groupBy("i0").agg(F.sum("v").alias("s")).agg((F.min("s") == 20) & (F.max("s") == 20)).first()[0],
        "multivariate_normal": abs(pairs.agg(F.covar_pop("0", "1")).first()[0] - 1) < 0.15,
        "seed": one == two != other,
        "shuffle": mixed != a.tolist() and sorted(mixed) == a.tolist(),
        "bytes": len(random.random_bytes(33)) == 33 and random.random_bytes(8, 1) == random.random_bytes(8, 1),
    }
    return spark.createDataFrame([(k, bool(v)) for k, v in found.items()], "name string, inside boolean")


# --- relational forms ---------------------------------------------------------------------------------------


@query("SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))")
def grouping_sets(spark, sf):
    return table(spark, sf, "orders").groupingSets([[c("o_orderstatus")], [c("o_orderpriority")]], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")).select("o_orderstatus", "o_orderpriority", "n")


@query("SELECT * FROM (SELECT 'union' AS op, k FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT user_id FROM events) UNION ALL SELECT 'intersect', k FROM (SELECT o_custkey AS k FROM orders INTERSECT ALL SELECT user_id FROM events) UNION ALL SELECT 'except', k FROM (SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT user_id FROM events))")
def set_forms_all(spark, sf):
    a, b = table(spark, sf, "orders").select(c("o_custkey").alias("k")), table(spark, sf, "events").select(c("user_id").alias("k"))
    parts = {"union": a.union(b), "intersect": a.intersectAll(b), "except": a.exceptAll(b)}
    return functools.reduce(DataFrame.union, [df.select(F.lit(op).alias("op"), "k") for op, df in parts.items()])


@query("SELECT o_orderstatus, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers, CAST(count(DISTINCT (o_custkey, o_orderpriority)) AS BIGINT) AS pairs, true AS near FROM orders GROUP BY o_orderstatus")
def distinct_aggregates(spark, sf):
    near = F.abs(F.approx_count_distinct("o_custkey", 0.02) / F.countDistinct("o_custkey") - 1) < 0.1
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.countDistinct("o_custkey").alias("customers"), F.countDistinct("o_custkey", "o_orderpriority").alias("pairs"), near.alias("near"))


@query("SELECT o_orderkey, CAST(rank() OVER w AS INTEGER) AS r, CAST(dense_rank() OVER w AS INTEGER) AS d, CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS INTEGER) AS n, round(percent_rank() OVER w, 6) AS p FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
def ranking_windows(spark, sf):
    w, line = Window.partitionBy("o_custkey").orderBy("o_orderpriority"), Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"), F.ntile(4).over(line).alias("n"), F.round(F.percent_rank().over(w), 6).alias("p"))


rowwise("json_and_map", "events", ("event_id", lambda: c("event_id"), "event_id"), _i("k", lambda: F.get_json_object("props", "$.k"), "json_extract_string(props, '$.k')"), _i("n", lambda: F.size(F.from_json("props", "map<string,string>")), "len(json_keys(props))"), _s("type", lambda: F.get_json_object(F.to_json(F.struct(c("event_type").alias("t"))), "$.t"), "event_type"))


@query("SELECT window_start, window_start + INTERVAL 2 HOUR AS window_end, CAST(count(*) AS BIGINT) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * k AS window_start FROM events, range(2) t(k)) GROUP BY window_start")
def sliding_windows(spark, sf):
    return streams.sliding(table(spark, sf, "events"), "ts", "2 hours", "1 hour", "1 day", [], n=F.count("*"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT min(ts) AS window_start, max(ts) + INTERVAL 1 HOUR AS window_end, user_id, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k")
def session_windows(spark, sf):
    return streams.sessions(table(spark, sf, "events"), "ts", "1 hour", "1 day", ["user_id"], n=F.count("*"))
