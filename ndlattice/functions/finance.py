"""Time value of money in closed form; when is 1 for payments at the start of a period."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .elementwise import Value, col, real


def _growth(rate: Column, periods: Column) -> Column:
    return F.pow(1 + rate, periods)


def fv(rate: Value, nper: Value, pmt: Value, pv: Value, when: int = 0) -> Column:
    r, n, p, v = map(real, (rate, nper, pmt, pv))
    g = _growth(r, n)
    return F.when(r == 0, -(v + p * n)).otherwise(-(v * g + p * (1 + r * when) * F.try_divide(g - 1, r)))


def pv(rate: Value, nper: Value, pmt: Value, fv_value: Value = 0.0, when: int = 0) -> Column:
    r, n, p, f = map(real, (rate, nper, pmt, fv_value))
    g = _growth(r, n)
    return F.when(r == 0, -(f + p * n)).otherwise(-(f + p * (1 + r * when) * F.try_divide(g - 1, r)) / g)


def pmt(rate: Value, nper: Value, pv_value: Value, fv_value: Value = 0.0, when: int = 0) -> Column:
    r, n, v, f = map(real, (rate, nper, pv_value, fv_value))
    g = _growth(r, n)
    return F.when(r == 0, F.try_divide(-(f + v), n)).otherwise(F.try_divide(-(f + v * g) * r, (1 + r * when) * (g - 1)))


def nper(rate: Value, pmt_value: Value, pv_value: Value, fv_value: Value = 0.0, when: int = 0) -> Column:
    r, p, v, f = map(real, (rate, pmt_value, pv_value, fv_value))
    z = p * (1 + r * when)
    return F.when(r == 0, F.try_divide(-(f + v), p)).otherwise(F.try_divide(F.ln(F.try_divide(z - f * r, z + v * r)), F.ln(1 + r)))


def npv(rate: Value, value: Column, period: Column) -> Column:
    """Aggregate: values discounted by their periods, counted from 0."""
    return F.sum(real(value) / F.pow(1 + real(rate), period))


_STEPS, _NEAR = 100, 1e-12


def _newton(start: float, f, slope) -> Column:
    """Up to a hundred steps; null if they do not settle."""
    begin = F.struct(F.lit(start).alias("x"), F.lit(False).alias("done"))

    def step(s: Column, _: Column) -> Column:
        new = s.x - F.try_divide(f(s.x), slope(s.x))
        return F.when(s.done, s).otherwise(F.struct(new.alias("x"), F.coalesce(F.abs(new - s.x) < _NEAR, F.lit(False)).alias("done")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), begin, step, lambda s: F.when(s.done, s.x))


def rate(nper_value: Value, pmt_value: Value, pv_value: Value, fv_value: Value = 0.0, when: int = 0) -> Column:
    n, p, v, f = map(real, (nper_value, pmt_value, pv_value, fv_value))
    step = 1e-6

    def worth(r: Column) -> Column:
        g = _growth(r, n)
        return v * g + p * (1 + r * when) * F.coalesce(F.try_divide(g - 1, r), n) + f

    return _newton(0.1, worth, lambda r: (worth(r + step) - worth(r - step)) / (2 * step))


def irr(values: Column) -> Column:
    """Rate at which an array of values, one a period, is worth nothing; null without a change of sign."""
    worth = lambda r: F.aggregate(F.transform(values, lambda v, i: v / F.pow(1 + r, i)), F.lit(0.0), lambda a, x: a + x)
    slope = lambda r: F.aggregate(F.transform(values, lambda v, i: -col(i) * v / F.pow(1 + r, i + 1)), F.lit(0.0), lambda a, x: a + x)
    changes = F.exists(values, lambda v: v > 0) & F.exists(values, lambda v: v < 0)
    return F.when(changes, _newton(0.1, worth, slope))
