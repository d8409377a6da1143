"""Special functions.  Those without a closed form run as Arrow-batched pandas UDFs."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .elementwise import INF, NAN, Value, real


def vector_udf(f: Callable[..., np.ndarray]) -> Callable[..., Column]:
    """A Column function from one over float arrays."""
    @F.pandas_udf(DoubleType())
    def one(x: pd.Series) -> pd.Series:
        return pd.Series(f(x.to_numpy(float)))

    @F.pandas_udf(DoubleType())
    def two(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(f(x.to_numpy(float), y.to_numpy(float)))

    return lambda *a: (one if len(a) == 1 else two)(*map(real, a))


def _each(f: Callable[[float], float]) -> Callable[[np.ndarray], np.ndarray]:
    def safe(x: float) -> float:
        try:
            return f(x)
        except OverflowError:
            return INF
        except ValueError:
            return NAN

    return lambda x: np.array([safe(v) for v in x.tolist()], float)


def _bessel(order: int) -> Callable[[np.ndarray], np.ndarray]:
    """J_n(x): up to 30 the mean of cos(n t - x sin t) over a half turn, whose trapezium rule converges geometrically, beyond it the asymptotic series."""
    mu = 4.0 * order * order

    def near(x: np.ndarray) -> np.ndarray:
        t = (np.arange(128) + 0.5) * math.pi / 128
        return np.cos(order * t - x[:, None] * np.sin(t)).mean(1)

    def far(x: np.ndarray) -> np.ndarray:
        even, odd, term = np.ones_like(x), np.zeros_like(x), np.ones_like(x)
        for k in range(1, 13):
            term = term * (mu - (2 * k - 1) ** 2) / (k * 8 * x)
            sign = -1.0 if k % 4 in (2, 3) else 1.0
            if k % 2:
                odd = odd + sign * term
            else:
                even = even + sign * term
        turned = x - (order / 2 + 0.25) * math.pi
        return np.sqrt(2 / (math.pi * x)) * (even * np.cos(turned) - odd * np.sin(turned))

    def f(x: np.ndarray) -> np.ndarray:
        out, size = np.full(len(x), NAN), np.abs(x)
        out[np.isinf(x)] = 0.0
        for at in np.array_split(np.flatnonzero(size <= 30), max(1, len(x) // 4096)):
            out[at] = near(x[at])
        wide = (size > 30) & np.isfinite(x)
        out[wide] = far(size[wide]) * np.where((x[wide] < 0) & (order % 2 == 1), -1, 1)
        return out

    return f


def _digamma(x: np.ndarray) -> np.ndarray:
    """Recurrence up to 6, asymptotic series, reflection below 0; poles give NaN."""
    pole = (x <= 0) & (x == np.floor(x))
    y, shift = np.where(x < 0, 1 - x, x), np.zeros_like(x)
    y = np.where(pole, 1.0, y)
    while (low := y < 8).any():
        shift = np.where(low, shift - 1 / y, shift)
        y = np.where(low, y + 1, y)
    r = 1 / (y * y)
    out = shift + np.log(y) - 0.5 / y - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))
    out = np.where(x < 0, out - math.pi / np.tan(math.pi * np.where(pole, 0.5, x)), out)
    return np.where(pole, NAN, out)


def _zeta(s: float) -> float:
    """Riemann zeta by Euler-Maclaurin summation, the functional equation below 0."""
    if math.isnan(s):
        return NAN
    if s == 1:
        return INF
    if s < 0:
        return 0.0 if s % 2 == 0 else 2**s * math.pi ** (s - 1) * math.sin(math.pi * s / 2) * math.gamma(1 - s) * _zeta(1 - s)
    n = 20
    out = sum(k**-s for k in range(1, n)) + n ** (1 - s) / (s - 1) + n**-s / 2
    term, bernoulli = s * n ** (-s - 1), (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730)
    for j, b in enumerate(bernoulli, 1):
        out += b / math.factorial(2 * j) * term
        term *= (s + 2 * j - 1) * (s + 2 * j) / (n * n)
    return out


def _erfinv(y: float) -> float:
    if not -1 < y < 1:
        return math.copysign(INF, y) if abs(y) == 1 else NAN
    w = math.log1p(-y * y)
    a = 2 / (math.pi * 0.147) + w / 2
    x = math.copysign(math.sqrt(math.sqrt(a * a - w / 0.147) - a), y)
    for _ in range(4):
        error = math.erf(x) - y if abs(y) < 0.9 else math.copysign(math.erfc(-1 * -abs(x)) - (1 - abs(y)), -y)
        x -= error / (2 / math.sqrt(math.pi) * math.exp(-x * x))
    return x


def _gamma(x: float) -> float:
    return math.gamma(x) if x > 0 or x != math.floor(x) else NAN


i0 = vector_udf(np.i0)
j0 = vector_udf(_bessel(0))
j1 = vector_udf(_bessel(1))
gamma = vector_udf(_each(_gamma))
gammaln = vector_udf(_each(math.lgamma))
beta = vector_udf(lambda a, b: np.array([math.exp(math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)]))
digamma = vector_udf(_digamma)
zeta = vector_udf(_each(_zeta))
erf = vector_udf(_each(math.erf))
erfc = vector_udf(_each(math.erfc))
erfinv = vector_udf(_each(_erfinv))
nextafter = vector_udf(np.nextafter)
spacing = vector_udf(np.spacing)


def i0_series(x: Value, terms: int = 40) -> Column:
    """Modified Bessel function of order 0 as a JVM-side series, for arguments up to about 30."""
    q = F.pow(real(x) / 2, 2)
    start = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"))
    step = lambda s, k: F.struct((s["sum"] + s.term * q / (k * k)).alias("sum"), (s.term * q / (k * k)).alias("term"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step, lambda s: s["sum"])
