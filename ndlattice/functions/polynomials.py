"""Polynomials and orthogonal series.

Coefficients are short and live on the driver; evaluation is a Column expression, fitting one
aggregation of moments.  ``poly*`` functions take the highest power first, series the lowest.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from numpy.polynomial import chebyshev, hermite, laguerre, legendre
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Coefficients = Sequence[float]
BASES = {"cheb": chebyshev, "leg": legendre, "herm": hermite, "lag": laguerre}


def polyval(p: Coefficients, x: Column) -> Column:
    """Horner's rule, unrolled."""
    out = F.lit(0.0)
    for c in p:
        out = out * x + F.lit(float(c))
    return out


def series_terms(basis: str, degree: int, x: Column) -> list[Column]:
    """The basis functions up to a degree, by their three-term recurrence."""
    one = F.lit(1.0)
    first = {"cheb": x, "leg": x, "herm": 2 * x, "lag": 1 - x, "poly": x}[basis]
    out = [one, first]
    for n in range(1, degree):
        a, b = out[-1], out[-2]
        out.append({
            "cheb": lambda: 2 * x * a - b,
            "leg": lambda n=n: ((2 * n + 1) * x * a - n * b) / (n + 1),
            "herm": lambda n=n: 2 * x * a - 2 * n * b,
            "lag": lambda n=n: ((2 * n + 1 - x) * a - n * b) / (n + 1),
            "poly": lambda: x * a,
        }[basis]())
    return out[: degree + 1]


def series_value(basis: str, c: Coefficients, x: Column) -> Column:
    """Clenshaw's rule: from the highest term down, each partial sum is used once."""
    up, upper = F.lit(0.0), F.lit(0.0)
    for n in range(len(c) - 1, 0, -1):
        scale, shift = {
            "cheb": (2 * x, -1.0),
            "leg": ((2 * n + 1) / (n + 1) * x, -(n + 1) / (n + 2)),
            "herm": (2 * x, -2.0 * (n + 1)),
            "lag": ((2 * n + 1 - x) / (n + 1), -(n + 1) / (n + 2)),
        }[basis]
        up, upper = F.lit(float(c[n])) + scale * up + F.lit(shift) * upper, up
    first = {"cheb": x, "leg": x, "herm": 2 * x, "lag": 1 - x}[basis]
    after = {"cheb": -1.0, "leg": -0.5, "herm": -2.0, "lag": -0.5}[basis]
    return F.lit(float(c[0])) + first * up + F.lit(after) * upper


def chebval(x: Column, c: Coefficients) -> Column:
    return series_value("cheb", c, x)


def legval(x: Column, c: Coefficients) -> Column:
    return series_value("leg", c, x)


def hermval(x: Column, c: Coefficients) -> Column:
    return series_value("herm", c, x)


def lagval(x: Column, c: Coefficients) -> Column:
    return series_value("lag", c, x)


def fit(df: DataFrame, x: str, y: str, degree: int, basis: str = "poly") -> np.ndarray:
    """Least squares, lowest term first: one aggregation of the basis moments, solved on the driver."""
    terms = series_terms(basis, degree, F.col(x).cast("double"))[: degree + 1]
    v = F.col(y).cast("double")
    pairs = [(i, j) for i in range(degree + 1) for j in range(i, degree + 1)]
    row = df.agg(*(F.sum(terms[i] * terms[j]) for i, j in pairs), *(F.sum(t * v) for t in terms)).first()
    g = np.zeros((degree + 1, degree + 1))
    for (i, j), m in zip(pairs, row, strict=False):
        g[i, j] = g[j, i] = m
    scale = np.sqrt(np.diag(g))
    scale[scale == 0] = 1
    return np.linalg.lstsq(g / np.outer(scale, scale), np.array(row[len(pairs) :]) / scale, rcond=None)[0] / scale


def polyfit(df: DataFrame, x: str, y: str, degree: int) -> np.ndarray:
    return fit(df, x, y, degree)[::-1]


def chebfit(df: DataFrame, x: str, y: str, degree: int) -> np.ndarray:
    return fit(df, x, y, degree, "cheb")


def legfit(df: DataFrame, x: str, y: str, degree: int) -> np.ndarray:
    return fit(df, x, y, degree, "leg")


def hermfit(df: DataFrame, x: str, y: str, degree: int) -> np.ndarray:
    return fit(df, x, y, degree, "herm")


def lagfit(df: DataFrame, x: str, y: str, degree: int) -> np.ndarray:
    return fit(df, x, y, degree, "lag")


# --- coefficient arithmetic on the driver -----------------------------------------------------

polyadd, polysub, polymul, polydiv, polyder, polyint, poly, roots = np.polyadd, np.polysub, np.polymul, np.polydiv, np.polyder, np.polyint, np.poly, np.roots
polyfromroots, polyroots = np.polynomial.polynomial.polyfromroots, np.polynomial.polynomial.polyroots
chebadd, chebsub, chebmul, chebder, chebint = chebyshev.chebadd, chebyshev.chebsub, chebyshev.chebmul, chebyshev.chebder, chebyshev.chebint
legmul, legder, hermmul, hermder, lagmul, lagder = legendre.legmul, legendre.legder, hermite.hermmul, hermite.hermder, laguerre.lagmul, laguerre.lagder
cheb2poly, poly2cheb, leg2poly, poly2leg = chebyshev.cheb2poly, chebyshev.poly2cheb, legendre.leg2poly, legendre.poly2leg
