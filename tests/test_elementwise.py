"""Expressions against NumPy over edge values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ndlattice.functions import elementwise as E
from ndlattice.functions import special as S

EDGES = [math.nan, math.inf, -math.inf, 0.0, -0.0, 1.25, -2.5, 3.0, 7.0, -7.0, 0.5, 1e10]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(float(a), float(b)) for a in EDGES for b in EDGES], "a double, b double").coalesce(1).cache()


def check(rows, expected, rtol=1e-12):
    got = np.array([np.nan if r is None else r for r in rows], float)
    assert not any(r is None for r in rows)
    np.testing.assert_allclose(got, np.asarray(expected, float), rtol=rtol, atol=1e-300)


A = np.array([a for a in EDGES for b in EDGES])
B = np.array([b for a in EDGES for b in EDGES])
TWO = {
    "divide": np.divide, "fmod": np.fmod, "mod": np.mod, "maximum": np.maximum, "minimum": np.minimum, "fmax": np.fmax, "fmin": np.fmin,
    "equal": np.equal, "less": np.less, "less_equal": np.less_equal, "greater": np.greater, "greater_equal": np.greater_equal, "not_equal": np.not_equal,
    "logical_and": np.logical_and, "logical_or": np.logical_or, "logical_xor": np.logical_xor, "copysign": np.copysign, "heaviside": np.heaviside,
    "hypot": np.hypot, "arctan2": np.arctan2, "isclose": np.isclose,
}
ONE = {
    "signbit": np.signbit, "sign": np.sign, "fabs": np.fabs, "sqrt": np.sqrt, "cbrt": np.cbrt, "square": np.square, "floor": np.floor, "ceil": np.ceil, "trunc": np.trunc, "rint": np.rint,
    "isnan": np.isnan, "isinf": np.isinf, "isfinite": np.isfinite, "logical_not": np.logical_not, "nan_to_num": np.nan_to_num, "reciprocal": np.reciprocal,
    "sin": np.sin, "cos": np.cos, "arcsin": np.arcsin, "arccos": np.arccos, "arctan": np.arctan, "sinh": np.sinh, "tanh": np.tanh, "arcsinh": np.arcsinh, "arccosh": np.arccosh, "arctanh": np.arctanh,
    "exp": np.exp, "exp2": np.exp2, "expm1": np.expm1, "log": np.log, "log2": np.log2, "log10": np.log10, "log1p": np.log1p, "degrees": np.degrees, "radians": np.radians, "sinc": np.sinc,
}


@pytest.mark.filterwarnings("ignore")
def test_two_operands(spark, pairs):
    got = pairs.select(*(getattr(E, n)(F.col("a"), F.col("b")).cast("double").alias(n) for n in TWO)).collect()
    for n, f in TWO.items():
        check([r[n] for r in got], f(A, B).astype(float))


@pytest.mark.filterwarnings("ignore")
def test_one_operand(spark, pairs):
    got = pairs.select(*(getattr(E, n)(F.col("a")).cast("double").alias(n) for n in ONE)).collect()
    for n, f in ONE.items():
        # libraries reduce huge angles and round roots differently in the last digits
        check([r[n] for r in got], f(A).astype(float), 1e-9)


def test_floor_divide(spark, pairs):
    fine = np.isfinite(A) & np.isfinite(B) & (B != 0)
    got = [r[0] for r in pairs.select(E.floor_divide(F.col("a"), F.col("b"))).collect()]
    np.testing.assert_array_equal(np.array(got, float)[fine], np.floor_divide(A[fine], B[fine]))


def test_integers(spark):
    values = [-7, -1, 0, 1, 3, 8, 12]
    df = spark.createDataFrame([(a, b) for a in values for b in values], "a long, b long")
    a, b = F.col("a"), F.col("b")
    rows = df.select("a", "b", E.int_floor_divide(a, b).alias("q"), E.int_mod(a, b).alias("r"), E.gcd(a, b).alias("g"), E.lcm(a, b).alias("l"), E.left_shift(a, b).alias("ls"), E.right_shift(a, b).alias("rs"), E.bitwise_and(a, b).alias("and"), E.bitwise_count(a).alias("bc"), E.int_power(a, 3).alias("p")).collect()
    for r in rows:
        x, y = r["a"], r["b"]
        assert r["q"] == (x // y if y else 0) and r["r"] == (x % y if y else 0)
        assert r["g"] == math.gcd(x, y) and r["l"] == math.lcm(x, y)
        assert r["ls"] == (x << y if y >= 0 else 0) and r["rs"] == (x >> y if y >= 0 else -1 if x < 0 else 0)
        assert r["and"] == x & y and r["bc"] == abs(x).bit_count() and r["p"] == x**3
    assert df.select(E.left_shift(F.lit(1), F.lit(70))).first()[0] == 0
    assert [r[0] for r in spark.createDataFrame([(300,), (-129,), (127,)], "a long").select(E.cast_wrapping(F.col("a"), 8)).collect()] == [44, 127, 127]


def test_rounding_and_parts(spark):
    values = [2.5, -2.5, 3.5, 0.1, -7.75, 1024.0, 1e-3]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    x = F.col("x")
    rows = df.select(E.around(x, 1).alias("r"), E.modf(x).alias("m"), E.frexp(x).alias("f"), E.ldexp(x, F.lit(3)).alias("l"), E.clip(x, -1, 3).alias("c")).collect()
    for v, r in zip(values, rows, strict=True):
        assert r["r"] == np.around(v, 1) and r["l"] == v * 8 and r["c"] == np.clip(v, -1, 3)
        assert (r["m"]["fraction"], r["m"]["integral"]) == math.modf(v)
        assert (r["f"]["mantissa"], r["f"]["exponent"]) == math.frexp(v)


def test_choices(spark):
    df = spark.range(6).withColumn("x", F.col("id").cast("double"))
    x = F.col("x")
    rows = df.select(E.select([x < 2, x < 4], [x * 10, x * 100], -1.0).alias("s"), E.piecewise(x, [x < 4, x < 2], [lambda v: v + 1, lambda v: v - 1]).alias("p"), E.choose(F.col("id"), [F.lit(5), F.lit(6)], "clip").alias("c")).collect()
    assert [r["s"] for r in rows] == [0, 10, 200, 300, -1, -1]
    assert [r["p"] for r in rows] == [-1, 0, 3, 4, 0, 0]
    assert [r["c"] for r in rows] == [5, 6, 6, 6, 6, 6]


def test_special(spark):
    xs = [0.1, 0.5, 0.9, 1.0, 2.5, 5.0, 12.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1)
    x = F.col("x")
    rows = df.select(S.i0(x).alias("i0"), S.i0_series(x).alias("i0s"), S.j0(x).alias("j0"), S.j1(x).alias("j1"), S.gamma(x).alias("g"), S.gammaln(x).alias("gl"), S.digamma(x).alias("d"), S.zeta(x).alias("z"), S.erf(x).alias("e"), S.erfinv(x / 13).alias("ei"), E.comb(F.lit(10), F.lit(3)).alias("c"), E.perm(F.lit(10), F.lit(3)).alias("p"), E.factorial(F.lit(5)).alias("f")).collect()
    for v, r in zip(xs, rows, strict=True):
        assert r["i0"] == pytest.approx(np.i0(v)) and r["i0s"] == pytest.approx(np.i0(v))
        assert r["g"] == pytest.approx(math.gamma(v)) and r["gl"] == pytest.approx(math.lgamma(v)) and r["e"] == pytest.approx(math.erf(v))
        assert math.erf(r["ei"]) == pytest.approx(v / 13, rel=1e-12)
        h = 1e-6
        assert r["d"] == pytest.approx((math.lgamma(v + h) - math.lgamma(v - h)) / (2 * h), rel=1e-5)
        assert r["c"] == 120 and r["p"] == 720 and r["f"] == 120
    assert rows[4]["j0"] == pytest.approx(-0.04838377646819798) and rows[3]["j1"] == pytest.approx(0.44005058574493355)
    assert rows[4]["z"] == pytest.approx(1.3414872572509171) and math.isinf(rows[3]["z"])
