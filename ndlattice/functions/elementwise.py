"""Arithmetic, comparison and rounding with IEEE rules, whatever the session's ANSI setting.

Where Spark gives null or fails - division by zero, logarithms outside their domain, NaN in
comparisons, rounding to integers - a guard restores what a float array holds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")
Value = Column | float | int | bool


def col(x: Value) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def real(x: Value) -> Column:
    return col(x).cast("double")


# --- arithmetic -------------------------------------------------------------------------------


def add(a: Value, b: Value) -> Column:
    return col(a) + col(b)


def subtract(a: Value, b: Value) -> Column:
    return col(a) - col(b)


def multiply(a: Value, b: Value) -> Column:
    return col(a) * col(b)


def signbit(x: Value) -> Column:
    """True for negative numbers and -0.0; NaN has none."""
    x = real(x)
    return F.when(F.isnan(x), False).when(x == 0, x.cast("string").startswith("-")).otherwise(x < 0)


def divide(a: Value, b: Value) -> Column:
    """x/0 is an infinity of the joint sign, 0/0 and NaN/0 are NaN."""
    a, b = real(a), real(b)
    at_zero = F.when(F.isnan(a) | (a == 0), NAN).when(signbit(a) != signbit(b), -INF).otherwise(INF)
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


true_divide = divide


def fmod(a: Value, b: Value) -> Column:
    """Remainder with the dividend's sign; NaN by zero."""
    a, b = real(a), real(b)
    return F.when(b == 0, NAN).otherwise(F.try_mod(a, b))


def mod(a: Value, b: Value) -> Column:
    """Remainder with the divisor's sign; NaN by zero."""
    r, b = fmod(a, b), real(b)
    return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


remainder = mod


def floor_divide(a: Value, b: Value) -> Column:
    a, b = real(a), real(b)
    q = divide(a - mod(a, b), b)
    return F.when(b == 0, divide(a, b)).otherwise(F.when(q - floor(q) > 0.5, floor(q) + 1).otherwise(floor(q)))


def int_floor_divide(a: Value, b: Value) -> Column:
    """Of integers: 0 by zero."""
    a, b = col(a).cast("long"), col(b).cast("long")
    r = F.try_mod(a, b)
    return F.when(b == 0, F.lit(0).cast("long")).otherwise(F.call_function("div", a - r, F.nullif(b, F.lit(0))) - F.when((r != 0) & ((r < 0) != (b < 0)), 1).otherwise(0)).cast("long")


def int_mod(a: Value, b: Value) -> Column:
    """Of integers: divisor's sign, 0 by zero."""
    a, b = col(a).cast("long"), col(b).cast("long")
    r = F.try_mod(a, b)
    return F.when(b == 0, F.lit(0).cast("long")).when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


def divmod_(a: Value, b: Value) -> Column:
    return F.struct(floor_divide(a, b).alias("quotient"), mod(a, b).alias("remainder"))


def power(a: Value, b: Value) -> Column:
    return F.pow(real(a), real(b))


float_power = power


def int_power(a: Value, b: int) -> Column:
    """Of an integer by a driver-known exponent, exact as far as 64 bits go."""
    if b < 0:
        raise ValueError("integers to negative integer powers are not allowed")
    out, base = F.lit(1).cast("long"), col(a).cast("long")
    while b:
        if b & 1:
            out = out * base
        b >>= 1
        base = base * base if b else base
    return out


def negative(a: Value) -> Column:
    return -col(a)


def positive(a: Value) -> Column:
    return col(a)


def absolute(a: Value) -> Column:
    return F.abs(col(a))


def fabs(a: Value) -> Column:
    return F.abs(real(a))


def sign(a: Value) -> Column:
    return F.signum(real(a))


def reciprocal(a: Value) -> Column:
    return divide(1.0, a)


def sqrt(a: Value) -> Column:
    return F.sqrt(real(a))


def cbrt(a: Value) -> Column:
    return F.cbrt(real(a))


def square(a: Value) -> Column:
    return col(a) * col(a)


def _whole(x: Column) -> Column:
    """True where a double has no fraction or is no number."""
    return F.isnan(x) | (F.abs(x) >= float(1 << 52))


def floor(a: Value) -> Column:
    x = real(a)
    return F.when(_whole(x), x).otherwise(F.floor(x).cast("double"))


def ceil(a: Value) -> Column:
    x = real(a)
    return F.when(_whole(x), x).otherwise(F.ceil(x).cast("double"))


def trunc(a: Value) -> Column:
    x = real(a)
    return F.when(x < 0, ceil(x)).otherwise(floor(x))


fix = trunc


def rint(a: Value) -> Column:
    return F.rint(real(a))


def around(a: Value, decimals: int = 0) -> Column:
    """Half to even, as scaling, rounding and scaling back does it."""
    x = real(a)
    scale = 10.0 ** abs(decimals)
    return rint(x) if decimals == 0 else rint(x * scale) / scale if decimals > 0 else rint(x / scale) * scale


def heaviside(x: Value, at_zero: Value) -> Column:
    x = real(x)
    return F.when(F.isnan(x), x).when(x < 0, 0.0).when(x == 0, real(at_zero)).otherwise(1.0)


def gcd(a: Value, b: Value) -> Column:
    """Euclid's algorithm; 92 steps suffice for 64-bit numbers."""
    start = F.struct(F.abs(col(a).cast("long")).alias("a"), F.abs(col(b).cast("long")).alias("b"))
    step = lambda s, _: F.when(s.b == 0, s).otherwise(F.struct(s.b.alias("a"), F.try_mod(s.a, s.b).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s.a)


def lcm(a: Value, b: Value) -> Column:
    g = gcd(a, b)
    return F.when(g == 0, F.lit(0).cast("long")).otherwise(F.abs(int_floor_divide(a, g) * col(b).cast("long")))


def copysign(a: Value, b: Value) -> Column:
    size = F.abs(real(a))
    return F.when(signbit(b), -size).otherwise(size)


def ldexp(a: Value, e: Value) -> Column:
    """a times 2 to the e, in two steps so that the factor itself stays finite."""
    half = F.floor(col(e) / 2)
    return real(a) * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), col(e) - half)


def frexp(a: Value) -> Column:
    """Mantissa in [0.5, 1) and exponent."""
    x = real(a)
    odd = F.isnan(x) | (F.abs(x) == INF) | (x == 0)
    e = F.when(odd, 0).otherwise(F.floor(F.log2(F.abs(x))) + 1).cast("int")
    m = ldexp(x, -e)
    e = F.when(odd, 0).when(F.abs(m) >= 1, e + 1).when(F.abs(m) < 0.5, e - 1).otherwise(e).cast("int")
    return F.struct(F.when(odd, x).otherwise(ldexp(x, -e)).alias("mantissa"), e.alias("exponent"))


def modf(a: Value) -> Column:
    x = real(a)
    return F.struct(F.when(F.abs(x) == INF, 0.0).otherwise(x - trunc(x)).alias("fraction"), trunc(x).alias("integral"))


def clip(a: Value, low: Value, high: Value) -> Column:
    x = real(a)
    return F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, real(low)), real(high)))


def nan_to_num(a: Value, nan: float = 0.0, posinf: float = 1.7976931348623157e308, neginf: float = -1.7976931348623157e308) -> Column:
    x = real(a)
    return F.when(F.isnan(x), nan).when(x == INF, posinf).when(x == -INF, neginf).otherwise(x)


# --- bits -------------------------------------------------------------------------------------


def bitwise_and(a: Value, b: Value) -> Column:
    return col(a).bitwiseAND(col(b))


def bitwise_or(a: Value, b: Value) -> Column:
    return col(a).bitwiseOR(col(b))


def bitwise_xor(a: Value, b: Value) -> Column:
    return col(a).bitwiseXOR(col(b))


def bitwise_not(a: Value) -> Column:
    return F.bitwise_not(col(a))


invert = bitwise_not


def left_shift(a: Value, n: Value) -> Column:
    """0 for a count that is negative or beyond the width."""
    x, n = col(a).cast("long"), col(n)
    return F.when((n < 0) | (n >= 64), F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", x, n.cast("int")))


def right_shift(a: Value, n: Value) -> Column:
    """Beyond the width 0, all ones for a negative number."""
    x, n = col(a).cast("long"), col(n)
    return F.when((n < 0) | (n >= 64), F.when(x < 0, -1).otherwise(0).cast("long")).otherwise(F.call_function("shiftright", x, n.cast("int")))


def bitwise_count(a: Value) -> Column:
    """Ones of the magnitude."""
    return F.bit_count(F.abs(col(a)))


# --- comparison and logic ---------------------------------------------------------------------


def _numbers(a: Value, b: Value) -> tuple[Column, Column, Column]:
    a, b = real(a), real(b)
    return a, b, ~F.isnan(a) & ~F.isnan(b)


def equal(a: Value, b: Value) -> Column:
    a, b, both = _numbers(a, b)
    return both & (a == b)


def not_equal(a: Value, b: Value) -> Column:
    return ~equal(a, b)


def less(a: Value, b: Value) -> Column:
    a, b, both = _numbers(a, b)
    return both & (a < b)


def less_equal(a: Value, b: Value) -> Column:
    a, b, both = _numbers(a, b)
    return both & (a <= b)


def greater(a: Value, b: Value) -> Column:
    return less(b, a)


def greater_equal(a: Value, b: Value) -> Column:
    return less_equal(b, a)


def maximum(a: Value, b: Value) -> Column:
    a, b, both = _numbers(a, b)
    return F.when(~both, NAN).otherwise(F.greatest(a, b))


def minimum(a: Value, b: Value) -> Column:
    a, b, both = _numbers(a, b)
    return F.when(~both, NAN).otherwise(F.least(a, b))


def fmax(a: Value, b: Value) -> Column:
    a, b = real(a), real(b)
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b))


def fmin(a: Value, b: Value) -> Column:
    return F.least(real(a), real(b))  # NaN is Spark's largest number


def truth(a: Value) -> Column:
    """0 is false, every other number and NaN true."""
    return real(a) != 0


def logical_and(a: Value, b: Value) -> Column:
    return truth(a) & truth(b)


def logical_or(a: Value, b: Value) -> Column:
    return truth(a) | truth(b)


def logical_xor(a: Value, b: Value) -> Column:
    return truth(a) != truth(b)


def logical_not(a: Value) -> Column:
    return ~truth(a)


def isnan(a: Value) -> Column:
    return F.isnan(real(a))


def isinf(a: Value) -> Column:
    return F.abs(real(a)) == INF


def isfinite(a: Value) -> Column:
    return ~isnan(a) & ~isinf(a)


def isclose(a: Value, b: Value, rtol: float = 1e-5, atol: float = 1e-8, equal_nan: bool = False) -> Column:
    a, b, both = _numbers(a, b)
    near = F.when(isinf(a) | isinf(b), a == b).otherwise(F.abs(a - b) <= atol + rtol * F.abs(b))
    return both & near | (F.isnan(a) & F.isnan(b) if equal_nan else F.lit(False))


# --- choice -----------------------------------------------------------------------------------


def where(condition: Column, x: Value, y: Value) -> Column:
    return F.when(condition, col(x)).otherwise(col(y))


def select(conditions: Sequence[Column], choices: Sequence[Value], default: Value = 0) -> Column:
    """First true condition wins."""
    out = None
    for c, v in zip(conditions, choices, strict=True):
        out = F.when(c, col(v)) if out is None else out.when(c, col(v))
    return col(default) if out is None else out.otherwise(col(default))


def piecewise(x: Value, conditions: Sequence[Column], functions: Sequence[Callable[[Column], Value]], default: Value = 0.0) -> Column:
    """Last true condition wins."""
    return select(list(conditions)[::-1], [f(col(x)) for f in functions][::-1], default)


def choose(index: Value, choices: Sequence[Value], mode: str = "raise") -> Column:
    n, i = len(choices), col(index)
    if mode == "wrap":
        i = int_mod(i, n)
    elif mode == "clip":
        i = F.greatest(F.lit(0), F.least(i, F.lit(n - 1)))
    return F.element_at(F.array(*map(col, choices)), (i + 1).cast("int"))


# --- transcendental ---------------------------------------------------------------------------

sin, cos, tan, arcsin, arccos, arctan = (lambda a, f=f: f(real(a)) for f in (F.sin, F.cos, F.tan, F.asin, F.acos, F.atan))
sinh, cosh, tanh, arcsinh, arccosh = (lambda a, f=f: f(real(a)) for f in (F.sinh, F.cosh, F.tanh, F.asinh, F.acosh))
exp, expm1, degrees, radians = (lambda a, f=f: f(real(a)) for f in (F.exp, F.expm1, F.degrees, F.radians))
rad2deg, deg2rad = degrees, radians


def arctanh(a: Value) -> Column:
    x = real(a)
    return F.when(F.abs(x) == 1, F.when(x > 0, INF).otherwise(-INF)).when(F.abs(x) > 1, NAN).otherwise(F.atanh(x))


def arctan2(y: Value, x: Value) -> Column:
    """Keeps the sign of a zero y."""
    y, x = real(y), real(x)
    return F.when(F.isnan(x), x).when((y == 0) & signbit(y), F.when(signbit(x), -F.pi()).otherwise(F.lit(-0.0))).when((y == 0) & (x == 0) & signbit(x), F.pi()).otherwise(F.atan2(y, x))


def hypot(a: Value, b: Value) -> Column:
    return F.hypot(real(a), real(b))


def exp2(a: Value) -> Column:
    return F.pow(F.lit(2.0), real(a))


def _log(f: Callable[[Column], Column], a: Value, pole: float = 0.0) -> Column:
    x = real(a)
    return F.when(F.isnan(x) | (x < pole), NAN).when(x == pole, -INF).otherwise(f(x))


def log(a: Value) -> Column:
    return _log(F.ln, a)


def log2(a: Value) -> Column:
    return _log(F.log2, a)


def log10(a: Value) -> Column:
    return _log(F.log10, a)


def log1p(a: Value) -> Column:
    return _log(F.log1p, a, -1.0)


def logaddexp(a: Value, b: Value) -> Column:
    a, b = real(a), real(b)
    return F.when(a == b, a + F.ln(F.lit(2.0))).otherwise(maximum(a, b) + F.log1p(F.exp(-F.abs(a - b))))


def logaddexp2(a: Value, b: Value) -> Column:
    a, b = real(a), real(b)
    return F.when(a == b, a + 1).otherwise(maximum(a, b) + F.log1p(exp2(-F.abs(a - b))) / F.ln(F.lit(2.0)))


def sinc(a: Value) -> Column:
    x = real(a) * F.pi()
    return F.when(x == 0, 1.0).otherwise(F.try_divide(F.sin(x), x))


def expit(a: Value) -> Column:
    return F.lit(1.0) / (1 + F.exp(-real(a)))


def logit(a: Value) -> Column:
    p = real(a)
    return log(divide(p, 1 - p))


def factorial(n: Value) -> Column:
    """Exact up to 20."""
    return F.factorial(col(n).cast("int"))


def bounded_product(low: Column, high: Column) -> Column:
    """Product of the integers from low to high, 1 if there is none."""
    return F.when(high < low, 1.0).otherwise(F.aggregate(F.sequence(low.cast("long"), F.greatest(low, high).cast("long")), F.lit(1.0), lambda acc, x: acc * x))


def perm(n: Value, k: Value) -> Column:
    n, k = col(n).cast("long"), col(k).cast("long")
    return F.when((k < 0) | (k > n), 0.0).otherwise(bounded_product(n - k + 1, n))


def comb(n: Value, k: Value) -> Column:
    n, k = col(n).cast("long"), col(k).cast("long")
    k = F.least(k, n - k)
    made = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long"))), F.lit(1.0), lambda acc, i: F.rint(acc * (n - i + 1) / i))
    return F.when(k < 0, 0.0).when(k == 0, 1.0).otherwise(made)


def cast_wrapping(a: Value, bits: int) -> Column:
    """An integer cut to so many bits, two's complement."""
    x, half = col(a).cast("long"), 1 << (bits - 1)
    return F.pmod(x + half, F.lit(1 << bits)) - half if bits < 64 else x
