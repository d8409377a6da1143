"""Complex numbers as STRUCT<re, im>, and real functions that turn complex outside their domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import elementwise as E
from .elementwise import Value


def make(re: Value, im: Value = 0.0) -> Column:
    return F.struct(E.real(re).alias("re"), E.real(im).alias("im"))


def polar(r: Value, theta: Value) -> Column:
    return make(E.real(r) * F.cos(E.real(theta)), E.real(r) * F.sin(E.real(theta)))


def real(z: Column) -> Column:
    return z["re"]


def imag(z: Column) -> Column:
    return z["im"]


def conj(z: Column) -> Column:
    return make(z["re"], -z["im"])


conjugate = conj


def absolute(z: Column) -> Column:
    return F.hypot(z["re"], z["im"])


def angle(z: Column, deg: bool = False) -> Column:
    phase = E.arctan2(z["im"], z["re"])
    return F.degrees(phase) if deg else phase


def add(a: Column, b: Column) -> Column:
    return make(a["re"] + b["re"], a["im"] + b["im"])


def subtract(a: Column, b: Column) -> Column:
    return make(a["re"] - b["re"], a["im"] - b["im"])


def multiply(a: Column, b: Column) -> Column:
    return make(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def divide(a: Column, b: Column) -> Column:
    n = b["re"] * b["re"] + b["im"] * b["im"]
    return make(E.divide(a["re"] * b["re"] + a["im"] * b["im"], n), E.divide(a["im"] * b["re"] - a["re"] * b["im"], n))


def exp(z: Column) -> Column:
    return polar(F.exp(z["re"]), z["im"])


def log(z: Column) -> Column:
    return make(E.log(absolute(z)), angle(z))


def sqrt(z: Column) -> Column:
    r = absolute(z)
    im = F.sqrt((r - z["re"]) / 2)
    return make(F.sqrt((r + z["re"]) / 2), F.when(E.signbit(z["im"]), -im).otherwise(im))


def power(z: Column, p: Value) -> Column:
    return polar(F.pow(absolute(z), E.real(p)), angle(z) * E.real(p))


def sin(z: Column) -> Column:
    return make(F.sin(z["re"]) * F.cosh(z["im"]), F.cos(z["re"]) * F.sinh(z["im"]))


def cos(z: Column) -> Column:
    return make(F.cos(z["re"]) * F.cosh(z["im"]), -F.sin(z["re"]) * F.sinh(z["im"]))


def real_if_close(df: DataFrame, z: str, tol: float = 100.0) -> DataFrame:
    """The column as real parts if every imaginary part of the table is within tol machine steps of 0."""
    close = df.agg(F.bool_and(F.abs(F.col(z)["im"]) < tol * 2.220446049250313e-16)).first()[0]
    return df.withColumn(z, F.col(z)["re"]) if close else df


# --- real functions that leave the real line: one complex formula, used if any value needs it ---


def emath_sqrt(x: Value) -> Column:
    return sqrt(make(x))


def emath_log(x: Value) -> Column:
    """A zero of either sign lies in the real domain."""
    return log(make(E.real(x) + 0.0))


def _scaled_log(x: Value, base: float) -> Column:
    z = emath_log(x)
    return make(z["re"] / F.ln(F.lit(base)), z["im"] / F.ln(F.lit(base)))


def emath_log10(x: Value) -> Column:
    return _scaled_log(x, 10.0)


def emath_log2(x: Value) -> Column:
    return _scaled_log(x, 2.0)


def emath_power(x: Value, p: Value) -> Column:
    return power(make(x), p)


def emath_arcsin(x: Value) -> Column:
    """Beyond 1 the real part stays at a quarter turn."""
    x = E.real(x)
    out = F.abs(x) > 1
    return make(F.when(out, F.signum(x) * F.pi() / 2).otherwise(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))), F.when(out, F.acosh(F.greatest(F.abs(x), F.lit(1.0)))).otherwise(0.0))


def emath_arccos(x: Value) -> Column:
    s = emath_arcsin(x)
    return make(F.pi() / 2 - s["re"], -s["im"])


def emath_arctanh(x: Value) -> Column:
    x = E.real(x)
    out = F.abs(x) > 1
    inside = E.arctanh(x)
    outside = F.when(out, F.ln(F.abs((1 + x) / F.nullif(1 - x, F.lit(0.0)))) / 2)
    return make(F.when(out, outside).otherwise(inside), F.when(out, F.pi() / 2).otherwise(0.0))


def emath(df: DataFrame, column: str, name: str, below: float | None = 0.0, beyond: float | None = None) -> DataFrame:
    """df with the function over a column: real if every value lies in its domain, complex else."""
    x = F.col(column)
    outside = x < below if beyond is None else F.abs(x) > beyond
    z = globals()[f"emath_{name}"](x)
    needs = df.agg(F.bool_or(outside)).first()[0]
    return df.withColumn(name, z if needs else z["re"])
