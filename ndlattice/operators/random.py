"""Random arrays.  Distributions with an inverse are expressions over ``rand``; the others sample in
Arrow batches, each from a generator seeded by the batch's first cell, so that a task that runs again
gives the same values."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import NdFrame
from ..plans.ordered import positions, running
from ..sources.creation import cells

Shape = Sequence[int]


#: The seed of calls that give none.
_default = [12345]


def random_seed(seed: int) -> None:
    """The seed of all later calls that give none; each such call with the same arguments draws the same numbers."""
    _default[0] = int(seed)


def _seed(seed: int | None) -> int:
    return _default[0] if seed is None else seed


def _u(seed: int | None) -> Column:
    """Uniform over [0, 1)."""
    return F.rand(_seed(seed))


def _made(spark: SparkSession, shape: Shape, value: Column, dtype: str = "float64") -> NdFrame:
    return NdFrame(cells(spark, shape).withColumn("v", value.cast("int") if dtype == "int32" else value), shape, dtype)


def random(spark: SparkSession, shape: Shape, seed: int | None = None) -> NdFrame:
    return _made(spark, shape, _u(seed))


def uniform(spark: SparkSession, low: float, high: float, shape: Shape, seed: int | None = None) -> NdFrame:
    return _made(spark, shape, low + (high - low) * _u(seed))


def normal(spark: SparkSession, mean: float, std: float, shape: Shape, seed: int | None = None) -> NdFrame:
    return _made(spark, shape, mean + std * F.randn(_seed(seed)))


def standard_normal(spark: SparkSession, shape: Shape, seed: int | None = None) -> NdFrame:
    return normal(spark, 0.0, 1.0, shape, seed)


def randint(spark: SparkSession, low: int, high: int, shape: Shape, seed: int | None = None) -> NdFrame:
    """Half-open."""
    if not -(1 << 31) <= low < high <= 1 << 31:
        raise ValueError("bounds must be 32-bit and in order")
    return _made(spark, shape, F.floor(_u(seed) * (high - low)) + low, "int32")


def integers(spark: SparkSession, low: int, high: int, shape: Shape, seed: int | None = None) -> NdFrame:
    """Inclusive."""
    return randint(spark, low, high + 1, shape, seed)


#: Inverse distribution functions of a uniform u.
INVERSES: dict[str, Callable[..., Column]] = {
    "exponential": lambda u, scale: -scale * F.log1p(-u),
    "pareto": lambda u, a: F.expm1(-F.log1p(-u) / a),
    "power": lambda u, a: F.pow(u, F.lit(1.0 / a)),
    "rayleigh": lambda u, scale: scale * F.sqrt(-2 * F.log1p(-u)),
    "weibull": lambda u, a: F.pow(-F.log1p(-u), F.lit(1.0 / a)),
    "laplace": lambda u, loc, scale: loc - scale * F.signum(u - 0.5) * F.ln(F.greatest(1 - 2 * F.abs(u - 0.5), F.lit(1e-300))),
    "logistic": lambda u, loc, scale: loc + scale * F.ln(F.greatest(u, F.lit(1e-300)) / (1 - u)),
    "gumbel": lambda u, loc, scale: loc - scale * F.ln(-F.ln(F.greatest(u, F.lit(1e-300)))),
    "standard_cauchy": lambda u: F.tan(math.pi * (u - 0.5)),
    "triangular": lambda u, left, mode, right: F.when(u < (mode - left) / (right - left), left + F.sqrt(u * (right - left) * (mode - left))).otherwise(right - F.sqrt((1 - u) * (right - left) * (right - mode))),
    "geometric": lambda u, p: F.floor(F.log1p(-u) / math.log1p(-p)) + 1 if p < 1 else F.lit(1),
}


def inverse(spark: SparkSession, name: str, shape: Shape, *args: float, seed: int | None = None) -> NdFrame:
    """A distribution of INVERSES."""
    held = cells(spark, shape).withColumn("__u", _u(seed))  # drawn once, used several times
    dtype = "int32" if name == "geometric" else "float64"
    v = INVERSES[name](F.col("__u"), *args)
    return NdFrame(held.withColumn("v", v.cast("int") if dtype == "int32" else v).drop("__u"), shape, dtype)


#: Samplers of numpy's Generator by name; those of whole numbers.
SAMPLERS = ("gamma", "beta", "chisquare", "standard_t", "f", "noncentral_chisquare", "noncentral_f", "wald", "vonmises", "binomial", "poisson", "negative_binomial", "hypergeometric", "logseries", "zipf")
WHOLE = ("binomial", "poisson", "negative_binomial", "hypergeometric", "logseries", "zipf")


def _draw(r: np.random.Generator, name: str, args: Sequence[float], n: int) -> np.ndarray:
    if name == "noncentral_f":
        num, den, nonc = args
        return (r.noncentral_chisquare(num, nonc, n) / num) / (r.chisquare(den, n) / den)
    return getattr(r, name)(*args, n)


def sample(spark: SparkSession, name: str, shape: Shape, *args: float, seed: int | None = None) -> NdFrame:
    """A distribution of SAMPLERS."""
    if name not in SAMPLERS:
        raise ValueError(f"no sampler {name}")
    grid, own = cells(spark, shape), _seed(seed)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                r = np.random.default_rng([own, *(int(x) for x in b.iloc[0])])
                yield b.assign(v=_draw(r, name, args, len(b)).astype(float))

    dtype = "int32" if name in WHOLE else "float64"
    df = grid.mapInPandas(draw, ", ".join([*(f"i{k} long" for k in range(len(shape))), "v double"]))
    return NdFrame(df.withColumn("v", F.col("v").cast("int")) if dtype == "int32" else df, shape, dtype)


def _rows(spark: SparkSession, size: int, width: int, seed: int | None, draw: Callable[[np.random.Generator, int], np.ndarray], dtype: str = "float64") -> NdFrame:
    """Vectors of a joint distribution, one a row."""
    own = _seed(seed)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = draw(np.random.default_rng([own, int(b["id"].iloc[0])]), len(b))
                yield pd.DataFrame({"i0": np.repeat(b["id"].to_numpy(), width), "i1": np.tile(np.arange(width), len(b)), "v": x.ravel().astype(float)})

    df = spark.range(size).mapInPandas(each, "i0 long, i1 long, v double")
    return NdFrame(df.withColumn("v", F.col("v").cast("int")) if dtype == "int32" else df, (size, width), dtype)


def dirichlet(spark: SparkSession, alpha: Sequence[float], size: int, seed: int | None = None) -> NdFrame:
    return _rows(spark, size, len(alpha), seed, lambda r, n: r.dirichlet(alpha, n))


def multinomial(spark: SparkSession, n: int, p: Sequence[float], size: int, seed: int | None = None) -> NdFrame:
    return _rows(spark, size, len(p), seed, lambda r, m: r.multinomial(n, p, m), "int32")


def multivariate_normal(spark: SparkSession, mean: Sequence[float], cov: Sequence[Sequence[float]], size: int, seed: int | None = None) -> NdFrame:
    return _rows(spark, size, len(mean), seed, lambda r, n: r.multivariate_normal(mean, cov, n))


def choice(a: NdFrame, size: int, replace: bool = True, p: NdFrame | None = None, seed: int | None = None) -> NdFrame:
    """Draws from a vector, with or without replacement, with weights if given."""
    n, spark = a.size, a.df.sparkSession
    if not replace:
        if size > n:
            raise ValueError("more draws than values")
        # a smaller key the likelier: exponential clocks
        clock = F.rand(_seed(seed)) if p is None else -F.log1p(-F.rand(_seed(seed))) / F.col("w")
        rows = a.df if p is None else a.df.join(p.df.withColumnRenamed("v", "w"), "i0").where("w > 0")
        first = rows.withColumn("__c", clock).orderBy("__c", "i0").limit(size)
        return NdFrame(positions(first.select("v", "__c", F.col("i0").alias("__i")), F.col("__c"), F.col("__i")).select("i0", "v"), (size,), a.dtype)
    draws = spark.range(size).select(F.col("id").alias("i0"), F.rand(_seed(seed)).alias("u"))
    if p is None:
        wanted = draws.select("i0", F.floor(F.col("u") * n).alias("__at"))
        return NdFrame(wanted.join(a.df.select(F.col("i0").alias("__at"), "v"), "__at").select("i0", "v"), (size,), a.dtype)
    # the draws and the cumulated weights are ordered together: each draw takes the first weight above it
    weights = running(a.df.join(p.df.withColumnRenamed("v", "w"), "i0"), F.col("w"), F.col("i0"), name="top")
    from .sorting import searchsorted_join

    found = searchsorted_join(draws, "u", weights, "top", "right", "__at").withColumn("__at", F.least("__at", F.lit(n - 1)))
    return NdFrame(found.join(a.df.select(F.col("i0").alias("__at"), "v"), "__at").select("i0", "v"), (size,), a.dtype)


def permutation(a: NdFrame, seed: int | None = None) -> NdFrame:
    """Rows in random order."""
    order = positions(a.df.select(F.col("i0").alias("__from")).distinct().withColumn("__r", F.xxhash64(F.lit(_seed(seed)), "__from")), F.col("__r"), F.col("__from"), name="__to")
    df = a.df.join(order.select("__from", "__to"), F.col("i0") == F.col("__from")).withColumn("i0", F.col("__to")).drop("__to", "__from")
    return NdFrame(df.select(*a.idx, "v"), a.shape, a.dtype)


shuffle = permutation


def random_bytes(n: int, seed: int | None = None) -> bytes:
    return np.random.default_rng(seed).bytes(n)


def matlib_rand(spark: SparkSession, *shape: int, seed: int | None = None) -> NdFrame:
    """Uniform numbers as a matrix; one size makes a row."""
    return random(spark, shape if len(shape) > 1 else (1, *shape), seed)


def matlib_randn(spark: SparkSession, *shape: int, seed: int | None = None) -> NdFrame:
    """Standard normal numbers as a matrix; one size makes a row."""
    return standard_normal(spark, shape if len(shape) > 1 else (1, *shape), seed)


def sample_rows(df: DataFrame, fraction: float, seed: int | None = None) -> DataFrame:
    return df.sample(fraction=fraction, seed=_seed(seed))
