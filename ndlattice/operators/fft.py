"""Discrete Fourier transforms: each line in one task, lines in parallel.

A short transform can also stay in the JVM as a join with its twiddle factors (``dft_join``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import functions as F

from ..frame import NdFrame
from .linalg import lines
from .shape import moveaxis


def _last(a: NdFrame, f: Callable[[np.ndarray], np.ndarray], n: int, dtype: str = "complex128") -> NdFrame:
    return lines(a, 1, f, (n,), dtype, stacked=True)


def _length(n: int) -> int:
    if n < 1:
        raise ValueError("a transform needs a point")
    return n


def fft(a: NdFrame, n: int | None = None) -> NdFrame:
    n = _length(n or a.shape[-1])
    return _last(a, lambda x: np.fft.fft(x, n), n)


def ifft(a: NdFrame, n: int | None = None) -> NdFrame:
    n = _length(n or a.shape[-1])
    return _last(a, lambda x: np.fft.ifft(x, n), n)


def rfft(a: NdFrame, n: int | None = None) -> NdFrame:
    n = _length(n or a.shape[-1])
    return _last(a, lambda x: np.fft.rfft(x.real, n), n // 2 + 1)


def irfft(a: NdFrame, n: int | None = None) -> NdFrame:
    n = _length(n or 2 * (a.shape[-1] - 1))
    return _last(a, lambda x: np.fft.irfft(x, n), n, "float64")


def hfft(a: NdFrame, n: int | None = None) -> NdFrame:
    n = _length(n or 2 * (a.shape[-1] - 1))
    return _last(a, lambda x: np.fft.hfft(x, n), n, "float64")


def ihfft(a: NdFrame) -> NdFrame:
    n = a.shape[-1]
    return _last(a, lambda x: np.fft.ihfft(x.real, n), n // 2 + 1)


def _over(a: NdFrame, axes: Sequence[int] | None, f: Callable[[NdFrame], NdFrame]) -> NdFrame:
    for axis in range(a.ndim) if axes is None else axes:
        a = moveaxis(f(moveaxis(a, axis, -1)), -1, axis)
    return a


def fftn(a: NdFrame, axes: Sequence[int] | None = None) -> NdFrame:
    return _over(a, axes, fft)


def ifftn(a: NdFrame, axes: Sequence[int] | None = None) -> NdFrame:
    return _over(a, axes, ifft)


def fft2(a: NdFrame) -> NdFrame:
    return fftn(a, (-2, -1))


def ifft2(a: NdFrame) -> NdFrame:
    return ifftn(a, (-2, -1))


def rfftn(a: NdFrame, axes: Sequence[int] | None = None) -> NdFrame:
    axes = list(range(a.ndim) if axes is None else axes)
    return fftn(_over(a, axes[-1:], rfft), axes[:-1])


def irfftn(a: NdFrame, axes: Sequence[int] | None = None, n: int | None = None) -> NdFrame:
    axes = list(range(a.ndim) if axes is None else axes)
    return _over(ifftn(a, axes[:-1]), axes[-1:], lambda x: irfft(x, n))


def dft_join(a: NdFrame) -> NdFrame:
    """Of a real vector by definition: every cell times its factor for every frequency, then one aggregation."""
    n = a.size
    rows = a.df.select("i0", F.col("v").cast("double").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("k"))
    turn = (F.col("i0") * F.col("k") % n) * (2 * math.pi / n)
    sums = rows.groupBy(F.col("k").alias("i0")).agg(F.sum(F.col("x") * F.cos(turn)).alias("re"), F.sum(-F.col("x") * F.sin(turn)).alias("im"))
    return NdFrame(sums.select("i0", F.struct("re", "im").alias("v")), (n,), "complex128")
