"""Checks of whole arrays, and what happens where arithmetic leaves the finite numbers."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .frame import NdFrame, matched
from .functions import elementwise as E
from .meta import broadcast_shapes, can_cast
from .operators.reductions import allclose, array_equal

MODES = ("ignore", "raise")
_errors = {"divide": "ignore", "over": "ignore", "under": "ignore", "invalid": "ignore"}


def geterr() -> dict[str, str]:
    return dict(_errors)


def seterr(all: str | None = None, **modes: str) -> dict[str, str]:  # noqa: A002
    """The modes from now on, ignore or raise; returns the former ones."""
    wanted = dict.fromkeys(_errors, all) if all else {}
    wanted |= modes
    if unknown := set(wanted) - set(_errors) or set(wanted.values()) - set(MODES):
        raise ValueError(f"unknown: {sorted(unknown)}")
    before = geterr()
    _errors.update(wanted)
    return before


@contextmanager
def errstate(**modes: str) -> Iterator[None]:
    before = seterr(**modes)
    try:
        yield
    finally:
        _errors.update(before)


def guarded(result: Column, *operands: Column) -> Column:
    """result, or an error where finite operands gave NaN (mode invalid) or infinity (modes divide and over) and the mode says raise."""
    fine = F.lit(True)
    for x in operands:
        fine = fine & E.isfinite(x)
    if _errors["invalid"] == "raise":
        result = F.when(fine & E.isnan(result), F.raise_error(F.lit("invalid value")).cast("double")).otherwise(result)
    if "raise" in (_errors["divide"], _errors["over"]):
        result = F.when(fine & E.isinf(result), F.raise_error(F.lit("division by zero or overflow")).cast("double")).otherwise(result)
    return result


def asarray_chkfinite(a: NdFrame) -> NdFrame:
    """The frame itself; an error if a cell is not finite."""
    if a.dtype.startswith("float") and a.df.where(~E.isfinite(F.col("v"))).limit(1).count():
        raise ValueError("array must not contain infs or NaNs")
    return a


def require(a: NdFrame, dtype: str | None = None, requirements: str = "") -> NdFrame:
    """The frame in a type.  Layout requirements (C, F, A, W, O, E) hold for every frame: cells have no layout and are never shared."""
    if unknown := set(requirements.upper()) - set("CFAWOE"):
        raise ValueError(f"unknown requirements {sorted(unknown)}")
    return a if dtype in (None, a.dtype) else a.astype(dtype)


def copy(a: NdFrame) -> NdFrame:
    """Frames never change, so a copy shares its cells."""
    return NdFrame(a.df, a.shape, a.dtype)


def view(a: NdFrame, dtype: str | None = None) -> NdFrame:
    """The same cells; another type of the same width must be one that they can be cast to safely."""
    if dtype and not can_cast(a.dtype, dtype, "safe"):
        raise TypeError(f"cells of {a.dtype} cannot be viewed as {dtype}")
    return a.astype(dtype) if dtype else copy(a)


def isscalar(x: object) -> bool:
    return np.isscalar(x)


def assert_allclose(a: NdFrame, b: NdFrame, rtol: float = 1e-7, atol: float = 0.0) -> None:
    if not allclose(a, b, rtol, atol, equal_nan=True):
        raise AssertionError(f"arrays differ beyond a relative {rtol} and an absolute {atol}")


def assert_array_equal(a: NdFrame, b: NdFrame) -> None:
    if not array_equal(a, b):
        raise AssertionError("arrays differ")


def setfield(records: Column, value: Column, dtype: str, offset: int) -> Column:
    """Binary records with the bytes at an offset replaced by a number's, least byte first."""
    width = np.dtype(dtype).itemsize
    if dtype.startswith("float"):
        raise TypeError("whole numbers only")
    bits = value.cast("long")
    raw = F.concat(*(F.unhex(F.lpad(F.hex(F.shiftright(bits, 8 * k).bitwiseAND(255)), 2, "0")) for k in range(width)))
    return F.overlay(records, raw, F.lit(offset + 1), F.lit(width))


def ndindex(*shape: int) -> Iterator[tuple[int, ...]]:
    """Places of a shape in row-major order, on the driver."""
    return np.ndindex(*shape)


class MultiIter:
    """Broadcast cells of several frames, one after another in row-major order, a part of the rows at a time on the driver."""

    def __init__(self, *arrays: NdFrame):
        from .operators.shape import broadcast_to

        self.shape = broadcast_shapes(*(a.shape for a in arrays))
        self.index = [f"i{k}" for k in range(len(self.shape))]
        df, size = None, math.prod(self.shape)
        for j, a in enumerate(arrays):
            one = broadcast_to(a, self.shape).df.select(*self.index, F.col("v").alias(f"v{j}"))
            df = one if df is None else matched(df, one, self.index, size, size)
        self.df, self.count = df, len(arrays)

    def __iter__(self) -> Iterator[tuple]:
        for row in self.df.orderBy(*self.index).toLocalIterator():
            yield tuple(row[f"v{j}"] for j in range(self.count))


