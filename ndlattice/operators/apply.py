"""Python callbacks over lines, axes and cells, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..frame import NdFrame
from .linalg import lines
from .shape import expand_dims, moveaxis


def apply_along_axis(f: Callable[[np.ndarray], float | np.ndarray], axis: int, a: NdFrame, shape: Sequence[int] = ()) -> NdFrame:
    """f of every line; its results have the given shape, which takes the axis's place."""
    axis = a.axis(axis)
    out = lines(moveaxis(a, axis, -1), 1, f, shape)
    for k in range(len(shape)):
        out = moveaxis(out, a.ndim - 1 + k, axis + k)
    return out


def apply_over_axes(f: Callable[[np.ndarray], float], axes: Sequence[int], a: NdFrame) -> NdFrame:
    """One axis after another, each left with one place."""
    for axis in axes:
        a = expand_dims(apply_along_axis(f, axis, a), a.axis(axis))
    return a


def vectorize(f: Callable[[float], float]) -> Callable[[Column], Column]:
    @F.pandas_udf("double")
    def each(x: pd.Series) -> pd.Series:
        return pd.Series([float(f(v)) for v in x.to_numpy(float)], dtype=float)

    return lambda x: each(x.cast("double"))


frompyfunc = vectorize


def line_aggregate(f: Callable[[np.ndarray], float]) -> Callable[[Column], Column]:
    """A callback over the values of a group, as an aggregate; a group must fit a task."""
    @F.pandas_udf("double")
    def whole(x: pd.Series) -> float:
        return float(f(x.to_numpy(float)))

    return lambda x: whole(x.cast("double"))
