"""Concatenation and stacking: unions under shifted indices."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce as fold

from pyspark.sql import functions as F

from ..frame import NdFrame, cast
from ..meta import promote
from .shape import atleast_2d, atleast_3d, expand_dims, ravel, transpose


def concatenate(arrays: Sequence[NdFrame], axis: int | None = 0) -> NdFrame:
    if axis is None:
        arrays, axis = [ravel(a) for a in arrays], 0
    axis = arrays[0].axis(axis)
    shapes = {tuple(n for k, n in enumerate(a.shape) if k != axis) for a in arrays}
    if len(shapes) > 1 or len({a.ndim for a in arrays}) > 1:
        raise ValueError("all other axes must agree")
    to, name, start, parts = promote(*(a.dtype for a in arrays)), f"i{axis}", 0, []
    for a in arrays:
        parts.append(a.df.select(*((F.col(n) + start).alias(n) if n == name else n for n in a.idx), cast(F.col("v"), a.dtype, to).alias("v")))
        start += a.shape[axis]
    return NdFrame(fold(lambda x, y: x.unionByName(y), parts), [start if k == axis else n for k, n in enumerate(arrays[0].shape)], to)


def stack(arrays: Sequence[NdFrame], axis: int = 0) -> NdFrame:
    axis = axis % (arrays[0].ndim + 1)
    return concatenate([expand_dims(a, axis) for a in arrays], axis)


def vstack(arrays: Sequence[NdFrame]) -> NdFrame:
    return concatenate([atleast_2d(a) for a in arrays], 0)


row_stack = vstack


def hstack(arrays: Sequence[NdFrame]) -> NdFrame:
    return concatenate(arrays, 0 if arrays[0].ndim == 1 else 1)


def dstack(arrays: Sequence[NdFrame]) -> NdFrame:
    return concatenate([atleast_3d(a) for a in arrays], 2)


def column_stack(arrays: Sequence[NdFrame]) -> NdFrame:
    return concatenate([transpose(atleast_2d(a)) if a.ndim == 1 else a for a in arrays], 1)


def block(rows: Sequence[Sequence[NdFrame]]) -> NdFrame:
    return concatenate([concatenate([atleast_2d(a) for a in row], 1) for row in rows], 0)


bmat = block


def append(a: NdFrame, values: NdFrame, axis: int | None = None) -> NdFrame:
    return concatenate([a, values], axis)
