"""Types, shapes and axes, worked out on the driver before any plan is built."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import types as T

MAX_RANK = 64

#: Spark type of each dtype; unsigned 64-bit needs a decimal, complex a struct.
SPARK = {
    "bool": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float16": T.FloatType(), "float32": T.FloatType(), "float64": T.DoubleType(),
    "complex64": T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())]),
    "complex128": T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())]),
    "str": T.StringType(), "bytes": T.BinaryType(), "datetime64": T.LongType(), "timedelta64": T.LongType(),
}


def dtype(name: str) -> np.dtype:
    return np.dtype({"str": "U", "bytes": "S", "datetime64": "M8[us]", "timedelta64": "m8[us]"}.get(name, name))


def itemsize(name: str) -> int:
    return 0 if name in ("str", "bytes") else dtype(name).itemsize


def kind(name: str) -> str:
    return dtype(name).kind


def of_spark(kind: T.DataType) -> str:
    """dtype of a Spark column, signed and of full width."""
    return next(name for name in ("bool", "int8", "int16", "int32", "int64", "float32", "float64", "uint64", "str", "bytes", "complex128") if SPARK[name] == kind)


def can_cast(source: str, target: str, casting: str = "safe") -> bool:
    return bool(np.can_cast(dtype(source), dtype(target), casting))


def promote(*names: str) -> str:
    out = names[0]
    for name in names[1:]:
        found = np.promote_types(dtype(out), dtype(name))
        out = {"U": "str", "S": "bytes", "M": "datetime64", "m": "timedelta64"}.get(found.kind, found.name)
    return out


def common_type(*names: str) -> str:
    """Inexact type that holds all; integers count as float64."""
    return promote(*("float64" if kind(n) in "biu" else n for n in names))


def min_scalar_type(value: float) -> str:
    size = abs(value)
    return "float16" if not math.isfinite(value) or size < 65000 else "float32" if size < 3.4e38 else "float64"


def accumulator(name: str) -> str:
    """Type in which a sum or product runs: narrow integers as 32-bit ones."""
    return "int32" if name in ("bool", "int8", "int16", "int32") else "uint32" if name in ("uint8", "uint16", "uint32") else name


def finfo(name: str) -> dict[str, float]:
    info = np.finfo(dtype(name))
    return {"eps": float(info.eps), "max": float(info.max), "min": float(info.min)}


def iinfo(name: str) -> tuple[int, int]:
    info = np.iinfo(dtype(name))
    return int(info.min), int(info.max)


def iscomplex(name: str) -> bool:
    return name.startswith("complex")


class NdMeta(NamedTuple):
    """Shape and type of an array frame."""

    shape: tuple[int, ...]
    dtype: str

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def nbytes(self) -> int:
        return self.size * itemsize(self.dtype)

    @property
    def strides(self) -> tuple[int, ...]:
        """Cells to the next place along each axis, last axis fastest."""
        return strides(self.shape)


def strides(shape: Sequence[int]) -> tuple[int, ...]:
    return tuple(math.prod(shape[k + 1 :]) for k in range(len(shape)))


def checked_axis(axis: int, ndim: int) -> int:
    if not -ndim <= axis < ndim:
        raise ValueError(f"axis {axis} is out of bounds for rank {ndim}")
    return axis % ndim


def broadcast_shapes(*shapes: Sequence[int]) -> tuple[int, ...]:
    out = []
    for sizes in itertools.zip_longest(*(tuple(reversed(s)) for s in shapes), fillvalue=1):
        wide = {n for n in sizes if n != 1}
        if len(wide) > 1:
            raise ValueError(f"shapes {shapes} cannot be broadcast together")
        out.append(wide.pop() if wide else 1)
    if len(out) > MAX_RANK:
        raise ValueError("too many dimensions")
    return tuple(reversed(out))


def can_broadcast(*shapes: Sequence[int]) -> bool:
    try:
        broadcast_shapes(*shapes)
    except ValueError:
        return False
    return True
