"""Small arrays as text, on the driver."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import functions as F

from .frame import NdFrame

DEFAULTS = {"precision": 8, "threshold": 1000, "edgeitems": 3, "suppress": False}
_options = dict(DEFAULTS)
_printer: list[Callable[[NdFrame], str] | None] = [None]


def get_printoptions() -> dict:
    return dict(_options)


def set_printoptions(**options) -> None:
    if unknown := set(options) - set(DEFAULTS):
        raise ValueError(f"unknown: {sorted(unknown)}")
    _options.update(options)


def set_string_function(f: Callable[[NdFrame], str] | None) -> None:
    """What array_string calls from now on; None brings back array2string."""
    _printer[0] = f


def array2string(a: NdFrame, **options) -> str:
    """The array as nested brackets; of an array beyond the threshold only the cells at the edges are fetched."""
    chosen = {**_options, **options}
    if a.size <= chosen["threshold"]:
        return np.array2string(a.to_numpy(), **{k: chosen[k] for k in ("precision", "threshold")}, suppress_small=chosen["suppress"])
    edge, condition, shape, index = chosen["edgeitems"], F.lit(True), [], []
    for name, n in zip(a.idx, a.shape, strict=True):
        cut = n > 2 * edge
        condition = condition & ((F.col(name) < edge) | (F.col(name) >= n - edge)) if cut else condition
        index.append(F.when(F.col(name) < edge, F.col(name)).otherwise(F.col(name) - n + 2 * edge + 1) if cut else F.col(name))
        shape.append(2 * edge + 1 if cut else n)
    # one place stands for all that is left out, which the dots then hide
    rows = a.df.where(condition).select(*(i.cast("long").alias(k) for i, k in zip(index, a.idx, strict=True)), "v").collect()
    part = np.zeros(shape)
    for *at, v in rows:
        part[tuple(at)] = v
    return np.array2string(part, precision=chosen["precision"], threshold=0, edgeitems=edge, suppress_small=chosen["suppress"])


def array_string(a: NdFrame) -> str:
    return (_printer[0] or array2string)(a)


def array_print(a: NdFrame) -> None:
    print(array_string(a))


def disp(a: NdFrame, linefeed: bool = True) -> None:
    print(array_string(a), end="\n" if linefeed else "")
