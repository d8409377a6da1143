"""Shapes: the same cells under new indices, and broadcasting as a join."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..frame import BROADCAST_CELLS, NdFrame, matched
from ..meta import broadcast_shapes, promote, strides


def _new(columns: Sequence[Column]) -> dict[str, Column]:
    return {f"i{k}": c for k, c in enumerate(columns)}


def _div(x: Column, n: int) -> Column:
    return x if n == 1 else F.call_function("div", x, F.lit(n))


def reshape(a: NdFrame, shape: Sequence[int], order: str = "C") -> NdFrame:
    shape = list(shape)
    if -1 in shape:
        rest = 1
        for n in shape:
            rest *= n if n != -1 else 1
        shape[shape.index(-1)] = a.size // max(rest, 1)
    size = 1
    for n in shape:
        size *= n
    if size != a.size:
        raise ValueError(f"cannot shape {a.size} cells as {shape}")
    if order == "F":
        return transpose(reshape(transpose(a), shape[::-1]))
    return a.indexed(_new([_div(a.flat(), s) % n for n, s in zip(shape, strides(shape), strict=True)]), shape)


def ravel(a: NdFrame, order: str = "C") -> NdFrame:
    return reshape(a, (a.size,), order)


flatten = ravel


def resize(a: NdFrame, shape: Sequence[int]) -> NdFrame:
    """Cells are taken again from the start where the new shape needs more."""
    from ..sources.creation import tile

    size = 1
    for n in shape:
        size *= n
    long = tile(ravel(a), (-(-size // max(a.size, 1)),))
    return reshape(NdFrame(long.df.where(F.col("i0") < size), (size,), a.dtype), shape)


def transpose(a: NdFrame, axes: Sequence[int] | None = None) -> NdFrame:
    axes = [a.axis(x) for x in (range(a.ndim)[::-1] if axes is None else axes)]
    if sorted(axes) != list(range(a.ndim)):
        raise ValueError("axes must be a permutation")
    return a.indexed({f"i{k}": f"i{x}" for k, x in enumerate(axes)}, [a.shape[x] for x in axes])


def swapaxes(a: NdFrame, one: int, two: int) -> NdFrame:
    axes = list(range(a.ndim))
    one, two = a.axis(one), a.axis(two)
    axes[one], axes[two] = two, one
    return transpose(a, axes)


def moveaxis(a: NdFrame, source: int, target: int) -> NdFrame:
    source = a.axis(source)
    axes = [k for k in range(a.ndim) if k != source]
    axes.insert(a.axis(target), source)
    return transpose(a, axes)


def rollaxis(a: NdFrame, axis: int, start: int = 0) -> NdFrame:
    axis = a.axis(axis)
    axes = [k for k in range(a.ndim) if k != axis]
    axes.insert(start - (start > axis), axis)
    return transpose(a, axes)


def squeeze(a: NdFrame, axis: int | None = None) -> NdFrame:
    drop = {k for k, n in enumerate(a.shape) if n == 1} if axis is None else {a.axis(axis)}
    if any(a.shape[k] != 1 for k in drop):
        raise ValueError("only axes of one place can go")
    keep = [k for k in range(a.ndim) if k not in drop]
    return a.indexed({f"i{j}": f"i{k}" for j, k in enumerate(keep)}, [a.shape[k] for k in keep])


def expand_dims(a: NdFrame, axis: int) -> NdFrame:
    axis = axis % (a.ndim + 1)
    names = [f"i{k}" for k in range(a.ndim)]
    names.insert(axis, "")
    shape = list(a.shape)
    shape.insert(axis, 1)
    return a.indexed({f"i{j}": (n or F.lit(0)) for j, n in enumerate(names)}, shape)


def atleast_1d(a: NdFrame) -> NdFrame:
    return expand_dims(a, 0) if a.ndim == 0 else a


def atleast_2d(a: NdFrame) -> NdFrame:
    a = atleast_1d(a)
    return expand_dims(a, 0) if a.ndim == 1 else a


def atleast_3d(a: NdFrame) -> NdFrame:
    a = atleast_2d(a)
    return expand_dims(a, 2) if a.ndim == 2 else a


mat = atleast_2d


def _along(a: NdFrame, axis: int, f: Callable[[Column, int], Column]) -> NdFrame:
    axis = a.axis(axis)
    return a.indexed({n: f(F.col(n), a.shape[axis]) if k == axis else n for k, n in enumerate(a.idx)}, a.shape)


def flip(a: NdFrame, axis: int | None = None) -> NdFrame:
    for k in range(a.ndim) if axis is None else [axis]:
        a = _along(a, k, lambda i, n: n - 1 - i)
    return a


def fliplr(a: NdFrame) -> NdFrame:
    return flip(a, 1)


def flipud(a: NdFrame) -> NdFrame:
    return flip(a, 0)


def rot90(a: NdFrame, k: int = 1, one: int = 0, two: int = 1) -> NdFrame:
    for _ in range(k % 4):
        a = flip(swapaxes(a, one, two), one)
    return a


def roll(a: NdFrame, shift: int, axis: int | None = None) -> NdFrame:
    if axis is None:
        return reshape(roll(ravel(a), shift, 0), a.shape)
    return _along(a, axis, lambda i, n: F.pmod(i + shift, F.lit(max(n, 1))))


def fftshift(a: NdFrame) -> NdFrame:
    for k, n in enumerate(a.shape):
        a = roll(a, n // 2, k)
    return a


def ifftshift(a: NdFrame) -> NdFrame:
    for k, n in enumerate(a.shape):
        a = roll(a, -(n // 2), k)
    return a


def pad(a: NdFrame, width: int, value: float = 0.0) -> NdFrame:
    """One width on both sides of every axis: the border is made, the inside only moved."""
    from ..sources.creation import cells

    shape = [n + 2 * width for n in a.shape]
    inside = a.df.select(*((F.col(n) + width).alias(n) for n in a.idx), "v")
    outside = F.lit(False)
    for name, n in zip(a.idx, a.shape, strict=True):
        outside = outside | (F.col(name) < width) | (F.col(name) >= n + width)
    border = cells(a.df.sparkSession, shape).where(outside).withColumn("v", F.lit(value).cast(inside.schema["v"].dataType))
    return NdFrame(inside.unionByName(border), shape, a.dtype)


def split(a: NdFrame, sections: int | Sequence[int], axis: int = 0, even: bool = True) -> list[NdFrame]:
    """Parts along an axis: so many, or before each given place."""
    axis = a.axis(axis)
    n = a.shape[axis]
    if isinstance(sections, int):
        if even and n % sections:
            raise ValueError("the parts are not equal")
        each, more = divmod(n, sections)
        cuts = [0]
        for k in range(sections):
            cuts.append(cuts[-1] + each + (k < more))
    else:
        cuts = [0, *(min(max(c + n if c < 0 else c, 0), n) for c in sections), n]
    name, out = f"i{axis}", []
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        e = max(s, e)
        df = a.df.where((F.col(name) >= s) & (F.col(name) < e)).withColumn(name, F.col(name) - s)
        out.append(NdFrame(df, [e - s if k == axis else m for k, m in enumerate(a.shape)], a.dtype))
    return out


def array_split(a: NdFrame, sections: int | Sequence[int], axis: int = 0) -> list[NdFrame]:
    return split(a, sections, axis, even=False)


def hsplit(a: NdFrame, sections: int | Sequence[int]) -> list[NdFrame]:
    return split(a, sections, 0 if a.ndim == 1 else 1)


def vsplit(a: NdFrame, sections: int | Sequence[int]) -> list[NdFrame]:
    return split(a, sections, 0)


def dsplit(a: NdFrame, sections: int | Sequence[int]) -> list[NdFrame]:
    return split(a, sections, 2)


def tril(a: NdFrame, k: int = 0) -> NdFrame:
    return a.map_where(F.col(f"i{a.ndim - 1}") > F.col(f"i{a.ndim - 2}") + k, F.lit(0))


def triu(a: NdFrame, k: int = 0) -> NdFrame:
    return a.map_where(F.col(f"i{a.ndim - 1}") < F.col(f"i{a.ndim - 2}") + k, F.lit(0))


def broadcast_to(a: NdFrame, shape: Sequence[int]) -> NdFrame:
    """Axes of one place are spread by exploding a range; no join is needed."""
    if broadcast_shapes(a.shape, shape) != tuple(shape):
        raise ValueError(f"cannot broadcast {a.shape} to {shape}")
    lead = len(shape) - a.ndim
    df = a.df.select(*(F.lit(0).cast("long").alias(f"i{k}") for k in range(lead)), *(F.col(f"i{k}").alias(f"i{k + lead}") for k in range(a.ndim)), "v")
    for k, n in enumerate(shape):
        if n != (a.shape[k - lead] if k >= lead else 1):
            rest = [F.col(c) for c in df.columns if c != f"i{k}"]
            df = df.select(*rest, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(f"i{k}")) if n else df.where("false")
    return NdFrame(df.select(*(f"i{k}" for k in range(len(shape))), "v"), shape, a.dtype)


def broadcast_arrays(*arrays: NdFrame) -> list[NdFrame]:
    shape = broadcast_shapes(*(a.shape for a in arrays))
    return [broadcast_to(a, shape) for a in arrays]


def combine(a: NdFrame, b: NdFrame, f: Callable[[Column, Column], Column], dtype: str | None = None) -> NdFrame:
    """f over aligned cells: an equi-join on the axes that both have, the others come from one side."""
    shape = broadcast_shapes(a.shape, b.shape)
    k = len(shape)

    def of(x: NdFrame, side: str):
        lead = k - x.ndim
        wide = [j for j in range(k) if j >= lead and x.shape[j - lead] != 1]
        return x.df.select(*(F.col(f"i{j - lead}").alias(f"i{j}") for j in wide), F.col("v").alias(side)), wide

    (left, mine), (right, theirs) = of(a, "__a"), of(b, "__b")
    on = [f"i{j}" for j in mine if j in theirs]
    both = matched(left, right, on, a.size, b.size) if on else left.crossJoin(F.broadcast(right) if b.size <= BROADCAST_CELLS else right)
    index = [F.col(f"i{j}") if j in mine or j in theirs else F.lit(0).cast("long").alias(f"i{j}") for j in range(k)]
    return NdFrame(both.select(*index, f(F.col("__a"), F.col("__b")).alias("v")), shape, dtype or promote(a.dtype, b.dtype))
