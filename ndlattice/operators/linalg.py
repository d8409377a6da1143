"""Dense linear algebra: each matrix of a stack is factorised in one task, stacks in parallel.

A matrix must fit a task.  For tables with many rows and few columns, ``lstsq_table`` and
``svd_table`` need one aggregation only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import NdFrame, matched
from ..meta import strides


def _gathered(a: NdFrame, keys: Sequence[str], core: int, name: str) -> DataFrame:
    """A row for each place of the leading axes: keys and the cells behind them as one array, in row-major order."""
    flat, step = F.lit(0).cast("long"), 1
    for k in range(a.ndim - 1, a.ndim - core - 1, -1):
        flat, step = flat + F.col(f"i{k}") * step, step * a.shape[k]
    cells = F.array_sort(F.collect_list(F.struct(flat.alias("at"), F.col("v").alias("v"))))
    return a.df.groupBy(*keys).agg(F.transform(cells, lambda c: c["v"]).alias(name))


def _dense(column: pa.Array, sizes: Sequence[int]) -> list[np.ndarray]:
    """An array of the given sizes for every row; nulls are NaN."""
    flat = column.flatten()
    if pa.types.is_struct(flat.type):
        values = flat.field("re").to_numpy(zero_copy_only=False) + 1j * flat.field("im").to_numpy(zero_copy_only=False)
    else:
        values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    return list(values.reshape((len(column), *sizes)))


def lines(a: NdFrame, core: int, f: Callable[..., np.ndarray], shape: Sequence[int], dtype: str = "float64", other: NdFrame | None = None, other_core: int = 0, stacked: bool = False) -> NdFrame:
    """f over the last ``core`` axes of every place of the others; its results have the given shape.

    With a second frame, f gets both parts of a place; stacked: f takes a whole batch of places at once.
    The cells of a place are gathered in the JVM and reach Python as one array, many places in a batch.
    """
    lead = a.ndim - core
    keys = [f"i{k}" for k in range(lead)]
    kind = "struct<re:double,im:double>" if dtype.startswith("complex") else "double"
    rows = _gathered(a, keys, core, "x")
    two = other is not None
    sizes, other_sizes = a.shape[lead:], () if other is None else other.shape[other.ndim - other_core :]
    if other is not None:
        theirs = _gathered(other, keys, other_core, "y")
        rows = matched(rows, theirs, keys, a.size, other.size) if keys else rows.crossJoin(theirs)  # without keys a row each
    out_type = pa.list_(pa.struct([("re", pa.float64()), ("im", pa.float64())]) if dtype.startswith("complex") else pa.float64())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [_dense(batch.column(lead), sizes)] + ([_dense(batch.column(lead + 1), other_sizes)] if two else [])
            found = f(*map(np.stack, parts)) if stacked else np.stack([np.asarray(f(*one)) for one in zip(*parts, strict=True)])
            found = np.asarray(found).reshape(batch.num_rows, -1)
            if dtype.startswith("complex"):
                flat = pa.StructArray.from_arrays([pa.array(found.real.ravel().astype(float)), pa.array(found.imag.ravel().astype(float))], ["re", "im"])
            else:
                flat = pa.array(found.ravel().astype(float))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[:lead], lists.cast(out_type)], names=[*keys, "v"])

    done = rows.mapInArrow(work, ", ".join([*(f"{k} long" for k in keys), f"v array<{kind}>"]))
    cells = done.select(*keys, F.posexplode("v").alias("__at", "v"))
    steps = strides(shape)
    own = [F.pmod(F.call_function("div", F.col("__at").cast("long"), F.lit(step)), F.lit(n)).cast("long").alias(f"i{lead + k}") for k, (n, step) in enumerate(zip(shape, steps, strict=True))]
    return NdFrame(cells.select(*keys, *own, "v"), (*a.shape[:lead], *shape), dtype)


def _square(a: NdFrame) -> int:
    if a.ndim < 2 or a.shape[-1] != a.shape[-2]:
        raise ValueError("square matrices only")
    return a.shape[-1]


def inv(a: NdFrame) -> NdFrame:
    n = _square(a)
    return lines(a, 2, np.linalg.inv, (n, n), stacked=True)


def det(a: NdFrame) -> NdFrame:
    _square(a)
    return lines(a, 2, np.linalg.det, (), stacked=True)


def slogdet(a: NdFrame) -> tuple[NdFrame, NdFrame]:
    _square(a)
    return lines(a, 2, lambda m: np.linalg.slogdet(m)[0], (), stacked=True), lines(a, 2, lambda m: np.linalg.slogdet(m)[1], (), stacked=True)


def solve(a: NdFrame, b: NdFrame) -> NdFrame:
    _square(a)
    core = 1 if b.ndim == a.ndim - 1 else 2
    return lines(a, 2, np.linalg.solve, b.shape[b.ndim - core :], other=b, other_core=core)


def lstsq(a: NdFrame, b: NdFrame, rcond: float | None = None) -> dict[str, NdFrame]:
    n = a.shape[-1]
    part = lambda i, shape: lines(a, 2, lambda x, y: np.linalg.lstsq(x, y, rcond)[i], shape, other=b, other_core=b.ndim)
    return {"x": part(0, (n, *b.shape[1:])), "rank": part(2, ()), "singular_values": part(3, (min(a.shape[-2:]),))}


def cond(a: NdFrame) -> NdFrame:
    return lines(a, 2, np.linalg.cond, (), stacked=True)


def eig(a: NdFrame) -> tuple[NdFrame, NdFrame]:
    n = _square(a)
    return lines(a, 2, lambda m: np.linalg.eig(m)[0], (n,), "complex128"), lines(a, 2, lambda m: np.linalg.eig(m)[1], (n, n), "complex128")


def eigh(a: NdFrame, upper: bool = False) -> tuple[NdFrame, NdFrame]:
    n, side = _square(a), "U" if upper else "L"
    return lines(a, 2, lambda m: np.linalg.eigh(m, side)[0], (n,), stacked=True), lines(a, 2, lambda m: np.linalg.eigh(m, side)[1], (n, n), stacked=True)


def eigvals(a: NdFrame) -> NdFrame:
    return lines(a, 2, np.linalg.eigvals, (_square(a),), "complex128", stacked=True)


def eigvalsh(a: NdFrame, upper: bool = False) -> NdFrame:
    return lines(a, 2, lambda m: np.linalg.eigvalsh(m, "U" if upper else "L"), (_square(a),))


def svd(a: NdFrame, full_matrices: bool = True) -> tuple[NdFrame, NdFrame, NdFrame]:
    m, n = a.shape[-2:]
    k = min(m, n)
    part = lambda i, shape: lines(a, 2, lambda x: np.linalg.svd(x, full_matrices)[i], shape)
    return part(0, (m, m if full_matrices else k)), part(1, (k,)), part(2, (n if full_matrices else k, n))


def svdvals(a: NdFrame) -> NdFrame:
    return lines(a, 2, lambda x: np.linalg.svd(x, compute_uv=False), (min(a.shape[-2:]),), stacked=True)


def qr(a: NdFrame) -> tuple[NdFrame, NdFrame]:
    m, n = a.shape[-2:]
    k = min(m, n)
    return lines(a, 2, lambda x: np.linalg.qr(x)[0], (m, k)), lines(a, 2, lambda x: np.linalg.qr(x)[1], (k, n))


def cholesky(a: NdFrame) -> NdFrame:
    n = _square(a)
    return lines(a, 2, np.linalg.cholesky, (n, n), stacked=True)


def matrix_rank(a: NdFrame, tol: float | None = None) -> NdFrame:
    return lines(a, 2, lambda m: np.linalg.matrix_rank(m, tol), ())


def pinv(a: NdFrame, rcond: float = 1e-15) -> NdFrame:
    return lines(a, 2, lambda m: np.linalg.pinv(m, rcond), a.shape[-2:][::-1])


def tensorinv(a: NdFrame, ind: int = 2) -> NdFrame:
    return lines(a, a.ndim, lambda m: np.linalg.tensorinv(m, ind), (*a.shape[ind:], *a.shape[:ind]))


def tensorsolve(a: NdFrame, b: NdFrame, axes: Sequence[int] | None = None) -> NdFrame:
    order = [k for k in range(a.ndim) if k not in (axes or ())] + list(axes or ())
    return lines(a, a.ndim, lambda x, y: np.linalg.tensorsolve(x, y, axes), [a.shape[k] for k in order][b.ndim :], other=b, other_core=b.ndim)


def norm(a: NdFrame, order: float | None = None, axis: int | None = None) -> NdFrame:
    """Of vectors along an axis, or of all cells without one: an aggregation."""
    from .reductions import reduce

    return reduce(a, axis, lambda v: agg_norm(v, order), "float64")


def agg_norm(v: Column, order: float | None = None) -> Column:
    size = F.abs(v.cast("double"))
    if order is None or order == 2:
        return F.sqrt(F.sum(size * size))
    if order == float("inf"):
        return F.max(size)
    if order == -float("inf"):
        return F.min(size)
    if order == 0:
        return F.count_if(size != 0).cast("double")
    return F.pow(F.sum(F.pow(size, F.lit(float(order)))), F.lit(1.0 / order))


def matrix_norm(a: NdFrame, order: str | float = "fro") -> NdFrame:
    return lines(a, 2, lambda m: np.linalg.norm(m, order), ())


# --- tables with many rows and few columns ----------------------------------------------------


def gram(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """X'X from one aggregation; as many numbers as pairs of columns reach the driver."""
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = df.agg(*(F.sum(F.col(columns[i]).cast("double") * F.col(columns[j]).cast("double")) for i, j in pairs)).first()
    out = np.zeros((k, k))
    for (i, j), v in zip(pairs, row, strict=True):
        out[i, j] = out[j, i] = v or 0.0
    return out


def lstsq_table(df: DataFrame, xs: Sequence[str], y: str) -> np.ndarray:
    """Least squares by the normal equations."""
    g = gram(df, [*xs, y])
    return np.linalg.lstsq(g[:-1, :-1], g[:-1, -1], rcond=None)[0]


def svd_table(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right vectors from the Gram matrix."""
    w, v = np.linalg.eigh(gram(df, columns))
    return np.sqrt(np.maximum(w[::-1], 0)), v[:, ::-1].T
