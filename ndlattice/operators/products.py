"""Products and contractions: joins on shared indices and one aggregation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..frame import BROADCAST_CELLS, NdFrame, matched
from ..meta import promote
from .shape import combine, ravel, transpose


def einsum(subscripts: str, *arrays: NdFrame) -> NdFrame:
    """Labels, repeated labels, ellipsis, implicit output.

    Operands are joined one after another on the labels they share; what no later operand and not
    the output needs is summed away as soon as it can be.
    """
    terms, explicit, out = subscripts.replace(" ", "").partition("->")
    inputs = terms.split(",")
    if len(inputs) != len(arrays):
        raise ValueError("one term for each operand is needed")
    spare = [c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c not in subscripts]
    widest = 0
    for i, (t, a) in enumerate(zip(inputs, arrays, strict=True)):
        if "..." in t:
            n = a.ndim - len(t) + 3
            widest = max(widest, n)
            inputs[i] = t.replace("...", "".join(reversed(spare[:n])))
    dots = "".join(reversed(spare[:widest]))
    out = out.replace("...", dots) if explicit else dots + "".join(sorted(c for c in set("".join(inputs)) - set(dots) if "".join(inputs).count(c) == 1))
    size: dict[str, int] = {}
    for t, a in zip(inputs, arrays, strict=True):
        if len(t) != a.ndim:
            raise ValueError(f"{t} does not fit rank {a.ndim}")
        for c, n in zip(t, a.shape, strict=True):
            if size.setdefault(c, n) not in (n, 1) and n != 1:
                raise ValueError(f"label {c} has two sizes")
            size[c] = max(size[c], n)
    if set(out) - set(size) or len(set(out)) < len(out):
        raise ValueError(f"bad output {out}")

    def labelled(t: str, a: NdFrame):
        df, seen, wide = a.df, {}, []
        for k, c in enumerate(t):
            if c in seen:
                df = df.where(F.col(f"i{k}") == F.col(f"i{seen[c]}"))
            else:
                seen[c] = k
        wide = [c for c in seen if a.shape[seen[c]] == size[c]]  # an axis of one place meets every place
        return df.select(*(F.col(f"i{seen[c]}").alias(f"l{ord(c)}") for c in wide), F.col("v").cast("double").alias("v")), wide

    now, have = labelled(inputs[0], arrays[0])
    for i in range(1, len(arrays) + 1):
        later = set(out).union(*inputs[i:]) if i < len(arrays) else set(out)
        if gone := [c for c in have if c not in later]:
            have = [c for c in have if c not in gone]
            now = now.groupBy(*(f"l{ord(c)}" for c in have)).agg(F.sum("v").alias("v"))
        if i < len(arrays):
            other, theirs = labelled(inputs[i], arrays[i])
            if alone := [c for c in theirs if c not in have and c not in set(out).union(*inputs[i + 1 :])]:
                theirs = [c for c in theirs if c not in alone]
                other = other.groupBy(*(f"l{ord(c)}" for c in theirs)).agg(F.sum("v").alias("v"))
            on = [f"l{ord(c)}" for c in theirs if c in have]
            other = other.withColumnRenamed("v", "w")
            mine, its = (math.prod(size[c] for c in labels) for labels in (have, theirs))
            now = (matched(now, other, on, mine, its) if on else now.crossJoin(F.broadcast(other) if arrays[i].size <= BROADCAST_CELLS else other)).withColumn("v", F.col("v") * F.col("w")).drop("w")
            have += [c for c in theirs if c not in have]
    result = now.groupBy(*(f"l{ord(c)}" for c in out if c in have)).agg(F.sum("v").alias("v"))
    result = result.select(*(F.col(f"l{ord(c)}").alias(f"i{k}") for k, c in enumerate(out)), F.coalesce("v", F.lit(0.0)).alias("v"))
    kind = promote(*(a.dtype for a in arrays))
    if kind.startswith(("int", "uint", "bool")):
        return NdFrame(result.withColumn("v", F.col("v").cast("long")), [size[c] for c in out], "int64")
    return NdFrame(result, [size[c] for c in out], "float64")


def dot(a: NdFrame, b: NdFrame) -> NdFrame:
    """Last axis of a with the last but one of b (its only one for a vector)."""
    if a.ndim == 0 or b.ndim == 0:
        return combine(a, b, lambda x, y: x * y)
    left = "".join(chr(97 + k) for k in range(a.ndim))
    right = "".join(chr(97 + a.ndim + k) for k in range(b.ndim))
    k = max(b.ndim - 2, 0)
    right = right[:k] + left[-1] + right[k + 1 :]
    return einsum(f"{left},{right}->{left[:-1]}{right.replace(left[-1], '')}", a, b)


def inner(a: NdFrame, b: NdFrame) -> NdFrame:
    left = "".join(chr(97 + k) for k in range(a.ndim))
    right = "".join(chr(97 + a.ndim + k) for k in range(b.ndim - 1)) + left[-1]
    return einsum(f"{left},{right}->{left[:-1]}{right[:-1]}", a, b)


def vdot(a: NdFrame, b: NdFrame) -> float:
    if a.dtype.startswith("complex") or b.dtype.startswith("complex"):
        raise TypeError("real arrays only")
    return float(einsum("i,i->", ravel(a), ravel(b)).item())


def matmul(a: NdFrame, b: NdFrame) -> NdFrame:
    """Stacked products: leading axes broadcast."""
    if a.ndim == 1 and b.ndim == 1:
        return einsum("i,i->", a, b)
    if a.ndim == 1:
        return einsum("i,...ij->...j", a, b)
    if b.ndim == 1:
        return einsum("...ij,j->...i", a, b)
    return einsum("...ij,...jk->...ik", a, b)


def outer(a: NdFrame, b: NdFrame) -> NdFrame:
    return einsum("i,j->ij", ravel(a), ravel(b))


def kron(a: NdFrame, b: NdFrame) -> NdFrame:
    """Index arithmetic over the outer product, rank 2."""
    p, q = b.shape
    both = einsum("ij,kl->ijkl", a, b)
    df = both.df.select((F.col("i0") * p + F.col("i2")).alias("i0"), (F.col("i1") * q + F.col("i3")).alias("i1"), "v")
    return NdFrame(df, (a.shape[0] * p, a.shape[1] * q), both.dtype)


def cross(a: NdFrame, b: NdFrame, axis: int = -1) -> NdFrame:
    """Of vectors with 2 or 3 components along an axis; two planar ones give scalars."""
    from .shape import moveaxis

    a, b = moveaxis(a, axis, -1), moveaxis(b, axis, -1)
    n, m, k = a.shape[-1], b.shape[-1], a.ndim - 1
    if n not in (2, 3) or m not in (2, 3):
        raise ValueError("two or three components are needed")
    rest = [f"i{j}" for j in range(k)]

    def wide(x: NdFrame, size: int, name: str):
        parts = [F.coalesce(F.max(F.when(F.col(f"i{k}") == j, F.col("v").cast("double"))), F.lit(0.0)).alias(f"{name}{j}") for j in range(3)]
        return x.df.groupBy(*rest).agg(*parts)

    both = matched(wide(a, n, "a"), wide(b, m, "b"), rest, a.size, b.size) if rest else wide(a, n, "a").crossJoin(F.broadcast(wide(b, m, "b")))
    c = lambda x, y: F.col(f"a{x}") * F.col(f"b{y}") - F.col(f"a{y}") * F.col(f"b{x}")
    if n == m == 2:
        return NdFrame(both.select(*rest, c(0, 1).alias("v")), a.shape[:-1])
    df = both.select(*rest, F.posexplode(F.array(c(1, 2), c(2, 0), c(0, 1))).alias(f"i{k}", "v")).withColumn(f"i{k}", F.col(f"i{k}").cast("long"))
    return moveaxis(NdFrame(df, (*a.shape[:-1], 3)), -1, axis)


def tensordot(a: NdFrame, b: NdFrame, axes: int | tuple[Sequence[int], Sequence[int]] = 2) -> NdFrame:
    mine, theirs = (range(a.ndim - axes, a.ndim), range(axes)) if isinstance(axes, int) else axes
    left = [chr(97 + k) for k in range(a.ndim)]
    right = [chr(97 + a.ndim + k) for k in range(b.ndim)]
    for i, j in zip(mine, theirs, strict=True):
        right[j] = left[i]
    shared = {left[i] for i in mine}
    return einsum(f"{''.join(left)},{''.join(right)}->{''.join(c for c in left + right if c not in shared)}", a, b)


def multi_dot(*arrays: NdFrame) -> NdFrame:
    out = arrays[0]
    for a in arrays[1:]:
        out = matmul(out, a)
    return out


def matrix_power(a: NdFrame, n: int) -> NdFrame:
    from ..plans.ordered import settled
    from ..sources.creation import eye
    from .linalg import inv

    if n < 0:
        a, n = inv(a), -n
    out = None
    while n:
        if n & 1:
            out = a if out is None else matmul(out, a)
        n >>= 1
        if n:
            a = matmul(a, a)
            a = NdFrame(settled(a.df), a.shape, a.dtype)  # the plan would double with every squaring
    return eye(a.df.sparkSession, a.shape[0]) if out is None else out


def einsum_trace(a: NdFrame) -> float:
    return float(einsum("ii->", a).item())


def einsum_diag(a: NdFrame) -> NdFrame:
    return einsum("ii->i", a)


def einsum_sum(a: NdFrame) -> float:
    left = "".join(chr(97 + k) for k in range(a.ndim))
    return float(einsum(f"{left}->", a).item())


def einsum_transpose(a: NdFrame) -> NdFrame:
    return transpose(a)


# --- array columns ----------------------------------------------------------------------------


def dot_arrays(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm_array(a: Column) -> Column:
    return F.sqrt(dot_arrays(a, a))


def cosine_arrays(a: Column, b: Column) -> Column:
    return F.try_divide(dot_arrays(a, b), norm_array(a) * norm_array(b))


