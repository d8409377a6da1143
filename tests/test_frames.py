"""Frames against NumPy: creation, shapes, reductions, windows, sorting, indexing, products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ndlattice.frame import from_columns, from_numpy
from ndlattice.operators import apply, fft, indexing, joining, linalg, products, random, reductions, shape, sorting, windows
from ndlattice.sources import creation

R = np.random.default_rng(3)
CUBE = (np.arange(24) * 1.25 - 7).reshape(2, 3, 4)
HOLES = np.array([[1.0, np.nan, 3.0, 3.0], [2.0, 5.0, np.nan, -1.0], [0.0, 4.0, 6.0, 7.0]])


def same(frame, expected, rtol=1e-9):
    got = frame.to_numpy()
    assert got.shape == np.shape(expected), (got.shape, np.shape(expected))
    assert frame.df.count() == np.size(expected)
    np.testing.assert_allclose(np.asarray(got, complex if np.iscomplexobj(expected) else float), np.asarray(expected, complex if np.iscomplexobj(expected) else float), rtol=rtol, atol=1e-9)


@pytest.fixture(scope="module")
def cube(spark):
    a = from_numpy(spark, CUBE)
    a.df = a.df.coalesce(1).cache()
    return a


@pytest.fixture(scope="module")
def holes(spark):
    a = from_numpy(spark, HOLES)
    a.df = a.df.coalesce(1).cache()
    return a


def test_creation(spark):
    same(creation.arange(spark, 1, 4, 0.5), np.arange(1, 4, 0.5))
    same(creation.linspace(spark, 0, 1, 7), np.linspace(0, 1, 7))
    same(creation.geomspace(spark, 1, 1000, 4), np.geomspace(1, 1000, 4))
    same(creation.eye(spark, 3, 4, 1), np.eye(3, 4, 1))
    same(creation.tri(spark, 3, 4, 1), np.tri(3, 4, 1))
    same(creation.vander(from_numpy(spark, [1.0, 2.0, 3.0]), 4), np.vander([1, 2, 3], 4))
    same(creation.diag(from_numpy(spark, [1.0, 2.0]), -1), np.diag([1, 2], -1))
    same(creation.indices(spark, (2, 3)), np.indices((2, 3)))
    for got, want in zip(creation.meshgrid(from_numpy(spark, [1.0, 2.0]), from_numpy(spark, [3.0, 4.0, 5.0])), np.meshgrid([1, 2], [3, 4, 5]), strict=True):
        same(got, want)
    for name in ("bartlett", "blackman", "hamming", "hanning"):
        same(getattr(creation, name)(spark, 9), getattr(np, name)(9))
    same(creation.kaiser(spark, 9, 14.0), np.kaiser(9, 14.0))
    same(creation.fftfreq(spark, 7, 0.5), np.fft.fftfreq(7, 0.5))
    same(creation.tile(from_numpy(spark, [[1.0, 2.0]]), (2, 2, 2)), np.tile([[1, 2]], (2, 2, 2)))
    same(creation.repeat(from_numpy(spark, [[1.0, 2.0]]), 3, 1), np.repeat([[1, 2]], 3, 1))
    same(creation.full(spark, (2, 2), 300, "uint8"), np.full((2, 2), 44))
    with pytest.raises(ValueError):
        creation.arange(spark, 0, 1, 0)


@pytest.mark.parametrize("axis", [None, 0, 1, -1])
def test_reductions(cube, axis):
    for name in ("sum", "prod", "mean", "var", "std", "max", "min", "argmax", "argmin", "ptp", "any", "all", "median"):
        same(getattr(reductions, name)(cube, axis), getattr(np, name)(CUBE, axis))
    same(reductions.count_nonzero(cube, axis, keepdims=True), np.count_nonzero(CUBE, axis, keepdims=True))
    same(reductions.percentile(cube, 30, axis), np.percentile(CUBE, 30, axis))
    same(reductions.std(cube, axis, 1), np.std(CUBE, axis, ddof=1))


@pytest.mark.parametrize("axis", [None, 0, 1])
def test_reductions_with_nan(holes, axis):
    for name in ("nansum", "nanprod", "nanmean", "nanstd", "nanmax", "nanmin", "nanmedian", "nanargmax", "nanargmin", "max", "min", "argmax", "argmin", "median"):
        same(getattr(reductions, name)(holes, axis), getattr(np, name)(HOLES, axis))
    with pytest.raises(ValueError):
        reductions.sum(holes, 2)


def test_integer_sums_wrap(spark):
    a = from_numpy(spark, np.array([2**31 - 1, 1], "int32"))
    assert reductions.sum(a).item() == -(2**31) and reductions.sum(a).dtype == "int32"
    assert reductions.prod(from_numpy(spark, np.array([2**62, 2], "int64"))).item() == -(2**63)
    same(reductions.average(from_numpy(spark, [1.0, 2.0, 3.0]), weights=from_numpy(spark, [1.0, 1.0, 2.0])), 2.25)


def test_windows(spark, cube):
    for axis in (None, 0, 2):
        same(windows.cumsum(cube, axis), np.cumsum(CUBE, axis))
        same(windows.cumprod(cube, axis), np.cumprod(CUBE, axis))
    same(windows.diff(cube, 2, 2), np.diff(CUBE, 2, 2))
    same(windows.gradient(cube, 2), np.gradient(CUBE, axis=2))
    same(windows.trapz(cube, dx=0.5, axis=1), np.trapezoid(CUBE, dx=0.5, axis=1))
    x = np.array([0, 1.0, 7.5, 8.0, 1.0, -6.0])
    same(windows.unwrap(from_numpy(spark, x)), np.unwrap(x))
    a, k = np.array([1.0, 2, 3, 4, 5]), np.array([1.0, 0.5, -1])
    for mode in ("full", "same", "valid"):
        same(windows.convolve(from_numpy(spark, a), from_numpy(spark, k), mode), np.convolve(a, k, mode))
        same(windows.correlate(from_numpy(spark, a), from_numpy(spark, k), mode), np.correlate(a, k, mode))
    same(windows.sliding_window_view(cube, 2, 2), np.lib.stride_tricks.sliding_window_view(CUBE, 2, 2))
    e = np.exp(CUBE - CUBE.max(-1, keepdims=True))
    same(windows.softmax(cube), e / e.sum(-1, keepdims=True))
    same(windows.ediff1d(from_numpy(spark, a), [9.0], [8.0]), np.ediff1d(a, [8.0], [9.0]))


def test_shapes(spark, cube):
    same(shape.reshape(cube, (4, -1)), CUBE.reshape(4, -1))
    same(shape.reshape(cube, (4, 6), "F"), CUBE.reshape((4, 6), order="F"))
    same(shape.transpose(cube, (2, 0, 1)), CUBE.transpose(2, 0, 1))
    same(shape.moveaxis(cube, 0, -1), np.moveaxis(CUBE, 0, -1))
    same(shape.rollaxis(cube, 2), np.rollaxis(CUBE, 2))
    same(shape.flip(cube, 1), np.flip(CUBE, 1))
    same(shape.rot90(shape.reshape(cube, (4, 6))), np.rot90(CUBE.reshape(4, 6)))
    same(shape.roll(cube, 5), np.roll(CUBE, 5))
    same(shape.roll(cube, -1, 2), np.roll(CUBE, -1, 2))
    same(shape.fftshift(cube), np.fft.fftshift(CUBE))
    same(shape.pad(shape.reshape(cube, (4, 6)), 2, 9.0), np.pad(CUBE.reshape(4, 6), 2, constant_values=9))
    same(shape.resize(cube, (5, 6)), np.resize(CUBE, (5, 6)))
    same(shape.tril(shape.reshape(cube, (4, 6)), 1), np.tril(CUBE.reshape(4, 6), 1))
    same(shape.triu(shape.reshape(cube, (4, 6)), 1), np.triu(CUBE.reshape(4, 6), 1))
    for got, want in zip(shape.array_split(cube, 3, 2), np.array_split(CUBE, 3, 2), strict=True):
        same(got, want)
    same(shape.squeeze(shape.expand_dims(cube, 1)), CUBE)
    row = from_numpy(spark, np.array([[10.0], [20.0], [30.0]]))
    same(shape.combine(cube, row, lambda a, b: a + b), CUBE + np.array([[10.0], [20.0], [30.0]]))
    same(shape.broadcast_to(row, (2, 3, 4)), np.broadcast_to([[10], [20], [30]], (2, 3, 4)))
    with pytest.raises(ValueError):
        shape.broadcast_to(row, (2, 2))


def test_joining(spark, cube):
    same(joining.concatenate([cube, cube], 1), np.concatenate([CUBE, CUBE], 1))
    same(joining.stack([cube, cube], 2), np.stack([CUBE, CUBE], 2))
    v = from_numpy(spark, [1.0, 2.0])
    for name in ("vstack", "hstack", "dstack", "column_stack"):
        same(getattr(joining, name)([v, v]), getattr(np, name)([[1, 2], [1, 2]]))
    same(joining.block([[v, v], [v, v]]), np.vstack([[1, 2, 1, 2]] * 2))


def test_sorting(spark, holes):
    for axis in (None, 0, 1):
        same(sorting.sort(holes, axis), np.sort(HOLES, axis))
        same(sorting.argsort(holes, axis), np.argsort(HOLES, axis, kind="stable"))
    keys = spark.createDataFrame([(0, 1, 2), (1, 0, 2), (2, 5, 1)], "i long, a int, b int")
    got = sorting.lexsort(keys, [F.col("a"), F.col("b")], F.col("i")).orderBy("i0")
    assert [r["v"] for r in got.collect()] == np.lexsort(([1, 0, 5], [2, 2, 1])).tolist()
    bins, xs = [1.0, 2.0, 2.0, 5.0], [0.0, 1.0, 2.0, 3.0, 5.0, 9.0, math.nan]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i long, x double")
    table = spark.createDataFrame([(b,) for b in bins], "b double")
    for side in ("left", "right"):
        want = np.searchsorted(bins, xs, side).tolist()
        assert [r["p"] for r in sorting.searchsorted(df, F.col("x"), bins, side, "p").orderBy("i").collect()] == want
        assert [r["p"] for r in sorting.searchsorted_join(df, "x", table, "b", side, "p").orderBy("i").collect()] == want
    for right in (False, True):
        for order in ([1.0, 2.0, 5.0], [5.0, 2.0, 1.0]):
            got = [r[0] for r in df.where("not isnan(x)").orderBy("i").select(sorting.digitize(F.col("x"), order, right)).collect()]
            assert got == np.digitize(xs[:-1], order, right).tolist()
    got = [r[0] for r in df.orderBy("i").select(sorting.interp(F.col("x"), [1, 2, 5], [10, 20, -10])).collect()]
    np.testing.assert_allclose(got, np.interp(xs, [1, 2, 5], [10, 20, -10]))


def test_indexing(spark, cube):
    flat = from_numpy(spark, np.arange(6.0))
    same(indexing.array_slice(cube, [slice(None, None, -1), slice(1, 3), slice(3, 0, -2)]), CUBE[::-1, 1:3, 3:0:-2])
    same(indexing.take(cube, [2, 0, -1], 1), np.take(CUBE, [2, 0, -1], 1))
    same(indexing.delete(cube, [0, -1], 2), np.delete(CUBE, [0, -1], 2))
    same(indexing._delete_long(cube, [0, 3], 2), np.delete(CUBE, [0, 3], 2))
    same(indexing.insert(flat, 2, from_numpy(spark, [7.0, 8.0])), np.insert(np.arange(6.0), 2, [7, 8]))
    same(indexing.put(flat, [0, -1, 0], [9.0, 8.0, 7.0]), [7, 1, 2, 3, 4, 8])
    same(indexing.place(flat, F.col("v") > 2, [1.5, 2.5]), [0, 1, 2, 1.5, 2.5, 1.5])
    same(indexing.putmask(flat, F.col("v") > 2, [1.5, 2.5]), [0, 1, 2, 2.5, 1.5, 2.5])
    same(indexing.extract(cube, F.col("v") > 5), CUBE[CUBE > 5])
    same(indexing.diagonal(cube, 1, 1, 2), np.diagonal(CUBE, 1, 1, 2))
    same(indexing.trace(cube, 0, 1, 2), np.trace(CUBE, 0, 1, 2))
    same(indexing.trim_zeros(from_numpy(spark, [0.0, 0, 1, 0, 2, 0])), [1, 0, 2])
    order = np.argsort(CUBE, 1)
    same(indexing.take_along_axis(cube, from_numpy(spark, order), 1), np.take_along_axis(CUBE, order, 1))
    same(indexing.as_strided(flat, (4, 3), (1, 1)), np.lib.stride_tricks.sliding_window_view(np.arange(6.0), 3))
    bits = np.array([1, 0, 1, 1, 0, 0, 0, 1, 1])
    same(indexing.packbits(from_numpy(spark, bits)), np.packbits(bits))
    same(indexing.unpackbits(indexing.packbits(from_numpy(spark, bits)), count=9), bits)
    i, j = (c.alias(n) for c, n in zip(indexing.unravel_index(F.col("id"), (2, 3)), "ij", strict=True))
    assert [(r["i"], r["j"]) for r in spark.range(6).select(i, j).collect()] == [(k // 3, k % 3) for k in range(6)]
    with pytest.raises(IndexError):
        indexing.take(flat, [6])


def test_products(spark, cube):
    a, b, m = R.normal(size=(3, 4)), R.normal(size=(4, 2)), R.normal(size=(2, 4, 5))
    fa, fb, fm = (from_numpy(spark, x) for x in (a, b, m))
    same(products.matmul(fa, fb), a @ b)
    same(products.matmul(cube, fm), CUBE @ m)
    same(products.dot(fa, fb), a.dot(b))
    same(products.inner(fa, fa), np.inner(a, a))
    same(products.kron(fa, fb), np.kron(a, b))
    same(products.outer(fa, fb), np.outer(a, b))
    same(products.tensordot(cube, fm, ([0, 2], [0, 1])), np.tensordot(CUBE, m, ([0, 2], [0, 1])))
    assert products.vdot(fa, fa) == pytest.approx(np.vdot(a, a))
    same(products.einsum("ij,jk", fa, fb), np.einsum("ij,jk", a, b))
    same(products.einsum("...ij->...i", cube), np.einsum("...ij->...i", CUBE))
    same(products.einsum("ij,ij,k->k", fa, fa, from_numpy(spark, [1.0, 2.0])), np.einsum("ij,ij,k->k", a, a, [1, 2]))
    u, v = R.normal(size=(4, 3)), R.normal(size=(4, 3))
    same(products.cross(from_numpy(spark, u), from_numpy(spark, v)), np.cross(u, v))
    s = R.normal(size=(3, 3))
    same(products.matrix_power(from_numpy(spark, s), 3), np.linalg.matrix_power(s, 3))
    same(products.einsum_diag(from_numpy(spark, s)), np.diag(s))


def test_linear_algebra(spark):
    s = R.normal(size=(2, 3, 3))
    h = s @ s.transpose(0, 2, 1) + 3 * np.eye(3)
    fs, fh, b = from_numpy(spark, s), from_numpy(spark, h), R.normal(size=(2, 3, 2))
    same(linalg.inv(fs), np.linalg.inv(s))
    same(linalg.det(fs), np.linalg.det(s))
    same(linalg.solve(fs, from_numpy(spark, b)), np.linalg.solve(s, b))
    same(linalg.cholesky(fh), np.linalg.cholesky(h))
    same(linalg.eigvalsh(fh), np.linalg.eigvalsh(h))
    same(linalg.svdvals(fs), np.linalg.svd(s, compute_uv=False))
    same(linalg.pinv(fs), np.linalg.pinv(s))
    same(linalg.norm(fs, 1, 2), np.linalg.norm(s, 1, 2))
    same(linalg.norm(fs), np.sqrt((s**2).sum()))
    x = R.normal(size=(40, 2))
    y = x @ [2.0, -3.0]
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    np.testing.assert_allclose(linalg.lstsq_table(df, ["a", "b"], "y"), [2, -3])
    np.testing.assert_allclose(linalg.svd_table(df, ["a", "b"])[0], np.linalg.svd(x, compute_uv=False))
    assert from_columns(df, ["a", "b"], F.col("a"), F.col("b")).shape == (40, 2)


def test_transforms(spark, cube):
    same(fft.fft(cube, 6), np.fft.fft(CUBE, 6))
    same(fft.rfft(cube), np.fft.rfft(CUBE))
    same(fft.irfft(fft.rfft(cube)), CUBE)
    same(fft.fft2(cube), np.fft.fft2(CUBE))
    same(fft.ifftn(cube), np.fft.ifftn(CUBE))
    same(fft.irfftn(fft.rfftn(cube)), CUBE)
    same(fft.dft_join(from_numpy(spark, CUBE.ravel())), np.fft.fft(CUBE.ravel()))


def test_callbacks(cube):
    same(apply.apply_along_axis(lambda x: x.max() - x.mean(), 1, cube), np.apply_along_axis(lambda x: x.max() - x.mean(), 1, CUBE))
    same(apply.apply_along_axis(lambda x: x[:2], 1, cube, (2,)), CUBE[:, :2])
    same(apply.apply_over_axes(np.sum, [0, 2], cube), np.apply_over_axes(np.sum, CUBE, [0, 2]))
    same(cube.map(apply.vectorize(lambda x: x * 2 + 1)), CUBE * 2 + 1)


def test_random(spark):
    n = 4000
    u = random.uniform(spark, 2, 5, (n,)).to_numpy()
    assert 2 <= u.min() and u.max() < 5 and abs(u.mean() - 3.5) < 0.1
    for name, args, mean in (("exponential", (2.0,), 2.0), ("rayleigh", (2.0,), 2.0 * math.sqrt(math.pi / 2)), ("triangular", (0.0, 1.0, 5.0), 2.0), ("geometric", (0.25,), 4.0), ("logistic", (1.0, 1.0), 1.0)):
        assert random.inverse(spark, name, (n,), *args).to_numpy().mean() == pytest.approx(mean, abs=0.2)
    for name, args, mean in (("gamma", (2.0, 3.0), 6.0), ("binomial", (10, 0.3), 3.0), ("poisson", (4.0,), 4.0), ("wald", (2.0, 3.0), 2.0)):
        got = random.sample(spark, name, (n,), *args)
        assert got.to_numpy().mean() == pytest.approx(mean, abs=0.3)
    np.testing.assert_allclose(random.dirichlet(spark, [1.0, 2.0], 50).to_numpy().sum(1), 1)
    values, p = from_numpy(spark, [10.0, 20.0, 30.0]), from_numpy(spark, [0.05, 0.15, 0.8])
    assert random.choice(values, n, True, p).to_numpy().mean() == pytest.approx(27.5, abs=0.5)
    assert sorted(random.choice(values, 3, False).to_numpy()) == [10, 20, 30]
    assert sorted(random.permutation(values).to_numpy()) == [10, 20, 30]


def _broadcasts(df):
    return str(df._jdf.queryExecution().executedPlan()).count("BroadcastExchange")


def test_large_frames_are_not_broadcast(spark):
    """A spread frame looks as small as what it is spread from."""
    n = 60_000
    wide, high = shape.broadcast_arrays(creation.arange(spark, 0, n), creation.from_rule(spark, (2, 1), lambda i, j: i.cast("double")))
    both = shape.combine(wide, high, lambda x, y: x + y)
    assert _broadcasts(both.df) == 0
    assert both.df.agg(F.count("*"), F.sum("v")).first()[:] == (2 * n, n * (n - 1) + n)
    few = shape.combine(wide, creation.from_rule(spark, (2, 1), lambda i, j: i.cast("double")), lambda x, y: x + y)
    assert _broadcasts(few.df) == 1 and few.df.agg(F.sum("v")).first()[0] == n * (n - 1) + n


def test_large_operands_are_not_broadcast(spark):
    n = 60_000
    two = shape.broadcast_to(creation.from_rule(spark, (1, 2), lambda i, j: j + 1.0), (n, 2))
    product = products.einsum("nj,nj->n", two, two)
    assert _broadcasts(product.df) == 0
    assert product.df.agg(F.count("*"), F.sum("v")).first()[:] == (n, 5.0 * n)
    assert _broadcasts(products.cross(two, two).df) == 0
    assert _broadcasts(linalg.lines(two, 1, np.dot, (), other=two, other_core=1).df) == 0
