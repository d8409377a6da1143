"""Files in and out, ordered plans and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ndlattice.frame import NdFrame, from_numpy
from ndlattice.plans import ordered
from ndlattice.sources import binary, text
from ndlattice.streaming import windows


def test_npy(spark, tmp_path):
    for i, a in enumerate([np.arange(12.0).reshape(3, 4), np.asfortranarray(np.arange(6, dtype=">i4").reshape(2, 3)), np.array([1 + 2j, 3]), np.array(["ab", "c"]), np.array([1, 255], "uint8")]):
        path = str(tmp_path / f"{i}.npy")
        np.save(path, a)
        got = binary.load(spark, path)
        assert got.shape == a.shape
        assert (got.to_numpy().astype(a.dtype.newbyteorder("=")) == a).all()
    a = np.arange(12.0).reshape(3, 4)
    path = str(tmp_path / "0.npy")
    binary.save(from_numpy(spark, a * 2), str(tmp_path / "out.npy"))
    np.testing.assert_array_equal(np.load(tmp_path / "out.npy"), a * 2)
    binary.register(spark)
    rows = spark.read.format("npy").option("pieces", 2).load(path).orderBy("i0", "i1").collect()
    assert [r["v"] for r in rows] == a.ravel().tolist() and rows[-1]["i0"] == 2


def test_npz_and_raw(spark, tmp_path):
    a, b = np.arange(5.0), np.arange(6).reshape(2, 3)
    np.savez_compressed(tmp_path / "x.npz", a=a, b=b)
    got = binary.loadz(spark, str(tmp_path / "x.npz"))
    np.testing.assert_array_equal(got["a"].to_numpy(), a)
    np.testing.assert_array_equal(got["b"].to_numpy(), b)
    binary.savez(spark, str(tmp_path / "y.npz"), from_numpy(spark, a), b=from_numpy(spark, b))
    with np.load(tmp_path / "y.npz") as z:
        np.testing.assert_array_equal(z["arr_0"], a)
        np.testing.assert_array_equal(z["b"], b)
    binary.tofile(from_numpy(spark, a), str(tmp_path / "raw.bin"))
    np.testing.assert_array_equal(binary.fromfile(spark, str(tmp_path / "raw.bin"), count=3, offset=8).to_numpy(), a[1:4])
    np.testing.assert_array_equal(binary.memmap(spark, str(tmp_path / "raw.bin"), (5, 1)).to_numpy(), a.reshape(5, 1))
    np.testing.assert_array_equal(binary.frombuffer(spark, a.tobytes()).to_numpy(), a)
    np.testing.assert_array_equal(binary.newbyteorder(from_numpy(spark, b.astype("int32"))).to_numpy(), b.astype("int32").byteswap())
    df = spark.createDataFrame([(1.5,), (-0.25,)], "x double")
    assert [r[0] for r in df.select(binary.half_to_float(binary.float_to_half(F.col("x")))).collect()] == [1.5, -0.25]
    binary.save_cells(from_numpy(spark, b), str(tmp_path / "cells"))
    np.testing.assert_array_equal(binary.load_cells(spark, str(tmp_path / "cells"), (2, 3), "int64").to_numpy(), b)


def test_text(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("# head\n1,2\n\n3,4 # tail\n5,6\n")
    np.testing.assert_array_equal(text.loadtxt(spark, str(f), ",").to_numpy(), [[1, 2], [3, 4], [5, 6]])
    f.write_text("x y\n1 N/A\nfoo 4\n5 6\n")
    np.testing.assert_array_equal(text.genfromtxt(spark, str(f), None, 1, 2).to_numpy(), [[1, np.nan], [np.nan, 4]])
    assert [r["record"]["f1"] for r in text.recfromtxt(spark, str(f), None, 2).orderBy("i0").collect()] == [4, 6]
    f.write_text("1 2\n3\n")
    with pytest.raises(ValueError):
        text.loadtxt(spark, str(f))
    f.write_text("1 2 3\n")
    assert text.loadtxt(spark, str(f)).shape == (3,)
    a = from_numpy(spark, np.array([[1.5, 2.0], [3.0, 4.25]]))
    text.savetxt(a, str(tmp_path / "out"), ",", "%.2f")
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(lines) == ["1.50,2.00", "3.00,4.25"]
    assert text.array_to_csv(a) == "1.5,2.0\n3.0,4.25"


def test_ordered_plans(spark):
    rng = np.random.default_rng(1)
    values = rng.integers(0, 50, 997)
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(values)], "i long, v long").repartition(7)
    order = np.lexsort((np.arange(997), values))
    got = ordered.positions(df, F.col("v"), F.col("i"), name="p").orderBy("p").collect()
    assert [r["i"] for r in got] == order.tolist() and [r["p"] for r in got] == list(range(997))
    got = ordered.running(df, F.col("v"), F.col("i")).orderBy("i").collect()
    assert [r["running"] for r in got] == np.cumsum(values).tolist()
    got = ordered.neighbours(df, F.col("v"), 2, 1, F.col("i")).orderBy("i").collect()
    assert [r["near"] for r in got] == [values[max(0, k - 2) : k + 2].tolist() for k in range(997)]


def test_streaming(spark, tmp_path):
    base = spark.range(100).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    base.coalesce(2).write.parquet(str(tmp_path / "in"))
    events = windows.read(spark, str(tmp_path / "in"))
    for name, df in (("tumble", windows.tumbling(events, "ts", "10 minutes", "1 hour", ["k"], n=F.count("*"), v=F.sum("v"))), ("gaps", windows.sessions(events, "ts", "5 minutes", "1 hour", ["k"], n=F.count("*")))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append" if name == "gaps" else "complete").start()
        q.processAllAvailable()
        q.stop()
    assert spark.sql("SELECT sum(n) AS n, sum(v) AS v FROM tumble").first()["n"] == 100


def _never(self):
    raise AssertionError("all cells on the driver")


def test_raw_files_are_written_in_parts(spark, tmp_path, monkeypatch):
    a = np.arange(30_000.0).reshape(3000, 10) / 7
    frame = NdFrame(spark.range(30_000).repartition(7).select(F.expr("id div 10").alias("i0"), (F.col("id") % 10).alias("i1"), (F.col("id") / 7).alias("v")), a.shape)
    monkeypatch.setattr(NdFrame, "to_numpy", _never)
    monkeypatch.setattr(binary, "RANGE", 4000, raising=False)
    binary.tofile(frame, str(tmp_path / "a.bin"))
    assert (tmp_path / "a.bin").read_bytes() == a.tobytes()
    got = binary.memmap(spark, str(tmp_path / "a.bin"), (3000, 10)).df
    assert got.join(frame.df, ["i0", "i1", "v"]).count() == a.size
    with pytest.raises(Exception, match="cells"):
        binary.tofile(NdFrame(frame.df.where("i0 != 5"), a.shape), str(tmp_path / "b.bin"))


def test_npz_files_are_written_in_parts(spark, tmp_path, monkeypatch):
    a, z = np.arange(24).reshape(2, 3, 4).astype("int32"), np.array([1 - 2j, 3.5])
    whole, odd = from_numpy(spark, a), from_numpy(spark, z)
    read = NdFrame.to_numpy
    monkeypatch.setattr(NdFrame, "to_numpy", _never)
    binary.savez(spark, str(tmp_path / "x.npz"), whole, odd=odd)
    monkeypatch.setattr(NdFrame, "to_numpy", read)
    with np.load(tmp_path / "x.npz") as found:
        assert found["arr_0"].dtype == a.dtype and (found["arr_0"] == a).all() and (found["odd"] == z).all()
    content = bytearray((tmp_path / "x.npz").read_bytes())
    content[content.index(a.tobytes()) + 5] ^= 1
    (tmp_path / "bad.npz").write_bytes(content)
    with pytest.raises(Exception, match="CRC"):
        binary.loadz(spark, str(tmp_path / "bad.npz"))["arr_0"].df.count()


def test_npy_files_are_written_in_parts(spark, tmp_path, monkeypatch):
    arrays = [np.array([[True, False], [False, True]]), np.array([250, 1], "uint8"), np.array([1.5, np.nan, -0.0], "float16"), np.array([1j, 2.0]), np.array(7.25), np.zeros((0, 3))]
    frames = [from_numpy(spark, a) for a in arrays]
    arrays.append(np.array([1 << 63, 5], "uint64"))
    frames.append(NdFrame(spark.sql("SELECT * FROM VALUES (0L, cast(9223372036854775808 AS decimal(20, 0))), (1L, 5) t(i0, v)"), (2,), "uint64"))
    monkeypatch.setattr(NdFrame, "to_numpy", _never)
    for i, (a, frame) in enumerate(zip(arrays, frames, strict=True)):
        binary.save(frame, str(tmp_path / f"{i}.npy"))
        assert (tmp_path / f"{i}.npy").read_bytes() == binary.npy_bytes(a)


def test_part_of_a_raw_file(spark, tmp_path, monkeypatch):
    frame = NdFrame(spark.range(5000).repartition(5).select(F.col("id").alias("i0"), (F.col("id") / 3).alias("v")), (5000,))
    monkeypatch.setattr(NdFrame, "to_numpy", _never)
    binary.tofile(frame, str(tmp_path / "a.bin"))
    part = binary.fromfile(spark, str(tmp_path / "a.bin"), "float64", 4995, 16)
    assert part.shape == (4995,)
    assert part.df.select((F.col("i0") + 2).alias("i0"), "v").exceptAll(frame.df).count() == 0 and part.df.count() == 4995
