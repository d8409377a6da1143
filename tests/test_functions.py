"""Text, date, finance, mask, record, complex and polynomial functions."""

import cmath
import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ndlattice import meta
from ndlattice.functions import complexes as Z
from ndlattice.functions import dates as D
from ndlattice.functions import finance as M
from ndlattice.functions import masked as K
from ndlattice.functions import polynomials as P
from ndlattice.functions import records
from ndlattice.functions import strings as T


def test_strings(spark):
    texts = [" Ab ", "xy", "", "-3", "a,b,,c", "äöü a"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    s = F.col("s")
    rows = df.select(T.char_upper(s).alias("u"), T.char_strip(s).alias("st"), T.char_zfill(s, 5).alias("z"), T.char_center(s, 7, "*").alias("c"), T.char_strlen(s).alias("n"), T.char_count(s, "a").alias("k"), T.char_count(s, "").alias("k0"), T.char_find(s, "a").alias("f"), T.char_split(s, ",").alias("sp"), T.char_split(s).alias("ws"), T.char_join(s, "-").alias("j"), T.char_replace(s, ",", ";", 1).alias("r"), T.char_multiply(s, -2).alias("m"), T.char_ljust(s, 4, ".").alias("l")).collect()
    for t, r in zip(texts, rows, strict=True):
        assert r["st"] == t.strip() and r["z"] == t.zfill(5) and r["c"] == t.center(7, "*") and r["l"] == t.ljust(4, ".")
        assert r["n"] == len(t.encode()) and r["k"] == t.count("a") and r["k0"] == len(t) + 1 and r["f"] == t.encode().find(b"a")
        assert r["sp"] == t.split(",") and r["ws"] == t.split() and r["j"] == "-".join(t) and r["r"] == t.replace(",", ";", 1) and r["m"] == ""
        assert r["u"] == "".join(c.upper() if c.isascii() else c for c in t)
    with pytest.raises(ValueError):
        T.char_center(s, -1)
    nums = spark.createDataFrame([(5,), (-5,), (0,)], "n long").select(T.binary_repr(F.col("n")).alias("b"), T.binary_repr(F.col("n"), 6).alias("w"), T.base_repr(F.col("n"), 16, 2).alias("h")).collect()
    assert [(r["b"], r["w"]) for r in nums] == [(np.binary_repr(n), np.binary_repr(n, 6)) for n in (5, -5, 0)]
    assert [r["h"] for r in nums[:2]] == ["005", "-005"]
    got = spark.createDataFrame([("1; 2.5;x",)], "s string").select(T.from_text(s, ";").alias("v"), T.from_regex(F.lit("a=1 b=2"), r"(\w)=(\d)", {"k": "string", "n": "int"}).alias("r")).first()
    assert got["v"] == [1.0, 2.5, None] and [(x["k"], x["n"]) for x in got["r"]] == [("a", 1), ("b", 2)]
    assert T.safe_eval("0x1F") == 31 and T.safe_eval("1_000.5") == 1000.5
    with pytest.raises(ValueError):
        T.safe_eval("__import__('os')")


def test_dates(spark):
    days = [dt.date(1969, 12, 28) + dt.timedelta(k) for k in range(0, 24)] + [dt.date(2024, 2, 29)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    ticks = D.from_timestamp(F.col("d").cast("timestamp"), "D")
    rows = df.select(ticks.alias("t"), D.is_busday(ticks).alias("b"), D.busday_count(F.lit(3), ticks).alias("n"), D.to_string(ticks, "D").alias("s"), D.from_string(D.to_string(ticks, "D"), "D").alias("p"), D.to_date(ticks, "D").alias("p3"), D.convert(ticks, "D", "h").alias("h")).collect()
    for d, r in zip(days, rows, strict=True):
        assert r["t"] == (d - dt.date(1970, 1, 1)).days == r["p"] and r["b"] == bool(np.is_busday(d)) and r["s"] == d.isoformat() and r["h"] == r["t"] * 24
        assert r["n"] == np.busday_count(np.datetime64(3, "D"), np.datetime64(d))
        assert tuple(r["p3"]) == (d.year, d.month, d.day)
    work = df.where(D.is_busday(ticks)).select("d", *(D.busday_offset(ticks, F.lit(k)).alias(f"o{i}") for i, k in enumerate((-7, -1, 0, 1, 12)))).collect()
    for r in work:
        for i, k in enumerate((-7, -1, 0, 1, 12)):
            assert np.datetime64(r[f"o{i}"], "D") == np.busday_offset(np.datetime64(r["d"]), k)
    assert df.limit(1).select(D.to_string(F.lit(None).cast("long"), "D")).first()[0] == "NaT"
    with pytest.raises(ValueError):
        D.to_string(F.lit(1), "x")


def test_finance(spark):
    r = spark.range(1).select(M.fv(0.05, 10, -100.0, -1000.0).alias("fv"), M.pv(0.05, 10, -100.0).alias("pv"), M.pmt(0.05, 10, 1000.0).alias("pmt"), M.nper(0.05, -129.50457496545667, 1000.0).alias("n"), M.rate(10, -129.50457496545667, 1000.0).alias("r"), M.irr(F.array(*map(F.lit, (-100.0, 39.0, 59.0, 55.0, 20.0)))).alias("irr"), M.irr(F.array(F.lit(1.0), F.lit(2.0))).alias("none"), M.fv(0.0, 10, -1.0, 0.0).alias("z")).first()
    assert r["fv"] == pytest.approx(2886.6838) and r["pv"] == pytest.approx(772.1735) and r["pmt"] == pytest.approx(-129.504575)
    assert r["n"] == pytest.approx(10) and r["r"] == pytest.approx(0.05) and r["irr"] == pytest.approx(0.28094842) and r["none"] is None and r["z"] == 10


def test_masks_and_records(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1.0, math.nan, -2.0, 5.0])], "i long, v double")
    m = K.masked_invalid(F.col("v"), -9.0)
    assert [r[0] for r in df.select(m.filled()).collect()] == [1, -9, -2, 5]
    assert tuple(df.agg(m.count(), m.sum(), m.min(), m.max()).first()) == (3, 4, -2, 5)
    none = K.masked_where(F.lit(True), F.col("v"))
    assert tuple(df.agg(none.count(), none.mean(), none.std(), none.min()).first()) == (0, 0, 0, 0)
    rec = df.select("i", records.make(a=F.col("i"), b=F.col("v")).alias("r"))
    assert records.get_record(rec, "r", "i", -1, 4).first()["b"] == 5
    assert records.set_record(rec, "r", "i", 0, b=7.0).where("i = 0").first()["r"]["b"] == 7
    kind = records.struct_dtype({"id": "int32", "score": "float64"})
    assert records.field_offsets(kind) == {"id": 0, "score": 4} and records.struct_itemsize(kind) == 12 and records.find_field(kind, "x") == -1


def test_complex(spark):
    zs = [(3.0, 4.0), (-1.0, 0.0), (0.5, -2.0)]
    df = spark.createDataFrame(zs, "a double, b double")
    z = Z.make(F.col("a"), F.col("b"))
    rows = df.select(Z.sqrt(z).alias("sqrt"), Z.log(z).alias("log"), Z.exp(z).alias("exp"), Z.divide(z, Z.make(1.0, 2.0)).alias("div"), Z.sin(z).alias("sin"), Z.emath_arcsin(F.col("b")).alias("asin"), Z.emath_arctanh(F.col("b")).alias("atanh")).collect()
    for (a, b), r in zip(zs, rows, strict=True):
        w = complex(a, b)
        for name, want in (("sqrt", cmath.sqrt(w)), ("log", cmath.log(w)), ("exp", cmath.exp(w)), ("div", w / (1 + 2j)), ("sin", cmath.sin(w)), ("asin", np.emath.arcsin(b)), ("atanh", np.emath.arctanh(b))):
            assert complex(r[name]["re"], r[name]["im"]) == pytest.approx(complex(want)), name
    assert dict(Z.emath(df, "a", "sqrt").dtypes)["sqrt"].startswith("struct") and dict(Z.emath(df.where("a > 0"), "a", "sqrt").dtypes)["sqrt"] == "double"
    assert dict(Z.real_if_close(df.select(Z.make(F.col("a"), 0.0).alias("z")), "z").dtypes)["z"] == "double"


def test_polynomials(spark):
    xs = np.linspace(-1, 1, 30)
    df = spark.createDataFrame([(float(x), float(2 * x**3 - x + 0.5)) for x in xs], "x double, y double")
    c = [0.5, -1.0, 2.0, 0.25, 1.5]
    x = F.col("x")
    rows = df.select(P.chebval(x, c).alias("cheb"), P.legval(x, c).alias("leg"), P.hermval(x, c).alias("herm"), P.lagval(x, c).alias("lag"), P.polyval(c, x).alias("poly")).collect()
    for name, module in (("cheb", np.polynomial.chebyshev.chebval), ("leg", np.polynomial.legendre.legval), ("herm", np.polynomial.hermite.hermval), ("lag", np.polynomial.laguerre.lagval)):
        np.testing.assert_allclose([r[name] for r in rows], module(xs, c), atol=1e-12)
    np.testing.assert_allclose([r["poly"] for r in rows], np.polyval(c, xs), atol=1e-12)
    np.testing.assert_allclose(P.polyfit(df, "x", "y", 3), [2, 0, -1, 0.5], atol=1e-9)
    np.testing.assert_allclose(P.chebfit(df, "x", "y", 3), np.polynomial.chebyshev.chebfit(xs, 2 * xs**3 - xs + 0.5, 3), atol=1e-9)
    np.testing.assert_allclose(P.legfit(df, "x", "y", 3), np.polynomial.legendre.legfit(xs, 2 * xs**3 - xs + 0.5, 3), atol=1e-9)


def test_types():
    assert meta.promote("int32", "uint32") == "int64" and meta.promote("int64", "uint64") == "float64" and meta.promote("int16", "float32") == "float32"
    assert meta.accumulator("int8") == "int32" and meta.accumulator("int64") == "int64"
    assert meta.can_cast("int32", "float64") and not meta.can_cast("float64", "int32") and meta.can_cast("float64", "float32", "same_kind")
    assert meta.broadcast_shapes((3, 1), (4,)) == (3, 4) and not meta.can_broadcast((3,), (4,))
    assert meta.min_scalar_type(1.0) == "float16" and meta.min_scalar_type(1e6) == "float32" and meta.min_scalar_type(1e300) == "float64"
    assert meta.iinfo("int8") == (-128, 127) and meta.finfo("float64")["eps"] == np.finfo(float).eps
    assert meta.NdMeta((2, 3), "float32").nbytes == 24 and meta.NdMeta((2, 3), "float32").strides == (3, 1)
