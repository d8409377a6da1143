"""NPY, NPZ and raw binary arrays: read by Spark's own file reader, decoded file by file.

Importing registers nothing; ``register(spark)`` makes NPY files a format: spark.read.format("npy").
"""

from __future__ import annotations

import io
import math
import zipfile
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..frame import NdFrame
from ..meta import SPARK
from ..plans.ordered import settled

#: Cells in one Arrow batch.
BATCH = 1 << 16
#: Cells that the driver fetches at once.
RANGE = 1 << 20


def _header(content: bytes) -> tuple[tuple[int, ...], bool, np.dtype, int]:
    """Shape, column-major flag, dtype and first byte of the cells."""
    f = io.BytesIO(content)
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, kind = read(f)
    if kind.hasobject:
        raise ValueError("object arrays are not read")
    return shape, fortran, kind, f.tell()


def _name(kind: np.dtype) -> str:
    return {"U": "str", "S": "bytes", "M": "datetime64", "m": "timedelta64"}.get(kind.kind, kind.newbyteorder("=").name)


def _batches(a: np.ndarray, keys: dict[str, str] | None = None) -> Iterator[pa.RecordBatch]:
    """Cells i0.., v of an array, in row-major order."""
    flat = np.ascontiguousarray(a).ravel()
    for at in range(0, flat.size, BATCH):
        v = flat[at : at + BATCH]
        index = np.unravel_index(np.arange(at, at + len(v)), a.shape) if a.ndim else []
        if v.dtype.kind == "c":
            values = pa.StructArray.from_arrays([pa.array(v.real.astype(float)), pa.array(v.imag.astype(float))], ["re", "im"])
        elif v.dtype.kind in "Mm":
            values = pa.array(v.astype("int64"))
        else:
            name = _name(v.dtype)
            values = pa.array(v.tolist() if name in ("str", "bytes", "uint64", "uint8", "uint16", "uint32", "float16") else v.astype(v.dtype.newbyteorder("=")), _ARROW.get(name))
        parts = [pa.array([x] * len(v)) for x in (keys or {}).values()] + [pa.array(np.asarray(i, np.int64)) for i in index] + [values]
        yield pa.RecordBatch.from_arrays(parts, names=[*(keys or {}), *(f"i{k}" for k in range(a.ndim)), "v"])


_ARROW = {"uint8": pa.int16(), "uint16": pa.int32(), "uint32": pa.int64(), "uint64": pa.decimal128(20, 0), "float16": pa.float32()}


def _cells(spark: SparkSession, path: str, ndim: int, dtype: str, decode) -> DataFrame:
    schema = ", ".join([*(f"i{k} long" for k in range(ndim)), f"v {SPARK[dtype].simpleString()}"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from _batches(decode(content.as_buffer()))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, schema)


def load(spark: SparkSession, path: str) -> NdFrame:
    """One NPY file, versions 1 and 2, either byte order and layout."""
    head = spark.read.format("binaryFile").load(path).select(F.expr("substring(content, 1, 65536)").alias("content")).first()
    shape, _, kind, _ = _header(bytes(head["content"]))
    return NdFrame(_cells(spark, path, len(shape), _name(kind), lambda c: np.lib.format.read_array(pa.BufferReader(c), allow_pickle=False)), shape, _name(kind))


def npy_bytes(a: np.ndarray) -> bytes:
    f = io.BytesIO()
    np.save(f, a, allow_pickle=False)
    return f.getvalue()


def _plain(a: NdFrame) -> np.dtype:
    """Type of a frame's cells in a file."""
    if a.dtype in ("str", "bytes", "datetime64", "timedelta64"):
        raise ValueError(f"cells of {a.dtype} are not written to binary files")
    return np.dtype("complex128" if a.dtype.startswith("complex") else a.dtype)


def _packed(a: NdFrame) -> Iterator[bytes]:
    """The cells' bytes in row-major order, a part at a time.

    Tasks sort ranges of cells and pack them; the driver fetches one range of about RANGE cells after another.
    """
    kind, name = _plain(a), a.dtype

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at, v = batch.column(0).to_numpy(), batch.column(1)
            if (np.diff(at) != 1).any():
                raise ValueError("cells are missing or occur twice")
            if pa.types.is_struct(v.type):
                values = v.field("re").to_numpy(zero_copy_only=False) + 1j * v.field("im").to_numpy(zero_copy_only=False)
            elif v.null_count and kind.kind != "f":
                raise ValueError(f"null cells in an array of {name}")
            else:
                values = (v.cast(pa.uint64()) if pa.types.is_decimal(v.type) else v).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array([int(at[0])], pa.int64()), pa.array([values.astype(kind).tobytes()], pa.binary())], names=["at", "cells"])

    df = a.df.select(a.flat().alias("at"), "v")
    if a.ndim:
        width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartitionByRange(max(width, -(-a.size // RANGE)), "at").sortWithinPartitions("at")
    done = 0
    for row in settled(df.mapInArrow(pack, "at long, cells binary")).toLocalIterator():
        if row["at"] != done:
            raise ValueError("cells are missing or occur twice")
        done += len(row["cells"]) // kind.itemsize
        yield bytes(row["cells"])
    if done != a.size:
        raise ValueError(f"{done} of {a.size} cells found")


def _npy(a: NdFrame) -> Iterator[bytes]:
    f = io.BytesIO()
    np.lib.format.write_array_header_1_0(f, {"descr": np.lib.format.dtype_to_descr(_plain(a)), "fortran_order": False, "shape": a.shape})
    yield f.getvalue()
    yield from _packed(a)


class _Sink:
    """A new file in the file system that Spark knows the path by; bytes are written one after another."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        self.out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)

    def write(self, content: bytes) -> int:
        for at in range(0, len(content), 1 << 20):
            self.out.write(bytearray(content[at : at + (1 << 20)]))
        return len(content)

    def flush(self) -> None:
        self.out.flush()

    def __enter__(self) -> _Sink:
        return self

    def __exit__(self, *error) -> None:
        self.out.close()


def save(a: NdFrame, path: str) -> None:
    """An export as one NPY file, written part by part; for Spark's own use Parquet (``save_cells``) has many."""
    with _Sink(a.df.sparkSession, path) as f:
        for part in _npy(a):
            f.write(part)


def savez(spark: SparkSession, path: str, *auto: NdFrame, **named: NdFrame) -> None:
    with _Sink(spark, path) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_STORED) as z:
        for name, a in {**{f"arr_{i}": a for i, a in enumerate(auto)}, **named}.items():
            with z.open(f"{name}.npy", "w", force_zip64=True) as member:
                for part in _npy(a):
                    member.write(part)


def loadz(spark: SparkSession, path: str) -> dict[str, NdFrame]:
    """Members of an NPZ file; checksums are tested, compressed members inflated."""
    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as z:
                    rows = []
                    for name in z.namelist():
                        with z.open(name) as f:
                            shape, _, kind, _ = _header(f.read(65536))
                        rows.append((name, [int(n) for n in shape], _name(kind)))
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.string())], names=["name", "shape", "kind"])

    def member(name: str):
        def decode(content: pa.Buffer) -> np.ndarray:
            with zipfile.ZipFile(pa.BufferReader(content)) as z, z.open(name) as f:
                a = np.lib.format.read_array(f, allow_pickle=False)
                f.read()  # the checksum is tested at the end
                return a

        return decode

    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(heads, "name string, shape array<long>, kind string").collect()
    return {r["name"].removesuffix(".npy"): NdFrame(_cells(spark, path, len(r["shape"]), r["kind"], member(r["name"])), r["shape"], r["kind"]) for r in found}


def save_cells(a: NdFrame, path: str) -> None:
    """The native form: Parquet in ranges of the first axis."""
    df = a.df.repartitionByRange(*a.idx).sortWithinPartitions(*a.idx) if a.ndim else a.df
    df.write.mode("overwrite").parquet(path)


def load_cells(spark: SparkSession, path: str, shape: Sequence[int], dtype: str = "float64") -> NdFrame:
    return NdFrame(spark.read.parquet(path), shape, dtype)


def fromfile(spark: SparkSession, path: str, dtype: str = "float64", count: int = -1, offset: int = 0) -> NdFrame:
    """Raw cells behind an offset."""
    size = spark.read.format("binaryFile").load(path).select("length").first()[0]
    n = max(0, (size - offset) // np.dtype(dtype).itemsize)
    n = n if count < 0 else min(n, count)
    return NdFrame(_cells(spark, path, 1, dtype, lambda c: np.frombuffer(c, dtype, n, offset)), (n,), dtype)


def tofile(a: NdFrame, path: str) -> None:
    with _Sink(a.df.sparkSession, path) as f:
        for part in _packed(a):
            f.write(part)


def memmap(spark: SparkSession, path: str, shape: Sequence[int], dtype: str = "float64", offset: int = 0) -> NdFrame:
    """A raw file as an array; changes are made by writing a new version (``tofile``)."""
    from ..operators.shape import reshape

    return reshape(fromfile(spark, path, dtype, math.prod(shape), offset), shape)


def frombuffer(spark: SparkSession, buffer: bytes, dtype: str = "float64") -> NdFrame:
    from ..frame import from_numpy

    return from_numpy(spark, np.frombuffer(buffer, dtype))


def newbyteorder(a: NdFrame) -> NdFrame:
    """Every value with its bytes reversed."""
    kind = np.dtype(a.dtype)

    @F.pandas_udf(SPARK[a.dtype])
    def swap(v: pd.Series) -> pd.Series:
        return pd.Series(v.to_numpy(kind).byteswap())

    return a.map(swap)


def getfield(values: DataFrame, column: str, dtype: str, offset: int) -> DataFrame:
    """Bytes at an offset of a binary column, read as a number."""
    kind = np.dtype(dtype)

    @F.pandas_udf(SPARK[dtype])
    def read(v: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, kind, 1, offset)[0] for x in v], dtype=kind)

    return values.withColumn(column, read(F.col(column)))


def float_to_half(x):
    """Column of 16-bit patterns of doubles."""
    @F.pandas_udf("int")
    def bits(v: pd.Series) -> pd.Series:
        return pd.Series(v.to_numpy(np.float64).astype(np.float16).view(np.uint16).astype("int32"))

    return bits(x.cast("double"))


def half_to_float(x):
    @F.pandas_udf("double")
    def value(v: pd.Series) -> pd.Series:
        return pd.Series(v.to_numpy(np.uint16).view(np.float16).astype(np.float64))

    return value(x.cast("int"))


# --- as a format ------------------------------------------------------------------------------


class NpySource(DataSource):
    """spark.read.format("npy").load(path): columns i0.., v of a local or mounted NPY file, one partition for each piece of rows."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        with open(self.options["path"], "rb") as f:
            shape, _, kind, _ = _header(f.read(65536))
        return ", ".join([*(f"i{k} long" for k in range(len(shape))), f"v {SPARK[_name(kind)].simpleString()}"])

    def reader(self, schema) -> DataSourceReader:
        return NpyReader(self.options)


class NpyPiece(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class NpyReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.pieces = options["path"], int(options.get("pieces", 8))

    def partitions(self) -> list[NpyPiece]:
        n = len(np.load(self.path, mmap_mode="r"))
        each = max(1, -(-n // self.pieces))
        return [NpyPiece(s, min(n, s + each)) for s in range(0, n, each)]

    def read(self, piece: NpyPiece) -> Iterator[pa.RecordBatch]:
        for batch in _batches(np.load(self.path, mmap_mode="r")[piece.start : piece.stop]):
            first = pa.array(batch.column(0).to_numpy() + piece.start)
            yield pa.RecordBatch.from_arrays([first, *batch.columns[1:]], names=batch.schema.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpySource)
