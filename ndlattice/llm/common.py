"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows whose crc32(doc_id as text) leaves this remainder modulo 4 are held out of training.
HELD_OUT = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column) -> Column:
    """crc32 of the decimal id modulo 4; a null id counts as held out, so it never trains a model."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(HELD_OUT))


def settled(df: DataFrame) -> DataFrame:
    """Cut the lineage through the folder all executors share (spark.checkpoint.dir).

    Only a session without that setting on a single machine (tests) gets a folder of its own, in its warehouse.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if shared is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = f"{df.sparkSession.conf.get('spark.sql.warehouse.dir')}/checkpoints"
        sc.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def look_up(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int, shares: int = 1000) -> DataFrame:
    """left joined with right, whose keys are unique; weight: how many of left's rows (total in all) have a row's key.

    Keys that hold more than one of so many shares of left's rows are fewer than shares: they are broadcast, so that no task gathers such a key's rows.
    """
    often = F.col(weight) > total / shares
    hot = F.broadcast(right.where(often))
    return left.join(hot, on).unionByName(left.join(hot.select(*on), on, "left_anti").join(right.where(~often), on))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunks(batch: pa.RecordBatch, text: str, most_chars: int = 4_000_000) -> Iterator[dict[str, list]]:
    """Python lists of a batch's columns, cut so that no chunk has many more than most_chars of text."""
    columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
    lengths = pc.binary_length(columns[text]).to_pylist() if batch.num_rows else []
    at = size = 0
    for i, n in enumerate(lengths):
        size += n or 0
        if size >= most_chars or i + 1 == len(lengths):
            yield {k: v.slice(at, i + 1 - at).to_pylist() for k, v in columns.items()}
            at, size = i + 1, 0


def record(schema: pa.Schema, columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
