"""Session settings under which integer arithmetic wraps as in fixed-width arrays."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "false")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master:
        builder = builder.master(master)
    for k, v in settings.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def version(spark: SparkSession) -> str:
    return spark.version


def set_num_threads(spark: SparkSession, count: int) -> None:
    """Tasks of a shuffle stage; the number of cores is the cluster's."""
    if count < 1:
        raise ValueError("a positive count is needed")
    spark.conf.set("spark.sql.shuffle.partitions", str(count))


def get_num_threads(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def setbufsize(spark: SparkSession, rows: int) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def getbufsize(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
