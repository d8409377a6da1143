"""Positions and running totals over a whole ordered table, without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a row's place in its partition in monotonically_increasing_id().
_LOCAL = 33


def settled(df: DataFrame) -> DataFrame:
    """Written to the folder that all executors share, so that partitions stay as they are when one is lost.

    Only a session without that setting on a single machine gets a folder of its own, in its warehouse.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or f"{df.sparkSession.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    return df.checkpoint(eager=True)


def ranged(df: DataFrame, *order: Column, part: str = "__part", place: str = "__place") -> DataFrame:
    """df in ranges of the order, with each row's range and its place there."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = settled(df.repartitionByRange(width, *order).sortWithinPartitions(*order))
    row = F.monotonically_increasing_id()
    return held.select("*", F.shiftright(row, _LOCAL).alias(part), row.bitwiseAND((1 << _LOCAL) - 1).alias(place))


def _before(parts: DataFrame, value: str) -> DataFrame:
    """Running total of one value a range, the range itself left out; a row for each range at most."""
    return parts.withColumn(value, F.coalesce(F.sum(value).over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def positions(df: DataFrame, *order: Column, name: str = "i0") -> DataFrame:
    """df with every row's position in the order, from 0.  Ties need a further key to be repeatable."""
    held = ranged(df, *order)
    starts = _before(held.groupBy("__part").agg(F.count("*").alias("__start")), "__start")
    return held.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__place")).drop("__part", "__place", "__start")


def running(df: DataFrame, value: Column, *order: Column, name: str = "running") -> DataFrame:
    """df with the sum of value over all rows up to each one in the order."""
    held = ranged(df.withColumn("__value", value), *order)
    starts = _before(held.groupBy("__part").agg(F.coalesce(F.sum("__value"), F.lit(0)).alias("__start")), "__start")
    own = F.sum("__value").over(Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0))
    return held.withColumn(name, own).join(F.broadcast(starts), "__part").withColumn(name, F.col(name) + F.col("__start")).drop("__part", "__place", "__start", "__value")


def neighbours(df: DataFrame, value: Column, before: int, after: int, *order: Column, name: str = "near") -> DataFrame:
    """df with the array of value over the rows from before ahead of each one to after behind it, shorter at the ends.

    A range borrows the rows it needs from the ranges beside it; only those rows are sent twice.
    """
    numbered = positions(df.withColumn("__value", value), *order, name="__row")
    block = max(4096, 4 * (before + after))
    own = numbered.withColumn("__block", F.floor(F.col("__row") / block)).withColumn("__lent", F.lit(False))
    lent = numbered.select("*", F.explode(F.array_distinct(F.array(F.floor((F.col("__row") - after) / block), F.floor((F.col("__row") + before) / block)))).alias("__block"))
    lent = lent.where(F.col("__block") != F.floor(F.col("__row") / block)).withColumn("__lent", F.lit(True))
    near = F.collect_list("__value").over(Window.partitionBy("__block").orderBy("__row").rowsBetween(-before, after))
    return own.unionByName(lent).withColumn(name, near).where(~F.col("__lent")).drop("__row", "__block", "__lent", "__value")
