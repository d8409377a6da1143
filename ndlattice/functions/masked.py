"""Masked values: a column with a mask and a fill value; reductions see the unmasked ones."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import positions
from . import elementwise as E


class Masked(NamedTuple):
    data: Column
    mask: Column
    fill_value: float = 0.0

    @property
    def valid(self) -> Column:
        """The value, null where masked."""
        return F.when(~self.mask, self.data)

    def filled(self, fill: float | None = None) -> Column:
        return F.when(self.mask, F.lit(self.fill_value if fill is None else fill)).otherwise(self.data)

    def with_mask(self, mask: Column) -> Masked:
        return self._replace(mask=mask)

    def compressed(self, df: DataFrame, *order: Column) -> DataFrame:
        """i0, v: the unmasked values of df in an order, numbered."""
        kept = df.where(~self.mask).select(self.data.alias("v"), *(o.alias(f"__o{k}") for k, o in enumerate(order)))
        return positions(kept, *(F.col(f"__o{k}") for k in range(len(order)))).select("i0", "v")

    # aggregates: 0 where every value is masked

    def count(self) -> Column:
        return F.count(self.valid)

    def sum(self) -> Column:
        return F.coalesce(F.sum(self.valid), F.lit(0.0))

    def mean(self) -> Column:
        return F.coalesce(F.avg(self.valid), F.lit(0.0))

    def std(self) -> Column:
        return F.coalesce(F.stddev_pop(self.valid), F.lit(0.0))

    def min(self) -> Column:
        return F.coalesce(F.min(self.valid), F.lit(0.0))

    def max(self) -> Column:
        return F.coalesce(F.max(self.valid), F.lit(0.0))


def masked_where(condition: Column, data: Column, fill: float = 0.0) -> Masked:
    return Masked(data, condition, fill)


def masked_invalid(data: Column, fill: float = 0.0) -> Masked:
    return Masked(data, ~E.isfinite(data), fill)


def masked_greater(data: Column, value: float, fill: float = 0.0) -> Masked:
    return Masked(data, E.greater(data, value), fill)


def masked_less(data: Column, value: float, fill: float = 0.0) -> Masked:
    return Masked(data, E.less(data, value), fill)


def masked_equal(data: Column, value: float, fill: float = 0.0) -> Masked:
    return Masked(data, E.equal(data, value), fill)


def masked_not_equal(data: Column, value: float, fill: float = 0.0) -> Masked:
    return Masked(data, E.not_equal(data, value), fill)


def masked_inside(data: Column, a: float, b: float, fill: float = 0.0) -> Masked:
    low, high = min(a, b), max(a, b)
    return Masked(data, E.greater_equal(data, low) & E.less_equal(data, high), fill)


def masked_outside(data: Column, a: float, b: float, fill: float = 0.0) -> Masked:
    low, high = min(a, b), max(a, b)
    return Masked(data, E.less(data, low) | E.greater(data, high), fill)
