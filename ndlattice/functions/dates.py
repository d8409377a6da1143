"""Dates as 64-bit ticks of a unit since 1970; null is not-a-time and absorbs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .elementwise import int_floor_divide

#: Fixed tick lengths in microseconds; years and months have none, shorter units count ticks a microsecond.
MICROS = {"W": 604_800_000_000, "D": 86_400_000_000, "h": 3_600_000_000, "m": 60_000_000, "s": 1_000_000, "ms": 1_000, "us": 1}
FINER = {"ns": 1_000, "ps": 1_000_000, "fs": 1_000_000_000, "as": 1_000_000_000_000}
UNITS = ("Y", "M", *MICROS, *FINER)
NAMES = dict(zip(UNITS, ("year", "month", "week", "day", "hour", "minute", "second", "millisecond", "microsecond", "nanosecond", "picosecond", "femtosecond", "attosecond"), strict=True))
#: Date-time patterns by unit.
PATTERNS = {"Y": "yyyy", "M": "yyyy-MM", "W": "yyyy-MM-dd", "D": "yyyy-MM-dd", "h": "yyyy-MM-dd'T'HH", "m": "yyyy-MM-dd'T'HH:mm", "s": "yyyy-MM-dd'T'HH:mm:ss", "ms": "yyyy-MM-dd'T'HH:mm:ss.SSS", "us": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _known(unit: str) -> str:
    if unit not in UNITS:
        raise ValueError(f"no unit {unit}")
    return unit


def from_timestamp(ts: Column, unit: str) -> Column:
    """Ticks of a timestamp, rounded down."""
    if _known(unit) == "Y":
        return (F.year(ts) - 1970).cast("long")
    if unit == "M":
        return ((F.year(ts) - 1970) * 12 + F.month(ts) - 1).cast("long")
    micros = F.unix_micros(ts.cast("timestamp"))
    return int_floor_divide(micros, MICROS[unit]) if unit in MICROS else micros * FINER[unit]


def to_timestamp(ticks: Column, unit: str) -> Column:
    if _known(unit) in ("Y", "M"):
        months = ticks * 12 if unit == "Y" else ticks
        return F.add_months(F.lit("1970-01-01").cast("date"), months.cast("int")).cast("timestamp")
    return F.timestamp_micros(ticks * MICROS[unit] if unit in MICROS else int_floor_divide(ticks, FINER[unit]))


def from_date(year: Column, month: Column, day: Column, unit: str = "D") -> Column:
    return from_timestamp(F.make_date(year, month, day).cast("timestamp"), unit)


def from_time(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column, unit: str = "s") -> Column:
    return from_timestamp(F.make_timestamp(year, month, day, hour, minute, second), unit)


def now(unit: str = "us") -> Column:
    return from_timestamp(F.current_timestamp(), unit)


def to_date(ticks: Column, unit: str) -> Column:
    ts = to_timestamp(ticks, unit)
    return F.struct(F.year(ts).alias("year"), F.month(ts).alias("month"), F.day(ts).alias("day"))


def to_time(ticks: Column, unit: str) -> Column:
    ts = to_timestamp(ticks, unit)
    return F.struct(F.hour(ts).alias("hour"), F.minute(ts).alias("minute"), F.second(ts).alias("second"))


def to_string(ticks: Column, unit: str) -> Column:
    """ISO text down to the unit; not-a-time is NaT."""
    return F.coalesce(F.date_format(to_timestamp(ticks, unit), PATTERNS.get(_known(unit), PATTERNS["us"])), F.lit("NaT"))


def from_string(text: Column, unit: str) -> Column:
    return from_timestamp(F.try_to_timestamp(text), unit)


def convert(ticks: Column, source: str, target: str) -> Column:
    return from_timestamp(to_timestamp(ticks, source), target)


def timedelta(value: Column, unit: str) -> Column:
    _known(unit)
    return value.cast("long")


def add(ticks: Column, delta: Column) -> Column:
    return ticks + delta


def subtract(a: Column, b: Column) -> Column:
    return a - b


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; not-a-time has no order."""
    return F.when(a.isNull() | b.isNull(), F.raise_error(F.lit("not-a-time cannot be compared"))).when(a < b, -1).when(a > b, 1).otherwise(0)


# --- business days: Monday to Friday, no holidays; days are ticks of D ---------------------------


def is_busday(day: Column) -> Column:
    return F.pmod(day + 3, F.lit(7)) < 5


def _before(day: Column) -> Column:
    """Business days in the weeks up to a day."""
    return int_floor_divide(day + 3, 7) * 5 + F.least(F.pmod(day + 3, F.lit(7)), F.lit(5))


def busday_count(start: Column, end: Column) -> Column:
    """Of [start, end); a reversed range counts (end, start] with a minus sign."""
    return F.when(start <= end, _before(end) - _before(start)).otherwise(_before(end + 1) - _before(start + 1))


def busday_offset(day: Column, offset: Column) -> Column:
    """Business day so many business days on; a weekend day is an error."""
    place = F.pmod(day + 3, F.lit(7)) + F.pmod(offset, F.lit(5))
    moved = day + int_floor_divide(offset, 5) * 7 + F.pmod(offset, F.lit(5)) + F.when(place >= 5, 2).otherwise(0)
    return F.when(is_busday(day), moved).otherwise(F.raise_error(F.lit("not a business day")))
