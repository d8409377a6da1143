"""String functions over text columns; lengths and places count bytes where byte arrays do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that strip() removes by default.
WHITE = " \t\n\r\x0b\x0c"


def char_add(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def char_multiply(a: Column, n: Column | int) -> Column:
    return F.call_function("repeat", a, F.greatest(F.lit(0), F.lit(n) if isinstance(n, int) else n).cast("int"))


_LOW, _HIGH = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def char_upper(a: Column) -> Column:
    """Letters a to z only, as byte arrays have it."""
    return F.translate(a, _LOW, _HIGH)


def char_lower(a: Column) -> Column:
    return F.translate(a, _HIGH, _LOW)


def char_strip(a: Column, chars: str | None = None) -> Column:
    return F.btrim(a, F.lit(WHITE if chars is None else chars))


def char_lstrip(a: Column, chars: str | None = None) -> Column:
    return F.ltrim(a, F.lit(WHITE if chars is None else chars))


def char_rstrip(a: Column, chars: str | None = None) -> Column:
    return F.rtrim(a, F.lit(WHITE if chars is None else chars))


def _width(width: int) -> int:
    if width < 0:
        raise ValueError("a width is not negative")
    return width


def char_ljust(a: Column, width: int, fill: str = " ") -> Column:
    return F.when(F.length(a) >= _width(width), a).otherwise(F.rpad(a, width, fill))


def char_rjust(a: Column, width: int, fill: str = " ") -> Column:
    return F.when(F.length(a) >= _width(width), a).otherwise(F.lpad(a, width, fill))


def char_center(a: Column, width: int, fill: str = " ") -> Column:
    """An odd blank goes to the left where the width is odd too."""
    total = F.greatest(F.lit(0), F.lit(_width(width)) - F.length(a))
    left = (F.floor(total / 2) + total.bitwiseAND(width).bitwiseAND(1)).cast("int")
    return F.concat(char_multiply(F.lit(fill), left), a, char_multiply(F.lit(fill), total - left))


def char_zfill(a: Column, width: int) -> Column:
    signed = a.startswith("-") | a.startswith("+")
    zeros = char_multiply(F.lit("0"), F.lit(_width(width)) - F.length(a))
    return F.when(signed, F.concat(F.substring(a, 1, 1), zeros, F.substr(a, F.lit(2)))).otherwise(F.concat(zeros, a))


def char_strlen(a: Column) -> Column:
    return F.octet_length(a)


def char_count(a: Column, sub: str) -> Column:
    """Occurrences that do not overlap; the empty text stands before, between and behind all characters."""
    if not sub:
        return F.length(a) + 1
    return ((F.length(a) - F.length(F.replace(a, F.lit(sub), F.lit("")))) / len(sub)).cast("int")


def char_find(a: Column, sub: str) -> Column:
    """First byte of sub, -1 if it is missing."""
    at = F.instr(a, F.lit(sub))
    return F.when(at == 0, -1).otherwise(F.octet_length(F.substr(a, F.lit(1), at - 1))).cast("int")


def char_replace(a: Column, old: str, new: str, count: int = -1) -> Column:
    """The first count occurrences, or all."""
    if count < 0:
        return F.replace(a, F.lit(old), F.lit(new))
    parts = F.split(a, _quoted(old), count + 1)
    return F.array_join(parts, new)


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if c in r"\.[]{}()*+-?^$|" else c for c in text)


def char_split(a: Column, sep: str | None = None, maxsplit: int = -1) -> Column:
    """ARRAY<STRING>; without a separator at runs of white space, outer ones ignored."""
    limit = maxsplit + 1 if maxsplit >= 0 else -1
    if sep is None:
        trimmed = char_strip(a)
        return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"\s+", limit))
    return F.split(a, _quoted(sep), limit)


def string_list_count(a: Column) -> Column:
    return F.size(a)


def string_list_get(a: Column, i: int) -> Column:
    return F.get(a, F.lit(i))


def char_join(a: Column, sep: str) -> Column:
    """The separator between the characters of each text."""
    return F.array_join(F.filter(F.split(a, ""), lambda c: c != ""), sep)


def list_join(values: Column, order: Column, sep: str) -> Column:
    """Aggregate: one text of all values in an order.  Its result holds them all, so use it on groups of bounded size."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), values.alias("v")))), lambda s: s.v), sep)


def base_repr(n: Column, base: int, padding: int = 0) -> Column:
    """Digits in a base up to 36, a minus sign, and zeros in front."""
    if not 2 <= base <= 36:
        raise ValueError("bases reach from 2 to 36")
    digits = F.conv(F.abs(n).cast("string"), 10, base)
    return F.concat(F.when(n < 0, "-").otherwise(""), char_multiply(F.lit("0"), padding), digits)


def binary_repr(n: Column, width: int | None = None) -> Column:
    """Two's complement of a width for negative numbers, a minus sign without one."""
    digits = F.bin(F.abs(n))
    if width is None:
        return F.when(n < 0, F.concat(F.lit("-"), digits)).otherwise(digits)
    return F.when(n < 0, F.right(F.bin(n), F.lit(width))).otherwise(F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0")))


def from_text(a: Column, sep: str, kind: str = "double", count: int = -1) -> Column:
    """ARRAY of numbers from separated text."""
    tokens = F.split(char_strip(a), _quoted(sep)) if sep.strip() else char_split(a)
    tokens = F.filter(tokens, lambda t: F.trim(t) != "")
    tokens = F.slice(tokens, 1, count) if count >= 0 else tokens
    return F.transform(tokens, lambda t: F.trim(t).try_cast(kind))


def from_regex(a: Column, pattern: str, fields: dict[str, str], most: int = -1) -> Column:
    """ARRAY<STRUCT> of a pattern's groups, typed by field."""
    groups = [F.regexp_extract_all(a, F.lit(pattern), F.lit(i + 1)) for i in range(len(fields))]
    groups = [F.slice(g, 1, most) if most >= 0 else g for g in groups]
    names = list(fields)
    zipped = F.arrays_zip(*(g.alias(f"f{i}") for i, g in enumerate(groups)))
    return F.transform(zipped, lambda s: F.struct(*(s[f"f{i}"].try_cast(fields[n]).alias(n) for i, n in enumerate(names))))


def safe_eval(text: str) -> float:
    """One numeric literal: decimal, underscored, hexadecimal, octal, binary; nothing else is evaluated."""
    t = text.strip()
    try:
        return float(int(t, 0))
    except ValueError:
        return float(t)


def format_float(x: Column, precision: int, scientific: bool = False) -> Column:
    return F.format_string(f"%.{precision}{'e' if scientific else 'f'}", x.cast("double"))
