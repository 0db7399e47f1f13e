"""Defaults, previews, escapes and dates, as Spark columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PREVIEW = 200


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def if_empty(value: Column | str, default: Column | str) -> Column:
    """value, or the default where it is null or the empty string. A str default is a literal."""
    default = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.nullif(_column(value), F.lit("")), default)


def if_null(value: Column | str, default) -> Column:
    return F.coalesce(_column(value), default if isinstance(default, Column) else F.lit(default))


def if_zero(value: Column | str, default: int) -> Column:
    """value, or the default where it is null or 0."""
    return F.coalesce(F.nullif(_column(value), F.lit(0)), F.lit(default))


def no_array(value: Column | str, kind: str = "array<string>") -> Column:
    """An empty array for null."""
    return F.coalesce(_column(value), F.array().cast(kind))


def preview(text: Column | str, length: int = PREVIEW) -> Column:
    """The first code points, and dots only if there are more."""
    text = if_empty(text, "")
    return F.concat(F.substring(text, 1, length), F.when(F.length(text) > length, F.lit("...")).otherwise(F.lit("")))


def contains_text(column: Column | str, part: str) -> Column:
    """Substring test without regard to case; false for null."""
    return F.coalesce(F.contains(F.lower(_column(column)), F.lit(part.lower())), F.lit(False))


def domain_of(address: Column | str) -> Column:
    """What stands between the first and the second @; null without one."""
    return F.get(F.split(_column(address), "@"), F.lit(1))


def escape_html(text: Column | str) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;"))
    return reduce(lambda out, pair: F.replace(out, F.lit(pair[0]), F.lit(pair[1])), pairs, _column(text))


def shown_date(date: Column | str) -> Column:
    return F.date_format(_column(date), "yyyy-MM-dd HH:mm:ss")


def iso_date(date: Column | str) -> Column:
    return F.date_format(_column(date), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def count_or(text: Column | str, default: int = 10) -> Column:
    """A number that a form gave as text; the default for text that isn't one, and for 0."""
    return F.coalesce(F.nullif(F.regexp_extract(_column(text), r"^\s*([+-]?\d{1,9})", 1).try_cast("int"), F.lit(0)), F.lit(default))
