"""Statement dates: many written forms, one timestamp, null where none fits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv


def blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def parse_date(text: Column, with_time: bool = False) -> Column:
    """Timestamp of a date text, which ``with_time`` may end in a time of day.

    The date shape picks the patterns, so a row never tries all of them. Blanks must be
    single ones.
    """
    ending = fv.TIME_SHAPES if with_time else ""
    out = None
    for shape, patterns in fv.DATE_SHAPES:
        parsed = F.coalesce(*[F.try_to_timestamp(text, F.lit(p + ending)) for p in patterns])
        fits = text.rlike(shape)
        out = F.when(fits, parsed) if out is None else out.when(fits, parsed)
    return out


def parse_text_date(text: Column) -> Column:
    plain = blanks(F.regexp_replace(text, ",", ""))
    return F.try_to_timestamp(plain, F.lit(fv.TEXT_DATE_PATTERN))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def whole_days(later: Column, earlier: Column) -> Column:
    """Complete 24-hour spans between two timestamps."""
    return F.floor((micros(later) - micros(earlier)) / F.lit(86_400_000_000))


def month_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
