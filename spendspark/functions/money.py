"""Amounts: parsing, and number text with half-even rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv


def parse_amount(raw: Column) -> Column:
    """Absolute amount of a money text, null where it is not a number."""
    bare = F.regexp_replace(F.regexp_replace(raw, r"₹|Rs\.?|,", ""), "INR", "")
    bare = F.regexp_replace(bare, r"(?U)^\s+|\s+$", "")
    return F.abs(bare.try_cast("decimal(14,2)"))


def infer_direction(kind: Column, amount_raw: Column) -> Column:
    """By keyword, else by the sign of the amount, else null."""
    word = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    money = F.ltrim(amount_raw)
    return (
        F.when(word.isin(fv.DEBIT_WORDS), "debit")
        .when(word.isin(fv.CREDIT_WORDS), "credit")
        .when(money.startswith("-"), "debit")
        .when(money.startswith("+"), "credit")
    )


def grouped_text(value: Column, digits: int) -> Column:
    """``1,234.5``: fixed digits, half-even, with thousands separators."""
    return F.format_number(value, digits)


def plain_text(value: Column, digits: int) -> Column:
    return F.replace(grouped_text(value, digits), F.lit(","), F.lit(""))


def rupees(value: Column) -> Column:
    return F.concat(F.lit(fv.CURRENCY), grouped_text(value, 0))
