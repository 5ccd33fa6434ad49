"""Scalar rules of the SQL surface that differ from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date letters of SQL text and their Spark counterparts.
DATE_LETTERS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%j": "DDD", "%f": "SSSSSS", "%p": "a", "%I": "hh"}


def date_pattern(text: str) -> str:
    """A ``%``-style date pattern in Spark's letters; other letters are quoted."""
    out, i = "", 0
    while i < len(text):
        if text[i : i + 2] in DATE_LETTERS:
            out += DATE_LETTERS[text[i : i + 2]]
            i += 2
        else:
            out += f"'{text[i]}'" if text[i].isalpha() else text[i]
            i += 1
    return out


def fdiv(a: Column, b: Column) -> Column:
    """Division of floats: by zero it gives an infinity, or NaN for 0 / 0; null stays null."""
    x, y = a.cast("double"), b.cast("double")
    at_zero = F.when(x == 0, F.lit(float("nan"))).when(F.isnan(x), x).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(x.isNull() | y.isNull(), F.lit(None).cast("double")).when(y == 0, at_zero).otherwise(x / F.when(y == 0, F.lit(1.0)).otherwise(y))


def checked_sqrt(x: Column) -> Column:
    """The square root; of a negative number an error, not NaN."""
    return F.when(x < 0, F.raise_error(F.lit("the square root of a negative number was taken")).cast("double")).otherwise(F.sqrt(x))


def number_token(c: Column) -> Column:
    """Whether text is a number, without blanks, a plus sign or leading zeros."""
    return c.rlike(r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$")


#: What cells of hand-made tables say for nothing.
NULL_MARKERS = ("", "null", "na", "n/a", "nan", "none")


def null_marked(c: Column) -> Column:
    """Text without the marks that stand for nothing."""
    return F.when(~F.lower(F.trim(c)).isin(*NULL_MARKERS), c)


def number_of(c: Column) -> Column:
    """The number a cell holds, null for markers and other text."""
    t = F.trim(null_marked(c.cast("string")))
    return F.when(t.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), t.try_cast("double"))


def calendar_floor(c: Column, unit: str, step: int = 1) -> Column:
    """The start of the ``step`` units of the calendar that a time is in; weeks begin on Monday."""
    if step == 1:
        return F.date_trunc(unit, c)
    whole = {"minute": ("hour", 60), "second": ("minute", 60), "hour": ("day", 3600), "month": ("year", 0)}
    if unit not in whole:
        raise ValueError(f"no steps of {step} {unit}")
    if unit == "month":
        return F.add_months(F.date_trunc("year", c), (F.floor((F.month(c) - 1) / step) * step).cast("int")).cast("timestamp_ntz")
    outer, size = whole[unit]
    seconds = {"second": F.second(c), "minute": F.minute(c) * 60, "hour": F.hour(c) * 3600}[unit]
    unit_s = {"second": 1, "minute": 60, "hour": 3600}[unit]
    kept = (F.floor(seconds / (unit_s * step)) * unit_s * step).cast("int")
    return F.date_trunc(outer, c) + F.make_dt_interval(secs=kept.cast("decimal(18,6)"))
