"""Date and timestamp parsing with explicit formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The date spellings of the input files.
DATE_FORMATS = ["yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss"]
OFFSET_FORMATS = [
    "yyyy-MM-dd HH:mm:ssX", "yyyy-MM-dd HH:mm:ss X", "yyyy-MM-dd HH:mm:ss.SSSX",
    "yyyy/MM/dd HH:mm:ssX", "yyyy/MM/dd HH:mm:ss X", "yyyy-MM-dd'T'HH:mm:ssX",
]
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"
MONTH_FORMAT = "yyyyMM"


def _shaped(c: Column, form: str) -> Column:
    """Whether the separators stand where text of that format has them; a failed parse costs far more than this.

    Places are counted from an end that a year of more than four digits does not move.
    """
    day = form.removesuffix(" HH:mm:ss").removesuffix("'T'HH:mm:ss")
    if day != form:
        clock = (F.substring(c, -3, 1) == ":") & (F.substring(c, -6, 1) == ":")
        return clock & (F.substring(c, -9, 1).isin("T", "t") if "'T'" in form else F.substring(c, -9, 1) == " ") & (F.substring(c, -12, 1) == day[-3])
    if day == "dd/MM/yyyy":
        return (F.substring(c, 3, 1) == "/") & (F.substring(c, 6, 1) == "/")
    return (F.substring(c, -3, 1) == day[-3]) & (F.substring(c, -6, 1) == day[-3])


def date_of(c: Column, formats: list[str] | None = None) -> Column:
    """First format that fits, null where none does; a time with an offset gives its day in UTC.

    Only texts longer than a date and a time without offset are tried with one.
    """
    if formats:
        return F.coalesce(*[F.try_to_date(c, f) for f in formats])
    plain = [F.when(_shaped(c, f), F.try_to_date(c, f)) for f in [*DATE_FORMATS, ISO_FORMAT]]
    offsets = [F.try_to_timestamp(c, F.lit(f)).cast("date") for f in OFFSET_FORMATS]
    return F.coalesce(*plain, F.when(F.length(c) > 19, F.coalesce(*offsets)))


def month_of(c: Column) -> Column:
    """``yyyyMM`` text as the first day of that month."""
    return F.try_to_date(c, MONTH_FORMAT)


def utc_timestamp(c: Column) -> Column:
    """Timestamp with an offset such as ``-03``; without one the text is taken as UTC."""
    offsets = [F.try_to_timestamp(c, F.lit(f)) for f in OFFSET_FORMATS]
    return F.coalesce(*offsets, date_of(c).cast("timestamp"))


def month_or_date(c: Column, first_format_fits: Column) -> Column:
    """``yyyyMM`` where the caller's whole-file flag says so, else the other spellings."""
    return F.when(first_format_fits, month_of(c)).otherwise(date_of(c))


def first_year(c: Column) -> Column:
    """First run of four digits as a number; 0 where there is none."""
    return F.coalesce(F.regexp_extract(c, r"(\d{4})", 1).try_cast("int"), F.lit(0))


def period_bounds(c: Column) -> list[Column]:
    """Aggregates: first and last day as text."""
    return [F.date_format(F.min(c), "yyyy-MM-dd").alias("first_day"),
            F.date_format(F.max(c), "yyyy-MM-dd").alias("last_day")]


def month_label(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")
