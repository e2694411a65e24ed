"""Calendar months: the ``YYYY-MM`` string, its integer index, and tenure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_index(year_month: str) -> int:
    """``'2011-12'`` as months since year 0, so that arithmetic is plain."""
    year, month = year_month.split("-")
    return int(year) * 12 + int(month) - 1


def month_name(index: int) -> str:
    return f"{index // 12:04d}-{index % 12 + 1:02d}"


def shift(year_month: str, months: int) -> str:
    return month_name(month_index(year_month) + months)


def month_start(year_month: str) -> Column:
    """First instant of the month, as a literal that the scan can push down."""
    return F.to_timestamp_ntz(F.lit(f"{year_month}-01 00:00:00"))


def before(ts: str, year_month: str) -> Column:
    return F.col(ts) < month_start(year_month)


def within(ts: str, first: str, last: str) -> Column:
    """``ts`` lies in the closed month range ``first..last``."""
    return (F.col(ts) >= month_start(first)) & (F.col(ts) < month_start(shift(last, 1)))


def index_of(ts: str | Column) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.year(ts) * 12 + F.month(ts) - 1


def name_of(index: Column) -> Column:
    """Month index column back to ``YYYY-MM``."""
    year = F.floor(index / 12).cast("int")
    return F.format_string("%04d-%02d", year, (index % 12 + 1).cast("int"))


def bucket(ts: str, pattern: str = "yyyy-MM") -> Column:
    return F.date_format(ts, pattern)


def shift_bucket(bucket_col: str, months: int) -> Column:
    return F.date_format(F.add_months(F.to_date(bucket_col, "yyyy-MM"), months), "yyyy-MM")


def epoch_seconds(ts: str) -> Column:
    """Whole seconds since 1970 of a naive time, whatever the session zone."""
    days = F.date_diff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    return (days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("bigint")


def whole_months(ts: str | Column, until: str) -> Column:
    """Full months from ``ts`` to the start of month ``until``.

    A month that began after its first instant does not count.
    """
    ts = F.col(ts) if isinstance(ts, str) else ts
    zero = F.lit(0)
    month_begin = F.make_timestamp_ntz(F.year(ts), F.month(ts), F.lit(1), zero, zero, zero)
    return F.lit(month_index(until)) - index_of(ts) - (ts > month_begin).cast("int")
