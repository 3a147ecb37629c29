"""Column builders that say which values count. Missing means null or NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST_DATE, LAST_DATE = "2005-01-01", "2026-12-31"


def norm_key(c: Column | str) -> Column:
    """Keys are compared without outer spaces and in upper case."""
    return F.upper(F.trim(c))


def present(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c)


def or_null(ok: Column, c: Column) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), c)


def number(c: Column | str) -> Column:
    """The number, with NaN as null."""
    c = F.col(c) if isinstance(c, str) else c
    return or_null(present(c), c)


def genuine_pe(c: Column | str = "pe") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return or_null(present(c) & (c != 0) & (F.abs(c) < 500), c)


def genuine_cap(c: Column | str = "market_cap") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return or_null(present(c) & (c > 0) & (c < float("inf")), c)


def genuine_date(c: Column | str = "date_filed") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return or_null(c.between(F.lit(FIRST_DATE).cast("date"), F.lit(LAST_DATE).cast("date")), c)


def round4(c: Column | str) -> Column:
    """Missing as null, else rounded to 4 decimals."""
    return F.round(number(c), 4)


def usable(c: Column | str) -> Column:
    """A price that is there and above 0, else null."""
    c = F.col(c) if isinstance(c, str) else c
    return or_null(present(c) & (c > 0), c)


def day_number(ts: Column | str) -> Column:
    return F.unix_date(F.to_date(ts))


def hour_number(ts: Column | str) -> Column:
    """Hours since 1970; read from the clock fields, so the session's time zone has no say."""
    return day_number(ts).cast("bigint") * 24 + F.hour(ts)


def second_number(ts: Column | str) -> Column:
    """Seconds since 1970, never falling as ts rises, in any time zone and with or without one."""
    return F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01'"), F.col(ts) if isinstance(ts, str) else ts)
