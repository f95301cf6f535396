"""Date Column helpers (DAT-*). ``as_of`` is always a parameter, never
``current_date()``, so results are reproducible."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col_


def as_date_lit(as_of) -> Column:
    if isinstance(as_of, Column):
        return as_of.cast("date")
    if isinstance(as_of, (_dt.date, _dt.datetime)):
        as_of = as_of.isoformat()[:10]
    return F.to_date(F.lit(str(as_of)))


def month_start(c) -> Column:
    """DATE_TRUNC(d, MONTH) as a DATE (DAT-01)."""
    return F.trunc(col_(c).cast("date"), "MM")


def months_before(as_of, n: int) -> Column:
    """DATE_SUB(DATE_TRUNC(as_of, MONTH), INTERVAL n MONTH) (DAT-01, FLT-10)."""
    return F.add_months(F.trunc(as_date_lit(as_of), "MM"), -n)


def add_weeks(c, n) -> Column:
    """DATE_ADD(d, INTERVAL n WEEK) (DAT-02)."""
    return F.date_add(col_(c), (col_(n) if not isinstance(n, int) else F.lit(n)) * 7)


def year_month(c) -> Column:
    """FORMAT_DATE('%Y-%m', d) (DAT-04)."""
    return F.date_format(col_(c), "yyyy-MM")


def parse_dmy(c) -> Column:
    """``DD.MM.YYYY`` text → DATE; an invalid date becomes NULL (DAT-07)."""
    return F.try_to_date(col_(c), "dd.MM.yyyy")


def parse_yyyymmdd(c) -> Column:
    return F.try_to_date(col_(c), "yyyyMMdd")


def parse_iso(c) -> Column:
    return F.try_to_date(col_(c), "yyyy-MM-dd")


def from_epoch_ms(c) -> Column:
    """Epoch milliseconds → TIMESTAMP (UTC session) (DAT-07)."""
    return F.timestamp_millis(col_(c).cast("long"))


def tenure_days(first_seen, as_of) -> Column:
    return F.datediff(as_date_lit(as_of), col_(first_seen))


def tenure_years(days) -> Column:
    """``round(days / 365, 1)`` (DAT-08)."""
    from .numeric import rnd
    return rnd(col_(days).cast("double") / 365.0, 1)
