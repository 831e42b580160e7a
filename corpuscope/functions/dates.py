"""Ages and rates (Column in, Column out)."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, functions as F

DAY_MICROS = 86_400_000_000


def parse_iso(col) -> Column:
    """ISO-8601 text to a timestamp; without ``Z`` or an offset it is UTC, unparsable it is NULL."""
    col = F.col(col) if isinstance(col, str) else col
    local = col.rlike(r"\d[T ]\d") & ~col.rlike(r"(?i)(Z|UTC|[+-]\d\d:?\d\d)\s*$")
    return F.try_to_timestamp(F.when(local, F.concat(F.trim(col), F.lit("Z"))).otherwise(col))


def utc_instant(moment) -> Column:
    """A point in time given as ISO text, ``datetime`` or Column; without a zone it is UTC."""
    if isinstance(moment, Column):
        return moment.cast("timestamp")
    moment = datetime.fromisoformat(moment) if isinstance(moment, str) else moment
    moment = moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)
    return F.timestamp_micros(F.lit((moment - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)))


def utc_date(ts) -> Column:
    """The day of a timestamp in UTC, whatever the session's zone is."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    micros = F.unix_micros(ts.cast("timestamp"))
    return F.date_from_unix_date(((micros - F.pmod(micros, F.lit(DAY_MICROS))) / DAY_MICROS).cast("int"))


def days_since(ts, as_of) -> Column:
    """Whole elapsed days from ``ts`` to ``as_of``, rounded down; NULL stays NULL.

    ``datediff`` counts midnights and would call 23:59 -> 00:00 one day, so the elapsed
    microseconds are divided instead.
    """
    ts = F.col(ts) if isinstance(ts, str) else ts
    elapsed = (F.unix_micros(utc_instant(as_of)) - F.unix_micros(ts.cast("timestamp")))
    # exact in whole numbers: subtract the non-negative remainder first
    return ((elapsed - F.pmod(elapsed, F.lit(DAY_MICROS))) / DAY_MICROS).cast("long")


def _rate(count, days, period: float) -> Column:
    days = F.col(days) if isinstance(days, str) else days
    count = F.col(count) if isinstance(count, str) else count
    return F.when(days > 0, count / (days / F.lit(period))).otherwise(F.lit(0.0))


def commits_per_month(count, days) -> Column:
    """Commits per 30 days of age; an age of zero, below zero or unknown gives 0.0."""
    return _rate(count, days, 30.0)


def releases_per_year(count, days) -> Column:
    """Releases per 365 days of age; an age of zero, below zero or unknown gives 0.0."""
    return _rate(count, days, 365.0)
