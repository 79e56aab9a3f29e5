"""Date/time scalar functions (session time zone is UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utc_ts(epoch) -> Column:
    """Epoch seconds -> timestamp (null stays null)."""
    return F.timestamp_seconds(_col(epoch))


def utc_date(epoch) -> Column:
    """Epoch seconds -> UTC date."""
    return F.to_date(F.timestamp_seconds(_col(epoch)))


def to_epoch(ts) -> Column:
    """Wall-clock timestamp read as UTC -> epoch seconds."""
    return F.unix_timestamp(_col(ts).cast("timestamp"))


def weekday_mon0(ts) -> Column:
    """Day of week with Monday = 0 (not ``dayofweek``, which is Sunday = 1)."""
    return F.weekday(_col(ts))


def day_of_year0(ts) -> Column:
    """Zero-based day of year."""
    return F.dayofyear(_col(ts)) - 1


def hour_of_week(ts) -> Column:
    """Weekday * 24 + hour."""
    return weekday_mon0(ts) * 24 + F.hour(_col(ts))


def two_hour_bucket(x) -> Column:
    """2 * floor(x / 2)."""
    return (F.floor(_col(x) / 2) * 2).cast("int")


def local_parts(ts, zone: str = "America/New_York") -> dict:
    """Local-zone parts; Sunday = 0 and 1-based day of year as in SQL ``%w``/``%j``."""
    lt = F.from_utc_timestamp(_col(ts), zone)
    return {
        "hour": F.hour(lt),
        "minute": F.minute(lt),
        "dow_sun0": F.dayofweek(lt) - 1,
        "doy": F.dayofyear(lt),
        "year": F.year(lt),
    }
