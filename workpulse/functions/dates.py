"""Wall-clock times, spans in days and shown dates."""

import datetime as dt

from pyspark.sql import Column, functions as F

SECONDS_PER_DAY = 86400.0


def wall_time(text: Column) -> Column:
    """Timestamp text without its zone; the wall time stays and unreadable text is null."""
    return text.try_cast("timestamp_ntz")


def moment(value: dt.datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def days_between(start: Column, end: Column) -> Column:
    """Days with their fraction. The interval keeps wall time, whatever the session's zone."""
    seconds = (end - start).cast("interval second").cast("decimal(18,6)")
    return seconds.cast("double") / SECONDS_PER_DAY


def lead_days(start: Column, end: Column, as_of: dt.datetime) -> Column:
    """Days from start to end, an open end counting as ``as_of``."""
    return days_between(start, F.coalesce(end, moment(as_of)))


def mean_days(days: Column) -> Column:
    """Mean of day spans that does not depend on the order of the rows.

    A span is a whole number of microseconds, so seconds and the rest are added up as integers, which
    is exact; a sum of doubles would differ in its last bits from run to run and could swap ranks.
    """
    micros = F.round(days * (SECONDS_PER_DAY * 1e6)).cast("bigint")
    million = F.lit(1_000_000).cast("bigint")
    rest = micros % million
    seconds = ((micros - rest) / million).cast("bigint")
    total = F.sum(seconds) + F.sum(rest) / 1e6
    return total / F.nullif(F.count(days), F.lit(0)) / SECONDS_PER_DAY


def shown_date(time: Column, missing: str = "") -> Column:
    return F.coalesce(F.date_format(time, "dd/MM/yyyy"), F.lit(missing))
