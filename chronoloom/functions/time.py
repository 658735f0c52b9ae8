"""Seconds since 1970, without a look at the session's time zone."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Range of timestamps that points may have.
MIN_TS, MAX_TS = 1, 4_294_967_295
#: Length of a segment, and how long segments are kept by default.
SEGMENT_SECONDS, RETENTION_SECONDS = 7_200, 604_800


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds, rounded down, of a timestamp without time zone."""
    days = F.datediff(F.to_date(ts), F.lit(datetime.date(1970, 1, 1))).cast("long")
    return days * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60 + F.floor(F.second(ts)).cast("long")


def segment_of(ts: Column, seconds: int = SEGMENT_SECONDS) -> Column:
    return (F.floor(ts / seconds) * seconds).cast("long")


def clock(seconds: int) -> Column:
    """A timestamp literal without time zone."""
    at = datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=seconds)
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")
