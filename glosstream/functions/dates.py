"""Dates as they are shown and counted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_day(moment: Column) -> Column:
    """The day in the session's time zone, as dd/mm/yyyy."""
    return F.date_format(moment, "dd/MM/yyyy")


def iso(moment: Column) -> Column:
    """To the second, in the session's time zone with its offset."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ssXXX")


def age_seconds(since: Column, now: Column) -> Column:
    """Whole seconds from one moment to another, such as the age of what waits in a queue."""
    return F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(since.cast("timestamp"))
