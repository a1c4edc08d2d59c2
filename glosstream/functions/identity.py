"""Stable identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def phrase_id(title: Column, group: Column, order: Column, text: Column) -> Column:
    """SHA-1 of ``title|group:order|text``, its first 32 digits in the shape of a UUID."""
    digest = F.sha1(F.concat(title, F.lit("|"), group.cast("string"), F.lit(":"), order.cast("string"), F.lit("|"), text).cast("binary"))
    return F.concat_ws("-", *(F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def hashed_feature(name: Column, bits: int = 20) -> Column:
    """crc32 of a feature's name in so many bits."""
    return F.crc32(name.cast("binary")).bitwiseAND(F.lit((1 << bits) - 1))
