"""Helpers for functions of higher order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once for each row.

    The optimizer writes a column's expression out wherever the column is used,
    inside lambdas too, where it is then worked out for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
