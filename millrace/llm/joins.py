"""Joins against lists of rows that are usually short."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

SMALL = 200_000  # rows of a few columns that are broadcast; longer lists are joined by shuffle


def without(rows: DataFrame, gone: DataFrame, same: Callable[[DataFrame, DataFrame], Column]) -> DataFrame:
    """The rows that are not in ``gone``.  The list is written and counted first."""
    gone = materialise(gone)
    few = gone.count() <= SMALL
    return rows.join(F.broadcast(gone) if few else gone, same(rows, gone), "left_anti")
