"""Means that don't depend on the order in which rows are added."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_mean(value: Column | str, digits: int = 6) -> Column:
    """Mean of doubles, rounded: twelve decimals of each are summed exactly and divided once.

    A mean of doubles changes in its last bits with the order of rows, which shows where it lies half-way between two
    rounded values. Null without values.
    """
    column = F.col(value) if isinstance(value, str) else value
    return F.round(F.sum(column.cast("decimal(28,12)")).cast("double") / F.nullif(F.count(column), F.lit(0)), digits)
