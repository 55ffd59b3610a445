"""Ratios and flags over counts."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double, NULL when the whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def completeness(on_time: Column, late: Column) -> Column:
    return ratio(on_time, on_time + late)


def zero_if_null(count: Column) -> Column:
    return F.coalesce(count, F.lit(0)).cast("long")


def share_of(condition: Column) -> Column:
    return F.avg(condition.cast("double"))
