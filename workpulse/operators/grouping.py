"""Counts, sums and means per group, with null keys left out.

All of them combine on the map side, so one hot key costs one row per task in the shuffle.
"""

from pyspark.sql import Column, DataFrame, functions as F

from workpulse.functions.dates import mean_days


def keyed(frame: DataFrame, keys) -> DataFrame:
    """Rows whose keys are all given; blank text is given. Plain null tests reach the scan."""
    given = F.lit(True)
    for key in keys:
        given = given & F.col(f"`{key}`").isNotNull()
    return frame.where(given)


def count_by(frame: DataFrame, *keys, name="total") -> DataFrame:
    return keyed(frame, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def sum_or_zero(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0.0))


def sum_by(frame: DataFrame, measure, *keys) -> DataFrame:
    return keyed(frame, keys).groupBy(*keys).agg(sum_or_zero(F.col(f"`{measure}`")).alias(measure))


def mean_lead_by(frame: DataFrame, key, name="lead_time", lead="lead_time") -> DataFrame:
    return keyed(frame, [key]).groupBy(key).agg(mean_days(F.col(lead)).alias(name))


def with_share(groups: DataFrame, measure, name="share") -> DataFrame:
    """Part of each group in the total; the total is a one-value subquery over the grouped rows."""
    total = groups.agg(F.sum(f"`{measure}`").cast("double")).scalar()
    return groups.withColumn(name, F.col(f"`{measure}`") / F.nullif(total, F.lit(0.0)))
