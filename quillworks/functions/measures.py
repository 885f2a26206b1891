"""Mean engagement rates from sums and counts.

Snapshots are summed before any join, so the mean of a group is rebuilt from the
decimal sum and the number of snapshots; the result does not depend on the order
or the number of partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean_rate(total: Column, snapshots: Column) -> Column:
    """Mean with six decimals, 0 for a group without snapshots."""
    mean = F.try_divide(total.cast("decimal(38,2)"), snapshots.cast("decimal(20,0)"))
    return F.coalesce(mean.cast("decimal(38,6)"), F.lit(0).cast("decimal(38,6)"))


def shown_rate(mean: Column) -> Column:
    """Rate as shown: two decimals, half away from zero."""
    return F.round(mean, 2).cast("double")


def zero_if_null(column: Column) -> Column:
    return F.coalesce(column, F.lit(0).cast("bigint"))
