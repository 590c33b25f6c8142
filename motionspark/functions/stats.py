"""Statistics as Spark expressions, with the conventions of the analyses: missing values are NULL and are left out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def values_of(value: Column) -> Column:
    """The group's values in ascending order, as an array; for groups that fit a task, such as one recording's frames."""
    return F.array_sort(F.collect_list(value))


def hazen(ordered: Column, p: float) -> Column:
    """Percentile ``p`` of an ascending array at the midpoint positions n*p/100 + 0.5; NULL if it is empty."""
    n = F.size(ordered)
    h = F.greatest(F.lit(1.0), F.least(n.cast("double"), n * F.lit(p / 100) + 0.5))
    lo = F.floor(h).cast("int")
    at = lambda k: F.get(ordered, F.least(k, n - 1))
    return at(lo - 1) + (h - lo) * (at(lo) - at(lo - 1))


def sample_std(value: Column) -> Column:
    """Standard deviation over n-1; 0 for one value, NULL for none."""
    return F.coalesce(F.stddev_samp(value), F.when(F.count(value) == 1, 0.0))


def share(flag: Column) -> Column:
    """Mean of a flag in which a missing flag counts as false."""
    return F.avg(F.coalesce(flag, F.lit(False)).cast("double"))
