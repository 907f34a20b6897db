"""Order-statistic helpers over bounded arrays of replicate values.

The replicate distribution of one group holds at most ``n_iter`` values, a
bound fixed by the caller, so sorting it as an array inside one aggregate is safe.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INTERPOLATIONS = ("nearest", "disc", "linear")


def sorted_values(value: Column) -> Column:
    """Aggregate: the non-null values of a group, ascending."""
    return F.sort_array(F.collect_list(value))


def nearest_index(m: Column, q: float) -> Column:
    """0-based index of the "nearest" order statistic: ``floor((m - 1) q + 0.5)``."""
    return F.floor((m - F.lit(1)) * F.lit(float(q)) + F.lit(0.5)).cast("int")


def nearest_quantile(arr: Column, q: float) -> Column:
    """The nearest-rank quantile of a sorted array (NULL when it is empty)."""
    m = F.size(arr)
    return F.when(m > 0, F.try_element_at(arr, nearest_index(m, q) + F.lit(1)))


def quantile_agg(value: str, q: float, interpolation: str = "nearest") -> Column:
    """Aggregate expression for one quantile of column ``value`` per group (nulls ignored).

    ``nearest``: element ``floor((m-1)q + 0.5)``; ``disc``: ``percentile_disc``;
    ``linear``: ``percentile`` (linear interpolation between order statistics).
    """
    if interpolation == "nearest":
        return nearest_quantile(sorted_values(F.col(value)), q)
    if interpolation == "disc":
        return F.expr(f"percentile_disc({float(q)!r}) WITHIN GROUP (ORDER BY `{value}`)")
    if interpolation == "linear":
        return F.percentile(F.col(value), F.lit(float(q)))
    raise ValueError(f"interpolation must be one of {INTERPOLATIONS}, got {interpolation!r}")
