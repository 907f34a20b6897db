"""Wide ↔ long reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_long(
    df: DataFrame,
    ids: Sequence[str],
    values: Sequence[str],
    variable: str = "scale",
    value: str = "value",
) -> DataFrame:
    """Unpivot ``values`` into (ids..., variable, value), one row per id row and value column.

    Values are cast to DOUBLE first so integer and double measures mix. NULL
    values are kept (as in a melt).
    """
    if not values:
        raise ValueError("to_long needs at least one value column")
    cast = df.select(*[F.col(c) for c in ids], *[F.col(c).cast("double").alias(c) for c in values])
    return cast.unpivot(list(ids), list(values), variable, value)
