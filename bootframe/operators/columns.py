"""Column selection helpers: by type, by name pattern, by list; category sets."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def string_columns(df: DataFrame) -> list[str]:
    """Names of the string columns: the default grouping columns (categories)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def match_columns(df: DataFrame, pattern: str) -> list[str]:
    """Names of the columns whose name matches the regular expression ``pattern``."""
    rx = re.compile(pattern)
    return [c for c in df.columns if rx.search(c)]


def numeric_columns(df: DataFrame, names: Iterable[str]) -> list[str]:
    """Check that every name is a numeric column; return the list. Text measures fail clearly."""
    out = []
    types = {f.name: f.dataType for f in df.schema.fields}
    for c in names:
        if c not in types:
            raise ValueError(f"column {c!r} not found; have {df.columns}")
        if not isinstance(types[c], NUMERIC):
            raise TypeError(f"measure column {c!r} has type {types[c].simpleString()}, not numeric")
        out.append(c)
    return out


def drop_columns(df: DataFrame, *names: str, missing_ok: bool = False) -> DataFrame:
    """``df.drop`` that refuses unknown names unless ``missing_ok`` (Spark ignores them silently)."""
    unknown = [c for c in names if c not in df.columns]
    if unknown and not missing_ok:
        raise ValueError(f"cannot drop unknown columns {unknown}")
    return df.drop(*names)


def as_set(category: str | Sequence[str]) -> list[str]:
    """One category set as a list: a bare name becomes a one-element set."""
    return [category] if isinstance(category, str) else list(category)


def as_sets(categories: Iterable[str | Sequence[str]] | None, df: DataFrame | None = None) -> list[list[str]]:
    """Normalise a list of category sets. ``None`` or empty → every string column as its own set."""
    cats = list(categories or [])
    if not cats:
        if df is None:
            raise ValueError("no category sets given and no frame to take string columns from")
        cats = string_columns(df)
    return [as_set(c) for c in cats]


def set_name(cols: Sequence[str]) -> str:
    """Printable name of a set: names joined by commas ('' for the empty set)."""
    return ",".join(cols)
