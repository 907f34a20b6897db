"""Column-level building blocks (all JVM-side expressions, no Python UDFs)."""

from bootframe.functions.draws import draw_index, hash_bits, poisson_weight, uniform
from bootframe.functions.normal import norm_ppf
from bootframe.functions.quantiles import nearest_index, sorted_values

__all__ = [
    "draw_index",
    "hash_bits",
    "norm_ppf",
    "nearest_index",
    "poisson_weight",
    "sorted_values",
    "uniform",
]
