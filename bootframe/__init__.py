"""bootframe: resampling statistics on Spark DataFrames.

Grouped means and medians with percentile bootstrap intervals over many
category sets, and Cohen's d with basic bootstrap intervals, each computed
for all replicates, scales and sets in one distributed plan.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions handed to Python workers (mapInPandas / applyInPandas) travel by value,
# so executors need numpy/pandas but not this package on their path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from bootframe.operators.columns import as_sets, drop_columns, match_columns, string_columns  # noqa: E402
from bootframe.operators.intervals import basic_ci, percentile_ci  # noqa: E402
from bootframe.operators.reshape import to_long  # noqa: E402
from bootframe.operators.resample import exact_weights, resample, row_index  # noqa: E402
from bootframe.operators.stats import cohens_d, group_stats, grouping_sets_stats, levels, profile  # noqa: E402
from bootframe.plans.bootstrap import boot_cohens_d, boot_custom, boot_custom_pandas, boot_stats, boot_stats_sets  # noqa: E402

__all__ = [
    "as_sets",
    "basic_ci",
    "boot_cohens_d",
    "boot_custom",
    "boot_custom_pandas",
    "boot_stats",
    "boot_stats_sets",
    "cohens_d",
    "drop_columns",
    "exact_weights",
    "group_stats",
    "grouping_sets_stats",
    "levels",
    "match_columns",
    "percentile_ci",
    "profile",
    "resample",
    "row_index",
    "string_columns",
    "to_long",
]
