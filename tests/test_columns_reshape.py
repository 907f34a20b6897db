import pytest
from pyspark.sql import functions as F

from bootframe.operators.columns import as_sets, drop_columns, match_columns, numeric_columns, string_columns
from bootframe.operators.reshape import to_long


def test_string_columns_are_default_categories(survey):
    assert string_columns(survey) == ["RID", "gender", "smoke"]
    assert as_sets(None, drop_columns(survey, "RID")) == [["gender"], ["smoke"]]


def test_match_columns_regex(survey):
    assert match_columns(survey, "^IPIP.*$") == ["IPIP50_agree", "IPIP50_open", "IPIP100_calm"]
    assert match_columns(survey, "^IPIP50") == ["IPIP50_agree", "IPIP50_open"]


def test_as_sets_wraps_names():
    assert as_sets(["a", ("b", "c"), []]) == [["a"], ["b", "c"], []]


def test_drop_unknown_column_is_an_error(survey):
    with pytest.raises(ValueError):
        drop_columns(survey, "nope")
    assert "nope" not in drop_columns(survey, "nope", missing_ok=True).columns


def test_text_measure_is_rejected(survey):
    with pytest.raises(TypeError):
        numeric_columns(survey, ["gender"])


def test_to_long_keeps_nulls_and_mixes_int_double(survey):
    long = to_long(survey, ["RID"], ["age", "IPIP50_agree"])
    assert long.count() == 2 * survey.count()
    assert dict(long.dtypes)["value"] == "double"
    nulls = long.where(F.col("value").isNull()).count()
    assert nulls == survey.where(F.col("IPIP50_agree").isNull()).count()
