import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["set", "o_orderstatus", "o_orderpriority", "scale", "stat", "median", "ci95_ll", "ci95_ul"]


def test_every_query_but_numpy_drawn_ones_has_an_oracle():
    assert set(E.QUERIES) - set(E.ORACLE_SQL) == {"boot_ci_exact_cells"}
    assert set(E.oracle_sql()) <= set(E.queries())


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_oracle_agrees_bit_for_bit_on_smallest_tables(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    key = lambda row: tuple((v is None, str(v)) for v in row)
    srows = sorted((tuple(r[c] for c in cols) for r in sdf.collect()), key=key)
    rel = duck.sql(E.oracle_sql()[name])
    orows = sorted((tuple(dict(zip(rel.columns, r))[c] for c in cols) for r in rel.fetchall()), key=key)
    assert sorted(rel.columns) == cols
    assert srows == orows
