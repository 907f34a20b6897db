import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bootframe.session import local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores="*", shuffle_partitions=8, app="bootframe-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def survey(spark):
    """F1-style fixture: subject id, string keys with nulls, IPIP scores with nulls, rare group."""
    import random

    rnd = random.Random(7)
    rows = []
    genders = ["female", "male", None]
    smoke = ["never", "past", "current"]
    for i in range(400):
        g = genders[0] if i % 3 == 0 else genders[1] if i % 3 == 1 else (genders[2] if i % 41 == 0 else "female")
        s = smoke[i % 3] if i != 5 else "rare"
        a = None if i % 17 == 0 else round(rnd.uniform(1, 5), 2)
        b = None if g == "male" and i % 2 == 0 and i < 40 else round(rnd.uniform(1, 5), 1)
        rows.append((f"R{i:04d}", g, s, 20 + i % 50, a, b, float(i % 5)))
    return spark.createDataFrame(
        rows, "RID string, gender string, smoke string, age int, IPIP50_agree double, IPIP50_open double, IPIP100_calm double"
    )
