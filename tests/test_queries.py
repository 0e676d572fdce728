import pytest

import __spark_entry__
from tarmac.queries import ORACLES, QUERIES
from tests.compare import oracle, rows_of

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = oracle(ORACLES[name], SF)
    for frame in (got, want):
        for c in frame.columns:
            if str(frame[c].dtype).startswith("datetime"):
                frame[c] = frame[c].astype("datetime64[us]").astype("int64").where(frame[c].notna(), -1)
            elif str(frame[c].dtype).startswith(("int", "Int")):
                frame[c] = frame[c].astype("float64")
            elif str(frame[c].dtype).startswith("float"):
                frame[c] = frame[c].astype("float64") + 0.0
    assert rows_of(got) == rows_of(want)
    assert len(got)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())
