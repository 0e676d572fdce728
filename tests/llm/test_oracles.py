import pytest

from tarmac.llm.registry import ORACLES, QUERIES
from tests.compare import oracle, rows_of

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(ORACLES))
def test_oracle(spark, name):
    got, want = QUERIES[name](spark, SF).toPandas(), oracle(ORACLES[name], SF)
    for frame in (got, want):
        for c in frame.columns:
            if frame[c].isna().any():  # a column of integers with nulls has another type on either side
                frame[c] = frame[c].astype(object).where(frame[c].notna(), None)
            elif str(frame[c].dtype).startswith(("int", "Int")):
                frame[c] = frame[c].astype("int64")
    assert len(got) == len(want) and rows_of(got) == rows_of(want)
