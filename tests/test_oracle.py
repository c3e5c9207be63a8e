"""Every registered query against its DuckDB oracle (sf0.001), the way the driver compares."""

import pytest

from conftest import SF_SMALL
from oracle_check import check


def test_all_registered_queries_match_oracle(spark):
    res = check(spark, SF_SMALL, verbose=False)
    bad = {k: v for k, v in res.items() if v.get("ok") is False}
    assert not bad, bad


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and df.columns == ["total", "correct", "failed", "accuracy"]


@pytest.mark.parametrize("name", ["s1_accuracy", "s2_rates"])
def test_schema_stable(spark, name):
    import __spark_entry__ as E
    a = E.queries()[name](spark, SF_SMALL).schema
    b = E.queries()[name](spark, SF_SMALL).schema
    assert a == b
