"""Every query with SQL against DuckDB; every other one runs and has rows."""

import pytest
from oracle import duck, rows

from mnemospark.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        assert rows(got) == rows(duck(ORACLES[name], SF))
    else:
        assert len(got)


def test_entry_without_the_training_data_subpackage():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(ORACLES) <= set(e.oracle_sql())
