"""Every query of the core that has SQL, against that SQL; the others must run."""

import pytest

from conftest import SF, against_sql
from screeline.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    against_sql(spark, SF, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() >= 0 and len(df.columns) > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["track_id", "seq_no", "pt_no"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
