"""Every registered query of the reference operators: against its SQL, or that it runs and gives rows."""

import pytest

from linkwright.queries import load
from tests.conftest import as_rows

QUERIES, ORACLES = load()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(name, spark, sf, duck):
    got = as_rows(QUERIES[name](spark, sf).toPandas())
    want = as_rows(duck.execute(ORACLES[name]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1]):
        assert a == pytest.approx(b, abs=2e-6) if all(isinstance(v, (int, float)) for v in (*a, *b)) else a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, sf):
    df = QUERIES[name](spark, sf)
    assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
