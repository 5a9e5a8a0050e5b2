"""Every registered query of the engine against its DuckDB SQL."""

import pytest

from tests.helpers import duck_rows, spark_rows
from tidespan.plans import catalogue

ORACLES = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, duck, name):
    assert spark_rows(catalogue.queries()[name](spark, sf)) == duck_rows(duck.sql(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(ORACLES)))
def test_rows_only(spark, sf, name):
    df = catalogue.queries()[name](spark, sf)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
