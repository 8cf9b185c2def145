"""Every query of the catalogue against its SQL."""

from __future__ import annotations

import pytest

from inkfold.plans import catalogue

from .conftest import DATA, rows_of


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, sql):
    got = catalogue.QUERIES[name](spark, str(DATA)).toPandas()
    if name not in catalogue.ORACLES:
        assert list(got.columns)
        return
    want = sql(catalogue.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
