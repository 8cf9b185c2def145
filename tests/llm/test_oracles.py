"""The training-data queries against SQL where SQL can express them."""

from __future__ import annotations

import pytest

from inkfold.llm import queries

from ..conftest import DATA, rows_of


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(name, spark, sql):
    got = queries.QUERIES[name](spark, str(DATA)).toPandas()
    want = sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


COLUMNS = {"p1_found": "sample_id defect", "p2_found": "source cutoff kept", "p3_found": "field term mark", "p4_found": "row_a row_b", "p5_found": "family_a family_b", "p6_found": "row_a row_b", "p7_ids": "doc_id ids", "p9_found": "doc_a doc_b"}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(name, spark):
    frame = queries.QUERIES[name](spark, str(DATA))
    assert frame.columns == COLUMNS[name].split() and frame.count() == frame.distinct().count()
