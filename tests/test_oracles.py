"""Every registered query with SQL gives the rows that DuckDB gives."""

import pytest
from comparing import rows_of, sql_rows

import quadrille.grid_queries  # noqa: F401  registers its queries
import quadrille.stored_queries  # noqa: F401  registers its queries
from quadrille.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf_dir, duck, name):
    assert rows_of(QUERIES[name](spark, sf_dir)) == sql_rows(duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
