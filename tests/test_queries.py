"""Every query of the library against its SQL twin, at the smallest scale."""

from __future__ import annotations

import pytest

from palimpsest import catalog
from tests.oracle import rows_of, rows_of_sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    columns, rows = rows_of(catalog.queries()[name](spark, SF))
    wanted_columns, wanted = rows_of_sql(catalog.oracle_sql()[name], SF)
    assert columns == wanted_columns
    assert rows == wanted


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
