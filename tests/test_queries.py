"""Every registered query of the library against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import pytest

from quillgraph.jobs.queries import ORACLES, QUERIES
from tests.compare import rows_of, rows_of_sql

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert rows_of(QUERIES[name](spark, SF)) == rows_of_sql(SF, ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
