"""Every registered query against its SQL in DuckDB at the smallest scale."""

from __future__ import annotations

import pytest
from compare import connect, difference

from __spark_entry__ import entry, oracle_sql, queries
from tierglass.plans.oracles import ORACLES
from tierglass.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
PLAIN_TYPES = {"BIGINT", "VARCHAR", "DOUBLE", "BOOLEAN"}


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, db, name):
    assert difference(spark, db, SF, queries()[name], oracle_sql()[name]) is None


def test_every_query_has_sql_with_plain_types(db):
    assert set(QUERIES) <= set(queries()) and set(QUERIES) <= set(oracle_sql()) <= set(queries())
    for sql in ORACLES.values():
        assert {row[1] for row in db.execute(f"DESCRIBE {sql}").fetchall()} <= PLAIN_TYPES


def test_entry_labels_every_document(spark):
    assert entry(spark).count() > 0
