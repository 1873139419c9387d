"""Every query of the catalogue against its SQL on the small tables."""

from __future__ import annotations

import math

import duckdb
import pytest
from conftest import SMALL

from foldline.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return connection


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    number = float(value)
    return None if math.isnan(number) else round(number, 7) + 0.0


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    made = catalogue.QUERIES[name](spark, SMALL)
    told = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in told.description]
    assert sorted(made.columns) == sorted(names)
    assert rows_of(made.columns, [tuple(r) for r in made.collect()]) == rows_of(names, told.fetchall())


# The nested runs are compared with plain versions in test_panel.
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES) - {"nested_selection", "sensitivity_grid"}))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SMALL).count() > 0
