"""Every registered query against its SQL on the smallest tables."""
from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from checks.oracles import ORACLES
from checks.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def clean(value):
    return None if isinstance(value, float) and math.isnan(value) else value


def comparable(rows, columns):
    order = [columns.index(c) for c in sorted(columns)]
    made = [tuple(clean(row[i]) for i in order) for row in rows]
    return sorted(made, key=lambda row: tuple((v is None, str(v)) for v in row))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, SF_DIR)
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    assert comparable([tuple(r) for r in df.collect()], df.columns) == comparable(cursor.fetchall(), columns)
