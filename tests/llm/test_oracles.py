"""The operators that SQL can express against their SQL, on the smallest tables."""
from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from pagetally.llm.oracles import ORACLES
from pagetally.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.mark.parametrize("name", list(ORACLES))
def test_operator(name, spark):
    duck = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, SF_DIR)
    cursor = duck.execute(ORACLES[name])
    assert [d[0] for d in cursor.description] == df.columns
    assert sorted(map(tuple, df.collect()), key=str) == sorted(cursor.fetchall(), key=str)
