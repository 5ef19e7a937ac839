from __future__ import annotations

import sys
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pagetally.session import configure  # noqa: E402
from pagetally.sources.files import EVENT_SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    builder = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    session = configure(builder).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_events(spark):
    """Events from dicts: unnamed columns are null, with a usual host, agent and weight."""

    def build(*rows: dict):
        usual = {
            "hostname": "www.example.com", "host": "rum.example.net", "user_agent": "desktop:mac",
            "url": "https://www.example.com/", "weight": 100, "checkpoint": "top",
        }
        filled = []
        for row in rows:
            full = {**usual, **row}
            if isinstance(full["time"], str):
                full["time"] = datetime.fromisoformat(full["time"]).replace(tzinfo=timezone.utc)
            filled.append(tuple(full.get(f.name) for f in EVENT_SCHEMA.fields))
        return spark.createDataFrame(filled, T.StructType(EVENT_SCHEMA.fields))

    return build
