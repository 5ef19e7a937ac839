"""Session settings the reports are tuned for, and the package for the executors."""
from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    # time ranges and slots are computed from instants
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # the JIT leaves methods above 8000 bytes of bytecode interpreted; wide reports are then
    # faster in smaller pieces than as one fused stage
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # a session that runs many reports keeps their generated classes
    "spark.sql.codegen.cache.maxEntries": "2000",
    # no Python call-site capture per expression; reports build some hundred expressions each
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

_SHIPPED: set[str] = set()


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return builder


def ship(spark: SparkSession, root: Path) -> None:
    """Give the executors' Python the package, once for each application; nothing else has to be installed there."""
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    archive = Path(tempfile.mkdtemp(prefix="pagetally-")) / "pagetally.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted((root / "pagetally").rglob("*.py")):
            out.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(application)
