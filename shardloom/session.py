"""A session with the settings that the operators count on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()

#: Hash orders and dates don't depend on the machine; of repeated map keys the last counts.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.mapKeyDedupPolicy": "LAST_WIN", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}


def session(app: str = "shardloom", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the workers, once an application, unless they find it on PYTHONPATH."""
    sc = spark.sparkContext
    if str(_ROOT) not in os.environ.get("PYTHONPATH", "").split(":") and sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        folder = tempfile.mkdtemp(prefix="shardloom-")
        archive = Path(folder, "shardloom-workers.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted((_ROOT / "shardloom").rglob("*.py")):
                out.write(path, path.relative_to(_ROOT))
        sc.addPyFile(str(archive))
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return spark
