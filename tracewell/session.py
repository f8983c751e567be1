"""Sessions: a local one for tests, and shipping this package to the executors of any session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def local_session(cores: str = "*", shuffle_partitions: int = 8, **settings: str) -> SparkSession:
    """A session for tests and single-machine runs; further settings by name, underscores for dots."""
    builder = SparkSession.builder
    for k, v in settings.items():
        builder = builder.config(k.replace("_", "."), v)
    return (
        builder.master(f"local[{cores}]")
        .appName("tracewell")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TRACEWELL_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="tracewell-")  # executors fetch it as they start, so it stays until the end
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        target = f"{folder}/tracewell-package.zip"
        with zipfile.ZipFile(target, "w") as z:
            for file in sorted(root.rglob("*.py")):
                z.write(file, file.relative_to(root.parent))
        spark.sparkContext.addPyFile(target)
        _shipped.add(app)
    return spark
