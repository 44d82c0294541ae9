"""Sessions with the settings that the engine wants, and shipping of the package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Runtime settings that large inputs want; a cluster's own settings win where they are set.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "quantspark", master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS and ``settings``."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give executors' Python workers this package, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_quantspark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="quantspark-")
    archive = os.path.join(folder, "quantspark_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*")):
            if path.suffix in {".py", ".json"}:
                out.write(path, f"{root.name}/{path.relative_to(root)}")
    context.addPyFile(archive)
    context._quantspark_shipped = True
