"""Makes this package importable in the Python workers of any cluster."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch, where the session has Spark's default of 10 000: texts may be long, and a task holds a batch on both sides.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's source to all executors, once for each SparkContext, and bounds the session's Arrow batches."""
    context = spark.sparkContext
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    if not getattr(context, "_graphloom_shipped", False):
        archive = Path(tempfile.mkdtemp(prefix="graphloom-ship-")) / "graphloom_source.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(_PACKAGE.rglob("*.py")):
                out.write(file, file.relative_to(_PACKAGE.parent))
        context.addPyFile(str(archive))
        context._graphloom_shipped = True
    return spark
