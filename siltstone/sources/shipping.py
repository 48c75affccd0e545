"""The package for Python workers: executors need not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package's sources to the workers, once a session, by the driver's own file server."""
    context = spark.sparkContext
    if context.applicationId in _DONE:
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="siltstone-core-")) / "siltstone-core.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        for source in sorted(package.rglob("*.py")):
            packed.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _DONE.add(context.applicationId)
