"""Sending the package to Python workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once an application.

    The driver serves the archive to executors, which may start late, so it
    stays until the driver ends.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="tessera-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "tessera.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, Path("tessera") / path.relative_to(package))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
