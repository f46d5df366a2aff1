"""Sessions, and getting the package to Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def session(name: str = "plumbline", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings by keyword, dots as double underscores."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors' Python workers, once for each application, unless their path already has it."""
    root = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    if app in _shipped or str(root.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _shipped.add(app)
    folder = tempfile.mkdtemp(prefix="plumbline-")  # the driver serves the file from here to executors that come later
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "plumbline.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
