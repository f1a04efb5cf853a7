"""Sessions, and shipping the package to Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable in the Python workers; once per application.

    Nothing is sent where workers find it already, through PYTHONPATH or the working directory.
    """
    root = str(PACKAGE.parent)
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.path.realpath(os.getcwd()) == root:
        return
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="larkspur-")  # the driver's own; Spark serves the file to executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/larkspur_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def session(name: str = "larkspur", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the engine is tested under; further settings by keyword, dots as double underscores."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.showConsoleProgress": "false"}
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
