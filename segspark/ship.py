"""Ships this package to the Python workers, so that executors need no installation of it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ensure(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once per application."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent
    if sc.applicationId in _shipped or not root.is_dir():
        return
    folder = os.path.realpath(tempfile.mkdtemp(prefix="segspark-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "segspark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
