"""Ships this package to the Python workers, which may not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the application, once; a no-op for later calls."""
    context = spark.sparkContext
    if context.applicationId in _DONE:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="hireframe-"), "hireframe.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("hireframe", os.path.relpath(full, root)))
    context.addPyFile(path)
    _DONE.add(context.applicationId)
