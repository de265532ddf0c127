"""Makes the package importable in Python workers of executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Adds the package as an archive to the application's Python files, once.

    Functions sent to workers are pickled by reference to their module, so the module has to be
    importable there, wherever the driver's copy lies.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="corpusloom-"), "corpusloom.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("corpusloom", os.path.relpath(path, root)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
