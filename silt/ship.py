"""Makes this package importable in Python workers, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's modules to the executors by Spark's file server, once for each SparkContext."""
    sc = spark.sparkContext
    if not getattr(sc, "_silt_shipped", False):
        root = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="silt-"), "silt-modules.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, files in os.walk(root):
                for f in sorted(files):
                    if f.endswith(".py"):
                        full = os.path.join(folder, f)
                        z.write(full, os.path.join("silt", os.path.relpath(full, root)))
        sc.addPyFile(path)
        sc._silt_shipped = True
    return spark
