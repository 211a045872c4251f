"""The package on the executors' import path, wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the session's executors, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_locusframe_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(top):
        path = os.path.join(tempfile.mkdtemp(prefix="locusframe-"), "locusframe-src.zip")
        with zipfile.ZipFile(path, "w") as out:
            for folder, _, names in os.walk(top):
                for name in sorted(n for n in names if n.endswith(".py")):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("locusframe", os.path.relpath(full, top)))
        sc.addPyFile(path)
    sc._locusframe_shipped = True
