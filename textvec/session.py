"""Make this package importable on the executors of any session."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's source to the executors once per application; Arrow kernels import it there."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        top = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="textvec-src-")
        path = os.path.join(folder, "textvec_src.zip")
        with zipfile.ZipFile(path, "w") as out:
            for at, _, names in os.walk(top):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(at, name)
                        out.write(full, os.path.join("textvec", os.path.relpath(full, top)))
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(app)
    return spark
