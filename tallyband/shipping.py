"""Getting this package to the executors, for the operators that run Python there."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> None:
    """Hand the package's sources to Spark, once a session; not needed where executors have it installed, but harmless."""
    context = spark.sparkContext
    if getattr(context, "_tallyband_shipped", False) or not os.path.isdir(PACKAGE):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tallyband-"), "tallyband.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("tallyband", os.path.relpath(full, PACKAGE)))
    context.addPyFile(path)
    context._tallyband_shipped = True
