"""Sends this package to the executors, once a Spark context, and bounds the Arrow batches that Python workers get."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps

from pyspark.sql import SparkSession


BATCH, SPARKS_OWN = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def ship(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if spark.conf.get(BATCH, None) == SPARKS_OWN:  # nobody chose: long texts come in smaller batches
        spark.conf.set(BATCH, "4m")
    if getattr(sc, "_weftline_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="weftline-code-"), "weftline_code.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("weftline", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._weftline_shipped = True


def shipping(f: Callable) -> Callable:
    """f(spark, ...) with the package at hand on the executors."""

    @wraps(f)
    def run(spark, *args, **kwargs):
        ship(spark)
        return f(spark, *args, **kwargs)

    return run
