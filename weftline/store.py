"""Tables that cut lineage: written under spark.checkpoint.dir, which all executors share; a folder of its own only on one machine."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def workspace(spark: SparkSession, label: str) -> str:
    base = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"{KEY} must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set(KEY, base)
    return f"{base.rstrip('/')}/weftline/{label}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
