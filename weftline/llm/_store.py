"""The shared workspace: tables and files that outlive an executor.

Everything that a later job reads again lies under ``spark.checkpoint.dir``, which
driver and executors share. Where the setting is absent a folder is made and set, on
one machine only (master ``local``); a cluster without it is an error.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from functools import wraps

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = "spark.checkpoint.dir"
ROW_GROUP = 32 << 20  # a writer holds one in memory


def workspace(spark: SparkSession, label: str) -> str:
    """URI of a new folder for one run of an operator."""
    base = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"{KEY} must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set(KEY, base)
    if "://" not in base:
        base = ("file://" if base.startswith("/") else "") + base.removeprefix("file:")
    return f"{base.rstrip('/')}/weftline/{label}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, where: str, name: str) -> DataFrame:
    """Writes df as Parquet and reads it back: the lineage ends there."""
    path = f"{where}/{name}"
    df.write.option("parquet.block.size", ROW_GROUP).mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(df: DataFrame, order: str, sums: dict[str, str], key: str | None = None, width: int = 1000) -> DataFrame:
    """df with, for each name of sums, the sum of the column it gives over the rows before in ``order``.

    order: a long that no two rows of a key share. The sums are taken in two levels, so
    that a task holds at most width rows of a key, or one row for each width of them.
    """
    own = [key] if key else []
    out = df.withColumn("_level", F.floor(F.col(order) / width))
    upper = out.groupBy(*own, "_level").agg(*[F.sum(v).alias(f"_sum_{a}") for a, v in sums.items()])
    before = Window.partitionBy(*own).orderBy("_level").rowsBetween(Window.unboundedPreceding, -1)
    upper = upper.select(*[F.col(k).alias(f"_of_{k}") for k in own], F.col("_level").alias("_at"), *[F.coalesce(F.sum(f"_sum_{a}").over(before), F.lit(0)).alias(f"_base_{a}") for a in sums])
    inside = Window.partitionBy(*own, "_level").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumns({a: F.coalesce(F.sum(v).over(inside), F.lit(0)) for a, v in sums.items()})
    same = F.col("_level") == F.col("_at")
    for k in own:
        same &= F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    out = out.join(upper, same)
    return out.select(*df.columns, *[(F.col(a) + F.col(f"_base_{a}")).cast("long").alias(a) for a in sums])


def drop(spark: SparkSession, where: str, *names: str) -> None:
    """Removes tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{where}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: What workers keep from one task to the next, by the name of its owner.
KEPT: dict[str, dict] = {}


def _begin(owner: str) -> None:
    """Empties what other operators left in this worker."""
    for name, kept in KEPT.items():
        if name != owner:
            kept.clear()


def _end() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run, owner: str = ""):
    """A task's function over batches that gives memory back: workers live on, and what they keep adds up.

    Before it, only what ``owner`` keeps in KEPT stays; after it, freed memory returns to the system.
    """

    @wraps(run)
    def tidied(batches):
        _begin(owner)
        try:
            yield from run(batches)
        finally:
            _end()

    return tidied


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """Any store that pyarrow knows (file, hdfs, s3, gs), and the path within it."""
    return pafs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def writing(uri: str):
    """A stream to a file that appears whole: under a name of its own first, then moved, so that retried or speculative tasks leave one result."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex[:8]}.part"
    try:
        with fs.open_output_stream(draft, compression=None) as out:
            yield out
        fs.move(draft, path)
    except BaseException:
        with contextlib.suppress(OSError):
            fs.delete_file(draft)
        raise


def put(uri: str, data) -> None:
    with writing(uri) as out:
        for piece in data if isinstance(data, list) else [data]:
            out.write(piece)


def get(uri: str) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()
