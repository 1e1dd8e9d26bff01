"""Folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: `spark.checkpoint.dir`, or a temporary one in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = f"file://{tempfile.mkdtemp(prefix='tidelog-')}"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, removed when the driver ends."""
    path = f"{shared_root(spark)}/tables/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a path that new_path() gave."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _written.pop(path, None)


@atexit.register
def _drop_all() -> None:
    for path, spark in list(_written.items()):
        try:
            drop_path(spark, path)
        except Exception:  # the session may be gone already
            return


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def release(*tables: DataFrame) -> None:
    """Remove tables that stored() gave, once nothing reads them any more, and let the shuffle files of finished plans go.

    Spark removes shuffle files when the driver's garbage collector finds their plans, which on a
    large heap may be long after; so it is asked to look now.
    """
    for df in tables:
        drop_path(df.sparkSession, df._stored_at)
    gc.collect()
    if tables:
        tables[0].sparkSession.sparkContext._jvm.System.gc()
