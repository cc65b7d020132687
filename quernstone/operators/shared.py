"""A folder that the driver and all executors share, for stores that queries make."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_at_exit: set[str] = set()


def folder(spark: SparkSession, label: str) -> str:
    """A new path below ``spark.checkpoint.dir``; on a local master without it, below a temporary folder. What is there goes when the driver's process ends."""
    root, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _local.setdefault(app, tempfile.mkdtemp(prefix="quernstone-"))
    own = f"{_qualified(spark, root).rstrip('/')}/quernstone-stores/{app}"
    if own not in _at_exit:
        _at_exit.add(own)
        atexit.register(_forget, spark, own)
    return f"{own}/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder, for what reads them more than once."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _qualified(spark: SparkSession, root: str) -> str:
    """The folder with its scheme: without one it lies on the default file system, as Spark takes it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _forget(spark: SparkSession, own: str) -> None:
    if spark.sparkContext._jsc is not None:  # else the application has ended before its process
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
