"""Shared folder, written tables and column handling."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share.

    Only where that is unset, and Spark runs inside one machine as in tests, a
    temporary folder is set instead; a cluster without the setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if got.isDefined():
            root = got.get()
        elif spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            root = tempfile.mkdtemp(prefix="tabsift-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"{root.rstrip('/')}/tabsift-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of shared_dir; does nothing once the session has ended."""
    if spark.sparkContext._jsc is None:
        return
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the gateway may be gone when the interpreter ends
        return


def local_path(path: str) -> str:
    """The mounted path of a shared folder, for files that workers map into memory."""
    if path.startswith("file:") or "://" not in path:
        return unquote(urlparse(path).path) if path.startswith("file:") else path
    raise ValueError(f"memory-mapped files need a mounted shared folder, not {path}")


def stash(df: DataFrame, at: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: this cuts lineage and survives lost executors."""
    path = at or shared_dir(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def col(name: str):
    """A top-level column, whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet, under case-insensitive rules."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def key_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()
