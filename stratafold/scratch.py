"""Intermediate tables in the shared folder, and moves of whole folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Temporary folder of each local application that names no checkpoint folder.
_LOCAL: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder in local mode, and an error on a cluster, whose machines share none."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="stratafold-")
    return _LOCAL[app]


def fresh(spark: SparkSession, name: str) -> str:
    """A path below :func:`root` that nothing uses yet."""
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, at: str | None = None) -> DataFrame:
    """``df`` written to ``at`` (or a fresh path) and read back: computed once, and kept when executors are lost."""
    path = at or fresh(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the folders of frames that :func:`saved` returned and that nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, df._scratch)


def _path(spark: SparkSession, path: str):
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(context._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _path(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _path(spark, path)
    fs.delete(at, True)


def replace(spark: SparkSession, new: str, path: str) -> None:
    """The folder ``new`` in place of ``path``; the old one goes last."""
    at, fs = _path(spark, path)
    made, _ = _path(spark, new)
    old, _ = _path(spark, f"{beside(path)}-old-{uuid.uuid4().hex}")
    there = fs.exists(at)
    if there and not fs.rename(at, old):
        raise OSError(f"cannot move {path}")
    fs.mkdirs(at.getParent())
    if not fs.rename(made, at):
        raise OSError(f"cannot move {new} to {path}")
    if there:
        fs.delete(old, True)


def beside(path: str) -> str:
    """A hidden sibling's name: readers of the parent pass over it."""
    parent, _, name = path.rstrip("/").rpartition("/")
    return f"{parent}/_{name}"
