"""Tables written between steps: what several later steps read is computed once, and survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder shared by driver and executors. Where the session names none, a local session (tests) gets a temporary one, and any
    other is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="locusloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def held(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` as a written table, in the shared folder unless a path is given."""
    path = path or f"{folder(df.sparkSession)}/steps/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bytes_of(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path; 0 where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getContentSummary(at).getLength() if files.exists(at) else 0


def version_of(spark: SparkSession, path: str) -> tuple:
    """Changes when the files of a table do: names, lengths and times of what is at the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.listStatus(at) if files.exists(at) else []
    return tuple((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found)
