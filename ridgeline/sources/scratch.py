"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where the setting is absent in a local session, as in tests, is a
    folder of this machine chosen instead; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ridgeline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _session_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/ridgeline/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh place among this session's intermediate tables."""
    return f"{_session_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a reread of the table, not the work
    that made it.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    """The file system and path object of a path, by Spark's own means."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished tables (with a _SUCCESS mark) in a folder, in order."""
    files, at = _at(spark, path)
    if not files.exists(at):
        return []
    names = [s.getPath().getName() for s in files.listStatus(at) if s.isDirectory()]
    return sorted(n for n in names if _at(spark, f"{path}/{n}/_SUCCESS")[0].exists(_at(spark, f"{path}/{n}/_SUCCESS")[1]))


def delete(spark: SparkSession, path: str) -> None:
    """Remove one table's folder."""
    files, at = _at(spark, path)
    files.delete(at, True)


def drop_scratch(spark: SparkSession) -> None:
    """Remove the intermediate tables that this session wrote; those of others
    in the shared folder stay.  DataFrames that read them no longer work."""
    delete(spark, _session_dir(spark))
