"""Readers and writers for the file formats that Spark has built in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FORMATS = ("parquet", "orc", "json", "csv")


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """A table from files.  Text formats need a schema, so that no pass over
    the data is spent on guessing one."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; known: {', '.join(FORMATS)}")
    if fmt in ("json", "csv") and schema is None:
        raise ValueError(f"{fmt} needs a schema")
    reader = spark.read.format(fmt).options(**({"header": "true"} if fmt == "csv" else {}) | options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "errorifexists", **options: str) -> None:
    """Files of ``df``, one folder per value of ``partition_by``, each folder
    written by few tasks."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; known: {', '.join(FORMATS)}")
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.format(fmt).mode(mode).options(**({"header": "true"} if fmt == "csv" else {}) | options).partitionBy(*partition_by).save(path)
