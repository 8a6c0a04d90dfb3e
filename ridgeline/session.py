"""Sessions and table access."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def local_session(cores: int | str = 8, memory: str = "12g", **conf: str) -> SparkSession:
    """A local session with the settings the library expects."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name`` below ``root``, by any path Spark can read."""
    return spark.read.parquet(f"{root}/{name}.parquet")


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Spark's own value of that setting, and this library's where it is unchanged.
_SPARKS_BYTES, _BYTES = str(64 << 20), str(4 << 20)


def ship_package(spark: SparkSession) -> None:
    """Let the Python workers of a session's executors import this package.

    Where they already can (it is installed, or on their path), the shipped
    copy is the same code.  Rows are whole texts, so Arrow batches of a session
    that has not set their bytes are kept to 4 MB from then on; Spark reads
    that setting when a plan runs, not when it is made.
    """
    if spark.conf.get(_BATCH_BYTES).rstrip("b") == _SPARKS_BYTES:
        spark.conf.set(_BATCH_BYTES, _BYTES)
    context = spark.sparkContext
    if getattr(context, "_ridgeline_shipped", False):
        return
    root = Path(__file__).resolve().parent
    name = Path(tempfile.mkdtemp(prefix="ridgeline-package-")) / "ridgeline.zip"
    with zipfile.ZipFile(name, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(name))
    context._ridgeline_shipped = True
