"""A keyed table in buckets, each version of which is one atomic step.

``log/<number>.json`` names the folder of every bucket; the largest number is
the table.  A version is made by writing new folders for the buckets that
change and then moving its log file into place, which fails if another writer
was first.  Readers see one version or the next, never parts of both.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(Exception):
    """Another writer made the version first."""


@dataclass
class Version:
    """``folders`` by bucket, ``batches``: the last batch of each writer."""

    number: int = 0
    folders: dict[str, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)
    buckets: int = 0
    schema: str = ""


class VersionedTable:
    """The table in ``root``, keyed by ``keys``; ``buckets`` counts for the
    first version."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], buckets: int = 16):
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/log")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def version(self, number: int | None = None) -> Version:
        """The latest version, or that of a number; version 0 is empty."""
        files, log = self._files()
        if number is None:
            found = [int(s.getPath().getName().split(".")[0]) for s in files.listStatus(log) if s.getPath().getName().endswith(".json")] if files.exists(log) else []
            number = max(found, default=0)
        if not number:
            return Version(buckets=self.buckets)
        text = "\n".join(r[0] for r in self.spark.read.option("wholetext", True).text(f"{self.root}/log/{number}.json").collect())
        return Version(**json.loads(text))

    def read(self, number: int | None = None) -> DataFrame | None:
        """Rows of a version; None of one without any."""
        version = self.version(number)
        return self._rows(version, list(version.folders)) if version.schema else None

    def _rows(self, version: Version, buckets: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(version.schema))
        paths = [f"{self.root}/{version.folders[b]}" for b in buckets if b in version.folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _publish(self, version: Version) -> None:
        """Move the log file into place, which only one writer can."""
        jvm, (files, log) = self.spark._jvm, self._files()
        files.mkdirs(log)
        path = jvm.org.apache.hadoop.fs.Path
        new, name = path(f"{self.root}/log/.{uuid.uuid4().hex}"), path(f"{self.root}/log/{version.number}.json")
        out = files.create(new, False)
        out.write(bytearray(json.dumps(version.__dict__).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(log.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(new, name, self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            files.delete(new, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version.number} exists") from e
            raise

    def bucket(self, buckets: int):
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")

    def merge(self, rows: DataFrame, combine: Callable[[DataFrame | None, DataFrame], DataFrame], writer: str, batch: int, tries: int = 5) -> int | None:
        """A new version with ``rows`` merged by ``combine`` (old rows of the
        touched buckets or None, rows), which must keep the keys apart.

        A batch number that the writer has committed, or a smaller one, changes
        nothing and gives None: a batch that is run again after a failure is
        merged once.  A batch without rows is noted too.  Buckets without a row
        of the batch keep their files.  If another writer was first, the merge
        is made again on its version.
        """
        for _ in range(tries):
            version = self.version()
            if version.batches.get(writer, -1) >= batch:
                return None
            touched = [r["bucket"] for r in rows.select(self.bucket(version.buckets).alias("bucket")).distinct().collect()]
            folder = f"data/{version.number + 1}-{uuid.uuid4().hex}"
            new = Version(version.number + 1, dict(version.folders), {**version.batches, writer: batch}, version.buckets, version.schema)
            if touched:
                old = self._rows(version, [str(b) for b in touched]) if version.schema else None
                merged = combine(old, rows)
                merged.withColumn("_bucket", self.bucket(version.buckets)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
                new.schema = merged.schema.json()
                files, _log = self._files()
                for b in touched:
                    own = f"{folder}/_bucket={b}"
                    new.folders.pop(str(b), None)
                    if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{own}")):
                        new.folders[str(b)] = own
            try:
                self._publish(new)
            except Conflict:
                files, _log = self._files()
                files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}"), True)
                continue
            return new.number
        raise Conflict(f"no version made in {tries} tries")
