"""Tables that are changed in place by keys, one whole version at a time.

A table is a folder of data and a folder of manifests. Rows are dealt to a fixed number of buckets by their key. A change writes
the buckets that it touches to a new folder under ``data`` and then one manifest, a single small file that names the folder of
every bucket. Readers take the latest manifest, so they see a change whole or not at all, and those that began before it go on
reading the folders of their version. A manifest is never overwritten: of two writers of one version the second fails.

Every manifest carries the number of the batch that made it. A batch that was applied is not applied again, so a stream may
replay its last batch after a failure.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 16
MANIFEST = "bucket int, folder string, batch long, source string, version int"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class VersionedTable:
    """Rows by ``key`` at ``path``, which all executors share."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> VersionedTable:
        """A new table with ``rows`` as version 0. Keys are unique; rows without a key are an error of the caller."""
        table = cls(rows.sparkSession, path, key, buckets)
        folder = table._stage(rows)
        table._publish(0, {b: folder for b in range(buckets)}, -1, "create")
        return table

    # -- manifests

    def _manifests(self) -> DataFrame:
        return self.spark.read.schema(MANIFEST).option("basePath", f"{self.path}/manifests").parquet(f"{self.path}/manifests")

    def version(self) -> int:
        return self._manifests().agg(F.max("version")).first()[0]

    def applied(self, batch: int, source: str) -> bool:
        """Whether a batch of a source has made a version."""
        return not self._manifests().filter((F.col("batch") == batch) & (F.col("source") == source)).isEmpty()

    def _folders(self, version: int) -> dict[int, str]:
        """Folder by bucket: as many rows as there are buckets."""
        return {r["bucket"]: r["folder"] for r in self._manifests().filter(F.col("version") == version).select("bucket", "folder").collect()}

    def _publish(self, version: int, folders: dict[int, str], batch: int, source: str) -> None:
        rows = [(b, f, batch, source) for b, f in sorted(folders.items())]
        entries = self.spark.createDataFrame(rows, "bucket int, folder string, batch long, source string")
        entries.coalesce(1).write.mode("error").parquet(f"{self.path}/manifests/version={version}")

    # -- data

    def _stage(self, rows: DataFrame) -> str:
        folder = uuid.uuid4().hex
        dealt = rows.withColumn("bucket", bucket_of(F.col(self.key), self.buckets))
        dealt.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        # the columns, also where no row is: an empty part that readers take the schema from
        rows.limit(0).write.parquet(f"{self.path}/schema/{folder}")
        return folder

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest if none is named."""
        folders = self._folders(self.version() if version is None else version)
        return self._read(folders)

    def _read(self, folders: dict[int, str]) -> DataFrame:
        out = None
        for folder in sorted(set(folders.values())):
            mine = [b for b, f in folders.items() if f == folder]
            schema = self.spark.read.parquet(f"{self.path}/schema/{folder}").schema
            part = self.spark.read.schema(schema.add("bucket", T.IntegerType())).parquet(f"{self.path}/data/{folder}").filter(F.col("bucket").isin(mine)).drop("bucket")
            out = part if out is None else out.unionByName(part)
        return out

    def apply(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame], batch: int, source: str = "batch") -> int:
        """Replace the buckets of ``keys`` by ``change`` of their rows; the version that holds the batch is returned.

        ``change`` takes all rows of the touched buckets and returns them, changed, without those deleted, or with new rows of
        the same buckets. Other buckets are neither read nor written.
        """
        if self.applied(batch, source):
            return self._manifests().filter((F.col("batch") == batch) & (F.col("source") == source)).agg(F.min("version")).first()[0]
        version = self.version()
        folders = self._folders(version)
        touched = [r[0] for r in keys.select(bucket_of(F.col(self.key), self.buckets).alias("b")).distinct().collect()]  # at most ``buckets``
        if touched:
            folder = self._stage(change(self._read({b: folders[b] for b in touched})))
            folders |= dict.fromkeys(touched, folder)
        self._publish(version + 1, folders, batch, source)
        return version + 1

    def sink(self, change: Callable[[DataFrame, DataFrame], DataFrame], source: str) -> Callable[[DataFrame, int], None]:
        """A function for ``foreachBatch``: ``change`` takes the touched rows and the micro-batch."""

        def each(batch: DataFrame, number: int) -> None:
            self.apply(batch, lambda rows: change(rows, batch), number, source)

        return each
