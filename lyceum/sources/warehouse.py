"""Where a load keeps its tables: a folder that is changed in place, or versions that are published as a whole.

A published version is one small file that names the folders of every table and partition.  A load writes new folders for what
it replaces, keeps the names of all others, and puts its version file in place at the end.  Readers resolve the highest
version, so they see a load entirely or not at all, and a load that dies leaves nothing but folders no version names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lyceum.sources import sinks


def existing(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A table of the warehouse folder, empty before its first load."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return no_rows(spark, schema)


def no_rows(spark: SparkSession, schema: StructType) -> DataFrame:
    """An empty table that the optimizer knows to be empty: joins with it need no shuffle."""
    return spark.createDataFrame([], schema).limit(0)


def partition_folders(rows: DataFrame, partition_by: Sequence[str]) -> list[str]:
    """Folder names of the partitions in ``rows`` (one row per partition), as Spark writes them."""
    named = rows.sparkSession._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    values = rows.select(*(F.col(c).cast("string") for c in partition_by)).distinct().collect()
    return sorted("/".join(named.getPartitionPathString(c, v or None) for c, v in zip(partition_by, row)) for row in values)


class Files:
    """The file system of a folder, whichever it is."""

    def __init__(self, spark: SparkSession, folder: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._system = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._jvm = spark._jvm

    def delete(self, path: str) -> None:
        self._system.delete(self._path(path), True)

    def names(self, path: str) -> list[str]:
        where = self._path(path)
        return sorted(s.getPath().getName() for s in self._system.listStatus(where)) if self._system.exists(where) else []

    def read(self, path: str) -> str:
        stream = self._system.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Puts a whole file in place; False if there is one of that name."""
        aside = f"{path}.{uuid.uuid4().hex}"
        stream = self._system.create(self._path(aside), False)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        if not self._system.exists(self._path(path)) and self._system.rename(self._path(aside), self._path(path)):
            return True
        self.delete(aside)
        return False


class InPlace:
    """Tables that are overwritten where they stand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str, schema: StructType) -> DataFrame:
        return existing(self.spark, f"{self.folder}/{name}", schema)

    def replace(self, name: str, df: DataFrame) -> int:
        return sinks.replace_table(df, f"{self.folder}/{name}")

    def overwrite(self, name: str, df: DataFrame, partition_by: Sequence[str], cleared: Sequence[str] = ()) -> None:
        """Replaces the partitions that ``df`` has rows for, and removes those in the folders ``cleared``."""
        sinks.overwrite_partitions(df, f"{self.folder}/{name}", partition_by)
        files = Files(self.spark, self.folder)
        for part in cleared:
            files.delete(f"{self.folder}/{name}/{part}")

    def publish(self) -> None:
        """Everything is in place already."""


class Snapshot:
    """Tables as of the last published version, with the changes of one load that ``publish`` makes visible."""

    def __init__(self, spark: SparkSession, folder: str, version: int | None = None):
        self.spark, self.folder = spark, folder
        self._files = Files(spark, folder)
        found = self.versions()
        self.version = (found[-1] if found else 0) if version is None else version
        text = self._files.read(self._file(self.version)) if self.version else "{}"
        self._tables: dict[str, dict[str, str]] = json.loads(text)
        self._load = f"load=v{self.version + 1:08d}-{uuid.uuid4().hex[:8]}"

    def _file(self, version: int) -> str:
        return f"{self.folder}/_versions/{version:08d}.json"

    def versions(self) -> list[int]:
        names = self._files.names(f"{self.folder}/_versions")
        return sorted(int(n[:8]) for n in names if n.endswith(".json"))

    def read(self, name: str, schema: StructType) -> DataFrame:
        folders = self._tables.get(name)
        if not folders:
            return no_rows(self.spark, schema)
        base = f"{self.folder}/{name}"
        paths = sorted(f"{base}/{load}/{part}".rstrip("/") for part, load in folders.items())
        return self.spark.read.schema(schema).option("basePath", base).parquet(*paths).select(*schema.names)

    def replace(self, name: str, df: DataFrame) -> int:
        count = sinks.write_table(df, f"{self.folder}/{name}/{self._load}")
        self._tables[name] = {"": self._load}
        return count

    def overwrite(self, name: str, df: DataFrame, partition_by: Sequence[str], cleared: Sequence[str] = ()) -> None:
        target = f"{self.folder}/{name}/{self._load}"
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(target)
        parts = [""]
        for _ in partition_by:
            parts = [f"{p}/{n}".lstrip("/") for p in parts for n in self._files.names(f"{target}/{p}".rstrip("/")) if "=" in n]
        kept = {p: load for p, load in self._tables.get(name, {}).items() if p not in cleared}
        self._tables[name] = kept | {p: self._load for p in parts}

    def publish(self) -> int:
        """Makes the load visible; fails if another load has published in the meantime."""
        if not self._files.create(self._file(self.version + 1), json.dumps(self._tables, sort_keys=True)):
            raise RuntimeError(f"version {self.version + 1} of {self.folder} was published by another load")
        self.version += 1
        return self.version


Store = InPlace | Snapshot
