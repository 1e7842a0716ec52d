"""Written intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    A machine-local folder is used only by a local session that names none, as in tests.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL_FOLDERS[context.applicationId]


_RUN: ContextVar[str | None] = ContextVar("scratch_run", default=None)


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{_RUN.get() or shared_folder(spark) + '/lyceum'}/{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch_run(spark: SparkSession) -> Iterator[str]:
    """One folder for everything staged inside, removed at the end, also after an error.

    A result that is still to be read must be written before the run ends.  Interactive use outside a run keeps its
    staged tables: remove the ``lyceum`` folder below ``spark.checkpoint.dir`` when no session needs it.
    """
    outer = _RUN.get()
    if outer is not None:  # part of a larger run, which removes everything
        yield outer
        return
    folder = f"{shared_folder(spark)}/lyceum/run-{uuid.uuid4().hex}"
    token = _RUN.set(folder)
    try:
        yield folder
    finally:
        _RUN.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back.

    For a result that several branches read: it is computed once, a lost executor costs only
    the tasks that were running, and the read-back keeps column pruning and file sizes, so
    Spark can still choose a broadcast by size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
