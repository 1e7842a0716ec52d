"""Writers: files, tables, staging loads, quarantine, audit rows and physical layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lyceum.sources.staging import stage

# Rows per JDBC insert batch, and the staging tables that are appended to.
JDBC_BATCH_ROWS = 5000
APPENDED_ENTITIES = ("attendance",)


def counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """The same rows with a counter that is read after the write, so no second job counts them."""
    seen = Observation("rows")
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def write_csv(df: DataFrame, path: str) -> int:
    rows, seen = counted(df)
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return seen.get["rows"]


def write_table(
    df: DataFrame, target: str, *, fmt: str = "parquet", mode: str = "overwrite",
    partition_by: Sequence[str] = (), as_table: bool = False,
) -> int:
    """Write a path or catalog table and return the number of rows."""
    rows, seen = counted(df)
    writer = rows.write.format(fmt).mode(mode).partitionBy(*partition_by)
    if as_table:
        writer.saveAsTable(target)
    else:
        writer.save(target)
    return seen.get["rows"]


def replace_table(df: DataFrame, path: str, *, partition_by: Sequence[str] = ()) -> int:
    """Overwrite a table with a result that was computed from it.

    The result is written aside first: the new state exists in full before the old one is
    touched, and no plan reads the files it overwrites.
    """
    kept = stage(df, "replace")
    rows, seen = counted(kept)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*partition_by).parquet(path)
    return seen.get["rows"]


def overwrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace only the partitions that ``df`` has rows for.

    A dynamic overwrite writes all new files aside and moves them at its commit, so ``df`` may read the partitions it replaces.
    """
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def write_clustered(
    df: DataFrame, path: str, *, partition_by: Sequence[str], cluster_by: Sequence[str], files: int | None = None
) -> None:
    """Partitioned table whose files are range-split and sorted, so min/max statistics skip row groups.

    Range-splitting on partition and cluster columns together spreads a large partition over
    many tasks and still writes few files per partition.
    """
    keys = [*partition_by, *cluster_by]
    ranged = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode("overwrite").partitionBy(*partition_by).parquet(path)


#: Bits of each key in an interleaved order: 2 ** bits - 1 bounds per key come to the driver.
ORDER_BITS = 8


def _quantile(key: str, bounds: Sequence | None, bits: int) -> Column:
    """Number of ``bounds`` that are not above the key, by halving; 0 for a null key."""
    if not bounds:
        return F.lit(0).cast("long")
    limits = F.array(*map(F.lit, bounds))
    halves = F.array(*(F.lit(1 << k) for k in reversed(range(bits))))
    return F.aggregate(
        halves, F.lit(0), lambda at, step: F.when(F.get(limits, at + step - 1) <= F.col(key), at + step).otherwise(at)
    ).cast("long")


def write_interleaved(
    df: DataFrame, path: str, *, keys: Sequence[str], files: int | None = None, bits: int = ORDER_BITS
) -> None:
    """Table whose files are narrow on each of several number, date or time keys, so that a filter on any of them skips files.

    Rows are ordered by the bits of their keys' quantiles, taken in turns; a hash of the row after that splits rows that are equal on all
    keys over several files.  ``df`` is read twice: once for the quantiles, which are sketches merged by aggregation.
    """
    if bits * len(keys) > 62:
        raise ValueError("the interleaved bits must fit one long")
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    bounds = df.agg(*(F.percentile_approx(k, shares).alias(str(i)) for i, k in enumerate(keys))).first()
    free = "_" * (1 + max(map(len, df.columns)))  # longer than any column, so no name clashes
    places = {f"{free}{i}": _quantile(k, bounds[i], bits) for i, k in enumerate(keys)}
    order = F.lit(0).cast("long")
    for bit in range(bits):
        for i in range(len(keys)):
            order = order.bitwiseOR(F.shiftleft(F.shiftright(f"{free}{i}", bit).bitwiseAND(F.lit(1)), bit * len(keys) + i))
    placed = df.withColumns(places).withColumn(f"{free}order", order).withColumn(f"{free}split", F.xxhash64(*df.columns))
    by = [f"{free}order", f"{free}split"]
    ranged = placed.repartitionByRange(files, *by) if files else placed.repartitionByRange(*by)
    ranged.sortWithinPartitions(*by).select(*df.columns).write.mode("overwrite").parquet(path)


def write_bucketed(
    df: DataFrame, name: str, *, by: str, buckets: int, path: str | None = None, partition_by: Sequence[str] = ()
) -> None:
    """Catalog table bucketed and sorted by a join key.

    Facts and the student dimension bucketed alike by ``student_key`` join, aggregate and window per
    student without a shuffle.
    """
    writer = df.repartition(buckets, by).write.mode("overwrite").format("parquet")
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    writer = writer.option("path", path) if path else writer
    writer.bucketBy(buckets, by).sortBy(by).saveAsTable(name)


def append_rows(df: DataFrame, path: str) -> int:
    return write_table(df, path, mode="append")


def staged_rows(df: DataFrame, source_file: str) -> DataFrame:
    """Landing metadata of a staging table."""
    return df.withColumns(
        {
            "source_file": F.lit(source_file),
            "is_valid": F.lit(True),
            "validation_errors": F.lit(None).cast("string"),
            "load_timestamp": F.current_timestamp(),
        }
    )


def load_staging(df: DataFrame, folder: str, entity: str, source_file: str) -> int:
    """Replace a staging table, or append for the entities that accumulate."""
    mode = "append" if entity in APPENDED_ENTITIES else "overwrite"
    return write_table(staged_rows(df, source_file), f"{folder}/stg_{entity}", mode=mode)


def load_rejected(df: DataFrame, folder: str, entity: str) -> int:
    """Append quarantined rows; nothing is written for an empty input."""
    if df.isEmpty():
        return 0
    return write_table(df.withColumn("entity_type", F.lit(entity)), f"{folder}/stg_rejected_{entity}", mode="append")


def load_jdbc(df: DataFrame, url: str, table: str, *, truncate: bool = False, **properties: str) -> int:
    """Bulk load into a database table in batches, optionally emptying it first."""
    rows, seen = counted(df)
    (
        rows.write.format("jdbc")
        .option("url", url)
        .option("dbtable", table)
        .option("batchsize", JDBC_BATCH_ROWS)
        .option("truncate", str(truncate).lower())
        .options(**properties)
        .mode("overwrite" if truncate else "append")
        .save()
    )
    return seen.get["rows"]


def run_record(
    spark: SparkSession, run_id: str, pipeline: str, status: str, started: str, finished: str,
    *, extracted: int, loaded: int, rejected: int,
) -> DataFrame:
    """One run-log row; the duration is derived from the two timestamps."""
    start, end = F.to_timestamp(F.lit(started)), F.to_timestamp(F.lit(finished))
    return spark.range(1).select(
        F.lit(run_id).alias("run_id"),
        F.lit(pipeline).alias("pipeline"),
        F.lit(status).alias("status"),
        start.alias("started_at"),
        end.alias("finished_at"),
        F.timestamp_diff("SECOND", start, end).alias("duration_secs"),
        F.lit(extracted).cast("bigint").alias("rows_extracted"),
        F.lit(loaded).cast("bigint").alias("rows_loaded"),
        F.lit(rejected).cast("bigint").alias("rows_rejected"),
    )


def publish_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df
