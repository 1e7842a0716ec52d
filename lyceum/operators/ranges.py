"""Ranks and pages of rows in a total order, without sorting them in one task.

Rows are dealt to ranges of the order, each sorted on its own.  One row per range says how many rows it has, so a rank is a place
within a range plus the rows of all ranges before it, and a page is found by opening the one or two ranges it lies in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lyceum.sources.staging import stage

DIRECTORY = "_directory"


def value_ranks_by_range(df: DataFrame, value: str, group: Sequence[str] = (), *, ranges: int | None = None) -> DataFrame:
    """``group, value, n, rank, dense_rank``: ranks of a column of any number of distinct values, highest first, NULL last.

    First pass: equal values are counted (combined before the shuffle, so a hot value is one row) and dealt to ranges.  Second
    pass: the counts of the ranges before are added.  A window holds one range of one group, or one row per range.
    """
    keys = list(group)
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    order = [*(F.col(k).asc() for k in keys), F.col(value).desc_nulls_last()]
    dealt = counted.repartitionByRange(ranges, *order) if ranges else counted.repartitionByRange(*order)
    rows = stage(dealt.withColumn("_range", F.spark_partition_id()), "value-ranges")
    inside = Window.partitionBy("_range", *keys).orderBy(F.col(value).desc_nulls_last())
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys, *([] if keys else [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    starts = rows.groupBy(*keys, "_range").agg(F.sum("n").alias("_rows"), F.count(F.lit(1)).alias("_values")).select(
        *(F.col(k).alias(f"_{k}") for k in keys), F.col("_range").alias("_at"),
        F.coalesce(F.sum("_rows").over(earlier), none).alias("_rows_before"), F.coalesce(F.sum("_values").over(earlier), none).alias("_values_before"),
    )
    same = [F.col("_range") == F.col("_at"), *(F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)]
    placed = rows.withColumns({"_here": F.coalesce(F.sum("n").over(before), none), "_nth": F.row_number().over(inside)})
    return placed.join(starts, same).select(
        *keys, value, "n", (F.col("_rows_before") + F.col("_here") + 1).alias("rank"), (F.col("_values_before") + F.col("_nth")).alias("dense_rank")
    )


def with_ranks(df: DataFrame, value: str, group: Sequence[str] = (), *, ranges: int | None = None) -> DataFrame:
    """``df`` with ``rank`` and ``dense_rank`` of ``value`` within ``group``."""
    ranks = value_ranks_by_range(df, value, group, ranges=ranges)
    names = [*group, value]
    renamed = ranks.select(*(F.col(c).alias(f"_r_{c}") for c in names), "rank", "dense_rank")
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in names]
    return df.join(renamed, same).drop(*(f"_r_{c}" for c in names))


def write_pages(df: DataFrame, path: str, order: Sequence[Column], *, ranges: int | None = None) -> None:
    """A table in ranges of ``order`` (which must end in a unique column), and its directory: one row per range."""
    dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    numbered = dealt.withColumn("range", F.spark_partition_id())
    numbered.sortWithinPartitions("range", *order).write.mode("overwrite").partitionBy("range").parquet(f"{path}/rows")
    written = df.sparkSession.read.parquet(f"{path}/rows")
    written.groupBy("range").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/{DIRECTORY}")


def page_ranges(spark: SparkSession, path: str, offset: int, limit: int) -> tuple[list[int], int]:
    """The ranges that hold a page, and how many of their rows come before it."""
    start, skip, chosen = 0, 0, []
    for row in sorted(spark.read.parquet(f"{path}/{DIRECTORY}").collect(), key=lambda r: r.range):  # one row per range
        if start < offset + limit and start + row.n > offset:
            skip = skip if chosen else max(offset - start, 0)
            chosen.append(row.range)
        start += row.n
    return chosen, skip


def read_page(spark: SparkSession, path: str, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """``limit`` rows from ``offset`` on.  Only the ranges that hold them are opened, however deep the page is."""
    chosen, skip = page_ranges(spark, path, offset, limit)
    rows = spark.read.parquet(f"{path}/rows")
    return rows.filter(F.col("range").isin(chosen)).drop("range").orderBy(*order).offset(skip).limit(limit)


def total_rows(spark: SparkSession, path: str) -> int:
    """Number of rows of all pages, from the directory."""
    return spark.read.parquet(f"{path}/{DIRECTORY}").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
