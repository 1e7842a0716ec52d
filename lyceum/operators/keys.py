"""Dense surrogate keys without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lyceum.sources.staging import stage

_POSITION_BITS = 33


def with_surrogate_key(df: DataFrame, order: Sequence[str], name: str, start: int = 1) -> DataFrame:
    """Number the rows ``start, start + 1, ...`` in the order of unique columns ``order``.

    Rows are range-partitioned and sorted, so the position within a partition plus the sizes of
    the earlier partitions is the overall position.  The partitions are written first: ranges are
    sampled, and numbering must not change when a task runs again.  The offsets have one row per
    partition, which bounds the broadcast and the window over them.
    """
    stamped = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumns(
            {
                "_part": F.shiftright("_at", _POSITION_BITS).cast("int"),
                "_pos": F.col("_at").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)),
            }
        )
        .drop("_at")
    )
    kept = stage(stamped, "surrogate-keys")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        kept.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    numbered = kept.join(F.broadcast(offsets), "_part")
    key = (F.col("_offset") + F.col("_pos") + F.lit(start)).cast("bigint")
    return numbered.withColumn(name, key).drop("_part", "_pos", "_offset")


def next_key(existing: DataFrame, name: str) -> int:
    """First free key of a table; reads one row."""
    return (existing.agg(F.max(name)).first()[0] or 0) + 1


def append_with_keys(existing: DataFrame, new_rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Existing rows plus new rows that continue the numbering."""
    numbered = with_surrogate_key(new_rows, order, name, start=next_key(existing, name))
    return existing.unionByName(numbered.select(*existing.columns))


def lookup(
    facts: DataFrame, dimension: DataFrame, on: str, key: str, default: int | None = None
) -> DataFrame:
    """Replace a natural key by the surrogate key of a dimension.

    Without ``default`` unmatched facts are dropped (find them with ``quality.orphans``); with one
    they keep it.
    """
    side = dimension.select(on, key)
    if default is None:
        return facts.join(side, on)
    return facts.join(side, on, "left").withColumn(key, F.coalesce(F.col(key), F.lit(default).cast("bigint")))
