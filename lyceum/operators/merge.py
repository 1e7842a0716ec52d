"""Upserts and slowly changing dimensions over plain tables.

Every function returns the new state of the target.  Write it to a new place (or let
``sinks.replace_table`` do so) and never over the files it reads.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: open end of a dimension version.
OPEN_END = date(9999, 12, 31)
VALIDITY = ("effective_date", "expiry_date", "is_current")


def scd2(target: DataFrame, source: DataFrame, key: str, as_of: date, hash_column: str = "row_hash") -> DataFrame:
    """New state of a type-2 dimension.

    Current rows and incoming rows meet in one full outer join on the natural key; each pair
    emits the rows it leaves behind: the untouched row, or the closed row and its successor.
    History passes by.  ``source`` has one row per key and no validity columns.
    """
    current, history = target.filter("is_current"), target.filter(~F.col("is_current"))
    columns = target.columns
    old = current.select(F.struct(*columns).alias("old"), F.col(key).alias("_old_key"), F.col(hash_column).alias("_old_hash"))
    incoming = source.withColumns(
        {
            "effective_date": F.lit(as_of),
            "expiry_date": F.lit(OPEN_END),
            "is_current": F.lit(True),
        }
    ).select(*columns)
    new = incoming.select(F.struct(*columns).alias("new"), F.col(key).alias("_new_key"), F.col(hash_column).alias("_new_hash"))
    pairs = old.join(new, F.col("_old_key") == F.col("_new_key"), "full")
    # A NULL hash on either side means "cannot tell", which leaves a row open.
    changed = F.coalesce(F.col("_old_hash") != F.col("_new_hash"), F.lit(False))
    same = F.coalesce(F.col("_old_hash") == F.col("_new_hash"), F.lit(False))
    closed = F.col("old").withField("expiry_date", F.lit(as_of)).withField("is_current", F.lit(False))
    rows = F.array_compact(
        F.array(
            F.when(F.col("_old_key").isNotNull(), F.when(changed, closed).otherwise(F.col("old"))),
            F.when(F.col("_new_key").isNotNull() & ~same, F.col("new")),
        )
    )
    return pairs.select(F.inline(rows)).unionByName(history)


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    *,
    update: Sequence[str],
    changed: tuple[str, ...],
    insert: bool = True,
) -> DataFrame:
    """Rows of ``source`` replace or join those of ``target``.

    A matched row takes the ``update`` columns from the source when any ``changed`` column
    differs (a NULL on either side does not count as different); its other columns stay.
    Unmatched source rows are inserted, or left out without ``insert``: a small ``source`` can then be broadcast.
    Both sides have one row per key.
    """
    columns = target.columns
    left = target.select(F.struct(*columns).alias("t"), *(F.col(k).alias(f"_t_{k}") for k in keys))
    right = source.select(F.struct(*columns).alias("s"), *(F.col(k).alias(f"_s_{k}") for k in keys))
    match = _same_keys(keys)
    joined = left.join(right, match, "full" if insert else "left")
    is_new = F.col("t").isNull()
    differs = F.lit(False)
    for name in changed:
        differs = differs | F.coalesce(F.col(f"t.{name}") != F.col(f"s.{name}"), F.lit(False))
    differs = F.col("s").isNotNull() & differs

    def column(name: str) -> Column:
        take = (is_new | differs) if name in update else is_new
        return F.when(take, F.col(f"s.{name}")).otherwise(F.col(f"t.{name}")).alias(name)

    return joined.select(*(column(c) for c in columns))


def _same_keys(keys: Sequence[str]) -> Column:
    match = F.lit(True)
    for i, k in enumerate(keys):
        test = F.col(f"_t_{k}") == F.col(f"_s_{k}")
        match = test if i == 0 else match & test
    return match


def insert_new(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target plus the source rows whose key it lacks; existing rows never change."""
    return target.unionByName(only_new(target, source, keys).select(*target.columns))


def only_new(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows whose key is not in the target: all that an append-only load has to write."""
    return source.join(target.select(*keys), list(keys), "left_anti")


def update_from(
    target: DataFrame, values: DataFrame, keys: Sequence[str], assign: Mapping[str, str]
) -> DataFrame:
    """Set target columns from matching rows of ``values`` (one per key); other rows keep theirs."""
    side = values.select(*keys, *(F.col(src).alias(f"_new_{dst}") for dst, src in assign.items()))
    joined = target.join(side, list(keys), "left")
    return joined.withColumns(
        {dst: F.coalesce(F.col(f"_new_{dst}"), F.col(dst)) for dst in assign}
    ).select(*target.columns)
