"""Ranks over large groups, and latest-row and top-n selections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rank:
    """``kind`` is ``rank`` or ``dense_rank`` (best value first) or ``percent_rank`` (worst value first)."""

    kind: str
    within: tuple[str, ...]


def value_ranks(
    rows: DataFrame, value: str, ranks: Mapping[str, Rank], *, best: str = "high"
) -> DataFrame:
    """Table of (group, value) with the requested ranks, without sorting the rows themselves.

    A rank window over the rows would sort every student of a semester in one task.  GPAs and
    other rounded measures repeat a few thousand values, so the rows are first counted per
    value (partial counts on the map side), and the windows run over those counts.
    """
    groups = list(dict.fromkeys(g for r in ranks.values() for g in r.within))
    counts = rows.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"))
    order = F.col(value).desc_nulls_last() if best == "high" else F.col(value).asc_nulls_last()

    def column(rank: Rank) -> Column:
        by_value = Window.partitionBy(*rank.within).orderBy(order)
        if rank.kind == "dense_rank":
            return F.dense_rank().over(by_value)
        reached = F.sum("_n").over(by_value)
        if rank.kind == "percent_rank":
            # Same partitioning and order as the other ranks, so Spark sorts once for all of them.
            whole = by_value.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            everyone = F.sum("_n").over(whole)
            below = (everyone - reached).cast("double")
            return F.when(everyone > 1, below / (everyone - 1)).otherwise(F.lit(0.0))
        if list(rank.within) == groups:
            peers = F.col("_n")
        else:
            peers = F.sum("_n").over(Window.partitionBy(*rank.within, value))
        return (reached - peers + 1).cast("int")

    return counts.select(*groups, value, *(column(r).alias(name) for name, r in ranks.items()))


def add_ranks(rows: DataFrame, value: str, ranks: Mapping[str, Rank], *, best: str = "high") -> DataFrame:
    """Rows with their ranks.

    The rank table is joined back on group and value.  Spark broadcasts it when its measured
    size allows; otherwise AQE splits a hot (group, value) on the row side.
    """
    table = value_ranks(rows, value, ranks, best=best)
    return attach(rows, table, value, list(ranks))


def attach(rows: DataFrame, rank_table: DataFrame, value: str, names: Sequence[str]) -> DataFrame:
    """Join a (possibly filtered) rank table back to the rows it was counted from."""
    keys = [c for c in rank_table.columns if c not in names]
    side = rank_table.select(*(F.col(k).alias(f"_{k}") for k in keys), *names)
    match = None
    for key in keys:
        test = rows[key].eqNullSafe(side[f"_{key}"]) if key == value else rows[key] == side[f"_{key}"]
        match = test if match is None else match & test
    return rows.join(side, match).drop(*(f"_{k}" for k in keys))


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``.

    ``row_number() = 1`` is recognised by Spark, which keeps one row per key in every map task
    before the shuffle, so a key that holds a large share of the rows stays cheap.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")


def top_n(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """Global top n: each task keeps n rows, only those reach the final merge."""
    return rows.orderBy(*order).limit(n)


def page(rows: DataFrame, limit: int, offset: int, *order: Column) -> DataFrame:
    """One page of an ordered listing; ``limit`` must lie in 1..200."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be 1..200 and offset >= 0")
    return rows.orderBy(*order).offset(offset).limit(limit)
