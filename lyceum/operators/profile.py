"""Group profiles that need distinct counts, medians or deviations next to plain sums.

``count(distinct)`` beside a median makes Spark carry a serialised median buffer per distinct
value through the shuffle.  Here one grouping-sets pass counts per member and per value with
small fixed-width rows; both are combined on the map side, so a hot group stays cheap.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lyceum.functions.numeric import half_up


def member_counts(
    rows: DataFrame, keys: Sequence[str], members: Sequence[str], sums: Mapping[str, Column]
) -> DataFrame:
    """Rows per (keys, member) for each member column, in one scan.

    ``_member`` names the member column a row belongs to; sums are right for each member
    column on its own, so read them from one ``_member`` only.
    """
    sets = [[*keys, m] for m in members]
    which = F.coalesce(*(F.when(F.grouping(m) == 0, F.lit(m)) for m in members))
    return rows.groupingSets(sets, *keys, *members).agg(
        which.alias("_member"), *(expr.alias(name) for name, expr in sums.items())
    )


def count_members(member: str) -> Column:
    """Aggregate over ``member_counts``: number of distinct non-NULL values of a member column."""
    return F.count_if((F.col("_member") == member) & F.col(member).isNotNull())


def sum_from(member: str, name: str) -> Column:
    """Aggregate over ``member_counts``: total of a sum, read from one member column."""
    return F.sum(F.when(F.col("_member") == member, F.col(name))).cast("bigint")


def with_running_count(counts: DataFrame, keys: Sequence[str], units: str, n: str) -> DataFrame:
    """Add how many rows have a value up to this one; a group has as many rows as distinct values."""
    group = Window.partitionBy(*keys)
    known = F.when(F.col(units).isNotNull(), F.col(n)).otherwise(F.lit(0))
    return counts.withColumns(
        {
            "_upto": F.sum(known).over(group.orderBy(F.col(units).asc_nulls_last())),
            "_total": F.sum(known).over(group),
        }
    )


def lower_median(units: Column) -> Column:
    """Aggregate: smallest value that half of the rows do not exceed."""
    return F.min(F.when(F.col("_upto") * 2 >= F.col("_total"), units))


def median(units: Column, scale: int, digits: int) -> Column:
    """Aggregate: mean of the two middle values."""
    upper = F.min(F.when(F.col("_upto") * 2 > F.col("_total"), units))
    return half_up(lower_median(units) + upper, F.lit(2 * scale), digits)


def deviation(units: Column, n: Column, scale: int, digits: int) -> Column:
    """Aggregate: sample standard deviation from value counts; NULL below two rows.

    ``n * sum(x^2) - sum(x)^2`` is taken in decimals, hence exact, before the square root.
    """
    wide = "decimal(38,0)"
    rows = F.sum(F.when(units.isNotNull(), n))
    total = F.sum(units * n).cast(wide)
    squares = F.sum(units.cast("decimal(18,0)") * units * n).cast(wide)
    spread = (rows.cast("decimal(18,0)") * squares - total * total).cast("double")
    pairs = rows.cast("double") * (rows - 1).cast("double")
    return F.when(rows > 1, F.round(F.sqrt(spread / pairs) / F.lit(float(scale)), digits))
