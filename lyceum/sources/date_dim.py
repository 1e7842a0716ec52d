"""The conformed date dimension."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyceum.functions import calendar

# Range of the dimension.
FIRST_DAY = date(2010, 1, 1)
LAST_DAY = date(2035, 12, 31)


def date_dim(spark: SparkSession, first: date = FIRST_DAY, last: date = LAST_DAY) -> DataFrame:
    """One row per day.  No holiday calendar is known, so ``is_holiday`` is false throughout."""
    day = F.col("full_date")
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("interval 1 day"))).alias("full_date")
    )
    return days.select(
        calendar.date_key(day).alias("date_key"),
        day,
        calendar.iso_weekday(day).cast("int").alias("day_of_week"),
        F.date_format(day, "EEEE").alias("day_name"),
        F.dayofyear(day).alias("day_of_year"),
        F.weekofyear(day).alias("week_of_year"),
        F.month(day).alias("month"),
        F.date_format(day, "MMMM").alias("month_name"),
        F.quarter(day).alias("quarter"),
        F.year(day).alias("year"),
        calendar.academic_year(day).alias("academic_year"),
        calendar.semester(day).alias("semester"),
        (F.weekday(day) < 5).alias("is_weekday"),
        F.lit(False).alias("is_holiday"),
    )
