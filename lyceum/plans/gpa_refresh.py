"""FACT_SEMESTER_GPA after a load, from the semesters that the load touched.

A semester's GPA depends on its own facts only, a running GPA on everything before it.  So the semesters that were touched are computed
anew, later ones get a new running GPA, and earlier ones are not opened: what they add to a student's running GPA is
the student's stored total less the rows that are opened.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lyceum import schemas
from lyceum.functions.calendar import semester_order
from lyceum.functions.numeric import clamp, half_up, scaled
from lyceum.operators import gpa
from lyceum.sources.staging import stage
from lyceum.sources.warehouse import Store, partition_folders

TABLE, TOTALS = "fact_semester_gpa", "semester_gpa_totals"


def in_partitions(parts: list) -> Column:
    """Rows of the given semesters, as literals, so that a scan opens their partitions only."""
    none = F.lit(False)
    same = [F.col("academic_year").eqNullSafe(F.lit(p.academic_year or None)) & F.col("semester").eqNullSafe(F.lit(p.semester or None)) for p in parts]
    return reduce(lambda a, b: a | b, same, none)


def _units() -> Column:
    return scaled(F.col("semester_gpa"), 3) * F.col("credit_hours_attempted")


def opened_rows(store: Store, touched: list) -> DataFrame:
    """Stored rows of the touched semesters and all after the first of them; a semester of unknown order is opened too."""
    stored = store.read(TABLE, schemas.FACT_SEMESTER_GPA)
    order = semester_order(F.col("academic_year"), F.col("semester"))
    spark = stored.sparkSession
    periods = [F.struct(*(F.lit(p[c]).cast("string").alias(c) for c in gpa.PERIOD)) for p in touched]
    first = spark.range(1).select(F.inline(F.array(*periods)))
    low = first.agg(F.min(F.coalesce(order, F.lit(-1)))).first()[0]  # one row per partition
    known = stored.select(*gpa.PERIOD).distinct().filter((order >= F.lit(low)) | order.isNull()).collect()
    return stored.filter(in_partitions(known))


def refresh(store: Store, facts: DataFrame, touched: DataFrame) -> int:
    """Brings the table up to date after ``touched`` semesters (at most one row per partition) of ``facts`` have changed.

    Returns the table's number of rows.
    """
    parts = touched.select(*(F.nullif(c, F.lit("")).alias(c) for c in gpa.PERIOD)).distinct().collect()
    if parts:
        old = opened_rows(store, parts)
        fresh = gpa.semester_gpa(facts.filter(in_partitions(parts)))
        rows = fresh.unionByName(old.filter(~in_partitions(parts)).drop("cumulative_gpa"))
        rows = stage(rows.withColumns({"units": _units(), "credits": F.col("credit_hours_attempted")}), "gpa-rows")
        before = stage(old.select("student_key", *gpa.PERIOD, (-_units()).alias("units"), (-F.col("credit_hours_attempted")).alias("credits")), "gpa-before")
        totals = store.read(TOTALS, schemas.SEMESTER_GPA_TOTALS)
        sums = [F.sum(c).alias(c) for c in ("units", "credits")]
        keys = ["student_key", "units", "credits"]
        base = totals.union(before.select(*keys)).groupBy("student_key").agg(*sums)
        written = running(rows, base)
        gone = before.select(*gpa.PERIOD).distinct().join(
            rows.select(*gpa.PERIOD).distinct().withColumns({f"_{c}": F.col(c) for c in gpa.PERIOD}).drop(*gpa.PERIOD),
            reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in gpa.PERIOD]), "left_anti",
        )
        cleared = partition_folders(gone, gpa.PERIOD)
        new_totals = stage(totals.union(before.select(*keys)).union(rows.select(*keys)).groupBy("student_key").agg(*sums), "gpa-totals")
        store.overwrite(TABLE, written.select(*schemas.FACT_SEMESTER_GPA.names), gpa.PERIOD, cleared)
        store.replace(TOTALS, new_totals)
    return store.read(TABLE, schemas.FACT_SEMESTER_GPA).count()


def running(rows: DataFrame, base: DataFrame) -> DataFrame:
    """``rows`` with the running GPA that starts from ``base``; a window holds a student's opened semesters."""
    order = [semester_order(F.col("academic_year"), F.col("semester")), "academic_year", "semester", "department_key"]
    so_far = Window.partitionBy("student_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = base.select("student_key", F.col("units").alias("_u"), F.col("credits").alias("_c"))
    joined = rows.join(start, "student_key", "left")
    units = F.sum("units").over(so_far) + F.coalesce("_u", F.lit(0))
    credits = F.sum("credits").over(so_far) + F.coalesce("_c", F.lit(0))
    return joined.withColumn("cumulative_gpa", clamp(half_up(units, credits * F.lit(1000), 3), 0.0, gpa.MAX_GPA))
