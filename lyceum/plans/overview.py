"""University-wide KPIs and chart tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lyceum.functions.grades import HONORS_GPA, PROBATION_GPA, grade_position
from lyceum.functions.numeric import count_where, half_up, mean_of, percent, scaled
from lyceum.operators import ranking
from lyceum.operators.gpa import PERIOD

LOW_ATTENDANCE = 75
GPA_BINS = 40
MAX_GPA_UNITS = 4000


def kpis(semesters: DataFrame) -> DataFrame:
    """KPIs of every semester next to the number of students over all semesters.

    Each student is counted in the first semester on record, which gives the overall number in
    the same pass; the last window runs over one row per semester.
    """
    first = F.row_number().over(Window.partitionBy("student_key").orderBy(*PERIOD)) == 1
    taken = F.sum("courses_taken")
    rows = semesters.withColumn("_first", first).groupBy(*PERIOD).agg(
        count_where(F.col("_first")).alias("new_students"),
        mean_of(F.col("semester_gpa"), 3, 2).alias("avg_gpa"),
        mean_of(F.col("avg_attendance_pct"), 2, 1).alias("avg_attendance"),
        count_where(F.col("semester_gpa") < PROBATION_GPA).alias("at_risk_count"),
        count_where(F.col("semester_gpa") >= HONORS_GPA).alias("honors_count"),
        half_up(F.sum("courses_passed") * 100, F.greatest(taken, F.lit(1)), 1).alias("pass_rate"),
    )
    everyone = F.sum("new_students").over(Window.partitionBy(F.lit(1)))
    return rows.withColumn("total_students", everyone).drop("new_students")


def gpa_histogram(semesters: DataFrame, bins: int = GPA_BINS) -> DataFrame:
    """Equal-width bins over 0..4 with their bounds; 4.0 belongs to the last bin."""
    width = MAX_GPA_UNITS // bins
    bin_no = F.least(
        F.lit(bins).cast("bigint"), F.call_function("div", scaled(F.col("semester_gpa"), 3), F.lit(width)) + 1
    )
    counts = semesters.filter(F.col("semester_gpa").isNotNull()).groupBy(bin_no.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("count")
    )
    step = F.lit(float(width))
    return counts.withColumns(
        {"bin_start": (F.col("bin") - 1) * step / 1000.0, "bin_end": F.col("bin") * step / 1000.0}
    )


def grade_distribution(performance: DataFrame) -> DataFrame:
    """Enrollments per letter in ladder order."""
    counts = performance.groupBy("grade_letter").agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("position", grade_position(F.col("grade_letter"))).orderBy("position", "grade_letter")


def attendance_heatmap(semesters: DataFrame, departments: DataFrame) -> DataFrame:
    """Mean attendance of each department and semester on file."""
    cells = semesters.groupBy("department_key", "semester").agg(
        mean_of(F.col("avg_attendance_pct"), 2, 1).alias("attendance")
    )
    named = cells.join(departments.select("department_key", "department_id"), "department_key")
    return named.select("department_id", "semester", "attendance")


def heatmap_grid(cells: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """The heat map with one column per semester: those given, or all that are on file (one label per semester)."""
    pivoted = cells.groupBy("department_id").pivot("semester", list(labels) if labels is not None else None)
    return pivoted.agg(F.first("attendance"))


def risk_summary(semesters: DataFrame) -> DataFrame:
    """At-risk counts over the latest semester of every student."""
    last = ranking.latest_per_key(semesters, ["student_key"], [F.col(c).desc() for c in PERIOD])
    low_gpa = F.col("semester_gpa") < PROBATION_GPA
    low_attendance = F.col("avg_attendance_pct") < LOW_ATTENDANCE
    everyone = F.count(F.lit(1))
    return last.agg(
        everyone.alias("total_students"),
        count_where(low_gpa | low_attendance).alias("at_risk_count"),
        percent(count_where(low_gpa | low_attendance), everyone, 1).alias("at_risk_pct"),
        count_where(low_gpa).alias("low_gpa_count"),
        count_where(low_attendance).alias("low_attendance_count"),
    )


def gpa_by_semester(semesters: DataFrame) -> DataFrame:
    return semesters.groupBy(*PERIOD).agg(mean_of(F.col("semester_gpa"), 3, 2).alias("avg_gpa"))


def mean_of_means(semesters: DataFrame) -> DataFrame:
    """Unweighted means over semesters (GPA) and over departments (attendance), as the KPI tile shows them.

    One aggregate per (department, semester) feeds both, so the facts are read once.
    """
    cells = semesters.groupBy("department_key", *PERIOD).agg(
        F.sum(scaled(F.col("semester_gpa"), 3)).alias("gpa"),
        F.count("semester_gpa").alias("gpa_n"),
        F.sum(scaled(F.col("avg_attendance_pct"), 2)).alias("att"),
        F.count("avg_attendance_pct").alias("att_n"),
    )
    sides = cells.groupingSets([PERIOD, ["department_key"]], *PERIOD, "department_key").agg(
        F.grouping("department_key").alias("_by_semester"),
        half_up(F.sum("gpa"), F.sum("gpa_n") * 1000, 2).alias("gpa"),
        half_up(F.sum("att"), F.sum("att_n") * 100, 1).alias("att"),
    )
    per_semester = F.col("_by_semester") == 1
    return sides.agg(
        mean_of(F.when(per_semester, F.col("gpa")), 2, 2).alias("overall_avg_gpa"),
        mean_of(F.when(~per_semester, F.col("att")), 1, 2).alias("overall_avg_attendance_pct"),
        count_where(~per_semester).alias("departments_count"),
    )
