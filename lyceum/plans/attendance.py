"""Attendance facts, summaries and the attendance page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyceum.functions import calendar
from lyceum.functions.numeric import count_where, half_up, percent
from lyceum.functions.status import attended, excused
from lyceum.operators import profile, ranking
from lyceum.operators.gpa import PERIOD

KEYS = ["student_key", "course_key", "attendance_date"]
WEEKDAYS = {1: "Monday", 2: "Tuesday", 3: "Wednesday", 4: "Thursday", 5: "Friday"}


def derive(raw: DataFrame) -> DataFrame:
    """Flags, defaults, date key and academic period of raw attendance rows.

    The period is computed from the date; a join with the date dimension would give the same
    labels at the price of a join.
    """
    day = F.col("attendance_date")
    return raw.withColumns(
        {
            "is_present": attended(F.col("status")),
            "is_excused": excused(F.col("status")),
            "minutes_late": F.coalesce(F.col("minutes_late"), F.lit(0)),
            "source_system": F.coalesce(F.col("source_system"), F.lit("UNKNOWN")),
            "date_key": calendar.date_key(day),
            "academic_year": calendar.academic_year(day),
            "semester": calendar.semester(day),
            "month_name": F.date_format(day, "MMMM"),
        }
    )


def one_per_day(raw: DataFrame) -> DataFrame:
    """Last record of each student, course and day."""
    return ranking.latest_per_key(raw, KEYS, [F.col("event_time").desc(), F.col("event_id").desc()])


def student_course_pct(attendance: DataFrame) -> DataFrame:
    """Attendance percentage per student, course and semester."""
    return attendance.groupBy("student_key", "course_key", *PERIOD).agg(
        percent(count_where(F.col("is_present")), F.count(F.lit(1))).alias("actual_pct")
    )


def summary(attendance: DataFrame, departments: DataFrame) -> DataFrame:
    """Counts, rates and distinct students and courses per department and month."""
    keys = ["department_key", *PERIOD, "month_name"]
    status = F.col("status")
    counts = profile.member_counts(
        attendance,
        keys,
        ["student_key", "course_key"],
        {
            "total_records": F.count(F.lit(1)),
            "present_count": count_where(F.col("is_present")),
            "absent_count": count_where(status == "ABSENT"),
            "late_count": count_where(status == "LATE"),
            "excused_count": count_where(F.col("is_excused")),
            "minutes": F.sum("minutes_late").cast("bigint"),
        },
    )
    names = ["total_records", "present_count", "absent_count", "late_count", "excused_count", "minutes"]
    rows = counts.groupBy(*keys).agg(
        *(profile.sum_from("course_key", n).alias(n) for n in names),
        profile.count_members("student_key").alias("unique_students"),
        profile.count_members("course_key").alias("unique_courses"),
    )
    return rows.join(departments.select("department_key", "department_name"), "department_key").select(
        "department_name", *PERIOD, "month_name", "total_records", "present_count", "absent_count", "late_count",
        "excused_count",
        percent(F.col("present_count"), F.col("total_records")).alias("attendance_rate_pct"),
        half_up(F.col("minutes"), F.col("total_records"), 1).alias("avg_minutes_late"),
        "unique_students", "unique_courses",
    )


def _counts() -> list[Column]:
    status = F.col("status")
    return [
        F.count(F.lit(1)).alias("total_records"),
        count_where(attended(status)).alias("present_count"),
        count_where(status == "ABSENT").alias("absent_count"),
        count_where(status == "EXCUSED").alias("excused_count"),
        half_up(count_where(attended(status)) * 100, F.greatest(F.count(F.lit(1)), F.lit(1)), 1).alias(
            "attendance_rate"
        ),
    ]


def kpis(attendance: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals and attendance rate, over everything or per ``by``."""
    return attendance.groupBy(*by).agg(*_counts()) if by else attendance.agg(*_counts())


def in_department(attendance: DataFrame, students: DataFrame, department_key: int) -> DataFrame:
    """Attendance of one department's students."""
    chosen = students.filter(F.col("department_key") == department_key).select("student_key")
    return attendance.join(chosen, "student_key", "left_semi")


def by_status(attendance: DataFrame) -> DataFrame:
    return attendance.groupBy("status").agg(F.count(F.lit(1)).alias("count"))


def daily(attendance: DataFrame) -> DataFrame:
    return attendance.groupBy("attendance_date", "status").agg(F.count(F.lit(1)).alias("count"))


def by_weekday(attendance: DataFrame) -> DataFrame:
    """Attendance rate Monday to Friday, in that order."""
    day = calendar.iso_weekday(F.col("attendance_date"))
    return (
        attendance.withColumn("day_of_week", day)
        .filter(F.col("day_of_week") <= 5)
        .groupBy("day_of_week")
        .agg(percent(count_where(attended(F.col("status"))), F.count(F.lit(1)), 2).alias("attendance_rate"))
        .withColumn("weekday", F.element_at(F.array(*(F.lit(n) for n in WEEKDAYS.values())), F.col("day_of_week")))
        .orderBy("day_of_week")
    )


def most_absent_courses(attendance: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` courses with most absences; ties by course key."""
    counts = attendance.filter(F.col("status") == "ABSENT").groupBy("course_key").agg(
        F.count(F.lit(1)).alias("absence_count")
    )
    return ranking.top_n(counts, n, F.col("absence_count").desc(), F.col("course_key"))


def course_absence(attendance: DataFrame) -> DataFrame:
    """Events, absences, absence rate and distinct students of each course."""
    per_student = attendance.groupBy("course_key", "student_key").agg(
        F.count(F.lit(1)).alias("n"), count_where(F.col("status") == "ABSENT").alias("absent")
    )
    return per_student.groupBy("course_key").agg(
        F.sum("n").alias("total_events"),
        F.sum("absent").alias("absences"),
        percent(F.sum("absent"), F.sum("n")).alias("absence_rate"),
        F.count("student_key").alias("unique_students"),
    )


