"""The named views analysts query with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyceum.plans import attendance, risk
from lyceum.sources.sinks import publish_view

# Names of the published views.
ATTENDANCE_SUMMARY = "v_attendance_summary"
AT_RISK_STUDENTS = "v_at_risk_students"
PROBATION_CANDIDATES = "v_probation_candidates"
SCHOLARSHIP_AT_RISK = "v_scholarship_at_risk"


def publish(
    semesters: DataFrame, attendance_facts: DataFrame, students: DataFrame, departments: DataFrame, dates: DataFrame
) -> list[str]:
    """Register the four views over warehouse tables; they are evaluated when queried.

    Attendance facts carry a date key only, so the period comes from the date dimension, whose size
    is one row per day.
    """
    period = dates.select("date_key", "academic_year", "semester", "month_name")
    dated = attendance_facts.join(period, "date_key")
    who = (semesters, students, departments)
    views = {
        ATTENDANCE_SUMMARY: attendance.summary(dated, departments),
        AT_RISK_STUDENTS: risk.scoring(*who),
        PROBATION_CANDIDATES: risk.probation(*who).orderBy(F.col("semester_gpa")),
        SCHOLARSHIP_AT_RISK: risk.scholarship_at_risk(*who).orderBy(F.col("semester_gpa")),
    }
    for name, rows in views.items():
        publish_view(rows, name)
    return list(views)
