"""Risk models, probation, scholarships and drop-out signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lyceum.functions import bands
from lyceum.functions.grades import PROBATION_GPA
from lyceum.functions.numeric import half_up, percent, reround, scaled
from lyceum.operators import ranking
from lyceum.operators.gpa import PERIOD
from lyceum.plans.students import named

# Score tables of the five-part model.
GPA_POINTS = [(1.0, 30), (1.5, 25), (2.0, 20), (2.5, 12), (3.0, 5)]
ATTENDANCE_POINTS = [(50, 25), (60, 20), (70, 15), (75, 10), (85, 3)]
TREND_POINTS = [(-1.0, 20), (-0.5, 12), (-0.25, 6)]
CREDIT_POINTS = [(0.5, 15), (0.7, 8), (0.85, 3)]
REPEAT_POINTS = [(3, 10), (2, 6), (1, 2)]
TIERS = [(65, "CRITICAL"), (45, "HIGH"), (25, "MEDIUM")]
WARNING_TIERS = [(70, "CRITICAL"), (50, "HIGH"), (30, "MEDIUM")]
REASONS = {
    "gpa": "Low GPA",
    "attendance": "Poor Attendance",
    "trend": "Declining GPA Trend",
    "credit": "Low Credit Completion",
    "repeat": "Repeated Academic Issues",
    "other": "Combined Risk Factors",
}
ACTIONS = {
    "gpa and attendance": "Urgent: Academic + Attendance Intervention Required",
    "gpa": "Schedule Academic Counseling & Tutoring Support",
    "attendance": "Contact Student – Attendance Policy Warning",
    "trend": "Monitor Closely – Schedule Check-in with Advisor",
    "repeat": "Academic Probation Review – Dean Notification",
    "other": "Advisor Outreach Recommended",
}
SCHOLARSHIP_GPA = 3.0
LOW_ATTENDANCE = 75
DROPOUT_FLAG = "Potential Dropout – No Recent Enrollment"
SCHOLARSHIP_LOST = "Scholarship at risk — GPA below 3.0 minimum"
SCHOLARSHIP_KEPT = "Scholarship maintained"


def _time() -> WindowSpec:
    return Window.partitionBy("student_key").orderBy(*PERIOD)


def _so_far() -> WindowSpec:
    return _time().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _last_three() -> WindowSpec:
    return _time().rowsBetween(-2, Window.currentRow)


def _three_term_mean(column: str, digits: int) -> Column:
    """Exact mean over this and the two previous semesters."""
    total = F.sum(scaled(F.col(column), digits)).over(_last_three())
    return total / (F.count(column).over(_last_three()) * F.lit(10**digits))


def _three_term_shown(column: str, digits: int) -> Column:
    """The same mean, rounded to two digits."""
    total = F.sum(scaled(F.col(column), digits)).over(_last_three())
    return half_up(total, F.count(column).over(_last_three()) * F.lit(10**digits), 2)


def history(semesters: DataFrame) -> DataFrame:
    """Each semester with its look-backs: one shuffle on the student, one sort, bounded partitions.

    Look-backs that a caller does not select are pruned from the window.
    """
    return semesters.withColumns(
        {
            "prev_gpa": F.lag("semester_gpa", 1).over(_time()),
            "prev_gpa_2sem": F.lag("semester_gpa", 2).over(_time()),
            "prev_attendance": F.lag("avg_attendance_pct", 1).over(_time()),
            "gpa_mean3": _three_term_mean("semester_gpa", 3),
            "gpa_mean3_shown": _three_term_shown("semester_gpa", 3),
            "attendance_mean3_shown": _three_term_shown("avg_attendance_pct", 2),
            "low_gpa_semester_count": F.count_if(F.col("semester_gpa") < PROBATION_GPA).over(_so_far()),
            "low_attendance_semester_count": F.count_if(F.col("avg_attendance_pct") < LOW_ATTENDANCE).over(_so_far()),
            "semester_sequence": F.row_number().over(_time()),
        }
    )


def look_backs(semesters: DataFrame) -> DataFrame:
    """What the models know of a student's past at each semester, without a score."""
    return history(semesters).select(
        "student_key", "department_key", *PERIOD, "semester_gpa", "cumulative_gpa", "avg_attendance_pct",
        F.col("prev_gpa").alias("prev_gpa_1sem"), "prev_gpa_2sem", F.col("prev_attendance").alias("prev_attendance_1sem"),
        F.col("gpa_mean3_shown").alias("rolling_3sem_gpa"), F.col("attendance_mean3_shown").alias("rolling_3sem_attendance"),
        "low_gpa_semester_count", "low_attendance_semester_count", "semester_sequence",
    )


def early_warning(semesters: DataFrame, students: DataFrame, departments: DataFrame, floor: int = 30) -> DataFrame:
    """Additive model: low GPA, low attendance, a fall against the three-semester mean, missing credits."""
    gpa, att = F.col("semester_gpa"), F.col("avg_attendance_pct")
    earned, tried = F.col("credit_hours_earned"), F.col("credit_hours_attempted")
    signals = [
        (gpa < 2.0, 40),
        (gpa < 2.5, 20),
        (att < 60, 30),
        (att < LOW_ATTENDANCE, 15),
        (gpa < F.col("gpa_mean3") - 0.5, 15),
        (earned < tried * 0.75, 10),
    ]
    points = sum((F.when(test, F.lit(weight)).otherwise(F.lit(0)) for test, weight in signals), start=F.lit(0))
    scored = (
        semesters.withColumn("gpa_mean3", _three_term_mean("semester_gpa", 3))
        .withColumn("risk_score", F.least(F.lit(100), points))
        .filter(F.col("risk_score") >= floor)
    )
    return named(scored, students, departments, ["program"]).select(
        "student_id", "student_name", "department_name", "program", *PERIOD,
        reround(gpa, 3, 2).alias("semester_gpa"),
        reround(F.col("cumulative_gpa"), 3, 2).alias("cumulative_gpa"),
        reround(att, 2, 1).alias("attendance_pct"),
        "risk_score",
        bands.at_least(F.col("risk_score"), WARNING_TIERS, "LOW").alias("risk_level"),
    )


def scoring(semesters: DataFrame, students: DataFrame, departments: DataFrame, floor: int = 25) -> DataFrame:
    """Five-part model with tier, main reason and recommended action.

    Scores need only the semester rows, so rows under ``floor`` are dropped before names are joined.
    """
    earned, tried = F.col("credit_hours_earned"), F.col("credit_hours_attempted")
    parts = {
        "gpa_risk_score": bands.below(F.col("semester_gpa"), GPA_POINTS, 0),
        "attendance_risk_score": bands.below(F.col("avg_attendance_pct"), ATTENDANCE_POINTS, 0),
        "gpa_trend_risk_score": bands.below(F.col("semester_gpa") - F.col("prev_gpa"), TREND_POINTS, 0),
        "credit_completion_risk_score": bands.below(F.try_divide(earned, tried), CREDIT_POINTS, 0),
        "repeat_risk_score": bands.at_least(F.col("low_gpa_semester_count"), REPEAT_POINTS, 0),
    }
    total = sum((F.col(name) for name in parts), start=F.lit(0))
    scored = (
        history(semesters)
        .withColumns(parts)
        .withColumn("total_risk_score", F.least(F.lit(100), total))
        .filter(F.col("total_risk_score") >= floor)
    )
    bad_gpa = F.col("gpa_risk_score") >= 20
    bad_att = F.col("attendance_risk_score") >= 15
    falling = F.col("gpa_trend_risk_score") >= 12
    behind = F.col("credit_completion_risk_score") >= 8
    repeated = F.col("repeat_risk_score") >= 6
    reason = bands.first_match(
        [
            (bad_gpa, REASONS["gpa"]),
            (bad_att, REASONS["attendance"]),
            (falling, REASONS["trend"]),
            (behind, REASONS["credit"]),
            (repeated, REASONS["repeat"]),
        ],
        REASONS["other"],
    )
    action = bands.first_match(
        [
            (bad_gpa & bad_att, ACTIONS["gpa and attendance"]),
            (bad_gpa, ACTIONS["gpa"]),
            (bad_att, ACTIONS["attendance"]),
            (falling, ACTIONS["trend"]),
            (repeated, ACTIONS["repeat"]),
        ],
        ACTIONS["other"],
    )
    return named(scored, students, departments, ["program", "major", "student_type"]).select(
        "student_id", "student_name", "program", "major", "student_type", "department_name", "college", *PERIOD,
        reround(F.col("semester_gpa"), 3, 2).alias("semester_gpa"),
        reround(F.col("cumulative_gpa"), 3, 2).alias("cumulative_gpa"),
        reround(F.col("avg_attendance_pct"), 2, 1).alias("attendance_pct"),
        "credit_hours_earned", "credit_hours_attempted",
        percent(earned, tried, 1).alias("credit_completion_pct"),
        "courses_passed", "courses_taken",
        reround(F.col("prev_gpa"), 3, 2).alias("prev_semester_gpa"),
        F.col("gpa_mean3_shown").alias("rolling_3sem_avg_gpa"),
        "low_gpa_semester_count", "low_attendance_semester_count", "semester_sequence", *parts, "total_risk_score",
        bands.at_least(F.col("total_risk_score"), TIERS, "LOW").alias("risk_tier"),
        reason.alias("primary_risk_reason"),
        action.alias("recommended_action"),
    )


def probation(semesters: DataFrame, students: DataFrame, departments: DataFrame) -> DataFrame:
    """Semesters under 2.0 with the number of earlier ones and the resulting status."""
    earlier = _time().rowsBetween(Window.unboundedPreceding, -1)
    low = semesters.filter(F.col("semester_gpa") < PROBATION_GPA).withColumn(
        "prior_low_gpa_semesters", F.count(F.lit(1)).over(earlier)
    )
    status = bands.first_match(
        [(F.col("cumulative_gpa") < PROBATION_GPA, "Academic Suspension Candidate")], "Academic Probation"
    )
    return named(low.withColumn("probation_status", status), students, departments, ["program"]).select(
        "student_id", "student_name", "program", "department_name", *PERIOD,
        reround(F.col("semester_gpa"), 3, 2).alias("semester_gpa"),
        reround(F.col("cumulative_gpa"), 3, 2).alias("cumulative_gpa"),
        "credit_hours_attempted", "credit_hours_earned",
        reround(F.col("avg_attendance_pct"), 2, 1).alias("attendance_pct"),
        "prior_low_gpa_semesters", "probation_status",
    )


def scholarship_at_risk(semesters: DataFrame, students: DataFrame, departments: DataFrame) -> DataFrame:
    """Scholarship holders and whether each semester meets the 3.0 minimum."""
    holders = students.filter("scholarship")
    under = F.coalesce(F.col("semester_gpa") < SCHOLARSHIP_GPA, F.lit(False))
    return named(semesters, holders, departments, ["program", "scholarship_amount"]).select(
        "student_id", "student_name", "program", "department_name", "scholarship_amount", *PERIOD,
        reround(F.col("semester_gpa"), 3, 2).alias("semester_gpa"),
        under.alias("below_scholarship_threshold"),
        F.when(under, SCHOLARSHIP_LOST).otherwise(SCHOLARSHIP_KEPT).alias("scholarship_status"),
    )


def dropout_signal(
    semesters: DataFrame, students: DataFrame, departments: DataFrame, current_year: str
) -> DataFrame:
    """Students whose last semester lies before ``current_year``; the department is the student's own."""
    last = ranking.latest_per_key(semesters, ["student_key"], [F.col(c).desc() for c in PERIOD])
    gone = last.filter(F.col("academic_year") < current_year).drop("department_key")
    return named(gone, students, departments, ["department_key"]).select(
        "student_id", "student_name", "department_name",
        F.col("academic_year").alias("last_enrolled_year"),
        F.col("semester").alias("last_enrolled_semester"),
        reround(F.col("semester_gpa"), 3, 2).alias("last_semester_gpa"),
        F.lit(DROPOUT_FLAG).alias("flag"),
    )


def profile_label(gpa: Column, attendance: Column) -> Column:
    """Critical / At Risk / Honors / Normal."""
    return bands.first_match(
        [
            ((gpa < 2.0) | (attendance < 60), "Critical"),
            ((gpa < 2.5) | (attendance < LOW_ATTENDANCE), "At Risk"),
            (gpa >= 3.5, "Honors"),
        ],
        "Normal",
    )


def risk_profile(semesters: DataFrame, students: DataFrame) -> DataFrame:
    """Points of the GPA/attendance scatter with their label."""
    who = students.select("student_key", "student_id", "program")
    return semesters.join(who, "student_key", "left").select(
        "student_id", "program", "department_key", *PERIOD, "semester_gpa", "avg_attendance_pct",
        profile_label(F.col("semester_gpa"), F.col("avg_attendance_pct")).alias("risk"),
    )


def risk_factors(listing: DataFrame) -> DataFrame:
    """Named risk factors of each listed student, empty when there is none."""
    factors = F.array_compact(
        F.array(
            F.when(F.col("gpa") < PROBATION_GPA, F.lit("Low GPA (below 2.0)")),
            F.when(F.col("attendance_pct") < LOW_ATTENDANCE, F.lit("Low attendance (below 75%)")),
        )
    )
    return listing.select(
        "student_id", "risk_flag", F.array_join(factors, "; ").alias("risk_factors"), "gpa", "attendance_pct"
    )
