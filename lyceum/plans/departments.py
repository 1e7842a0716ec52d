"""Department metrics, scorecards and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lyceum.functions import bands
from lyceum.functions.grades import HONORS_GPA, PROBATION_GPA
from lyceum.functions.numeric import count_where, half_up, mean_of, percent, reround, scaled, sum_where
from lyceum.operators import profile
from lyceum.operators.gpa import PERIOD

# Weights of the performance score (in hundredths) and the trend limit.
SCORE_WEIGHTS = {"avg_gpa": 40, "avg_attendance": 2, "pass_rate": 1, "not_on_probation": 1}
TREND_LIMIT = 0.1
LOW_ATTENDANCE = 75
LOW_GPA_ON_PAGE = 2.5

DEPT_PERIOD = ["department_key", *PERIOD]
_POINT_UNITS = 10_000


def _in_time() -> WindowSpec:
    return Window.partitionBy("department_key").orderBy(*PERIOD)


def _rank(value: str, *within: str) -> Column:
    """Rank among departments: the input has one row per department and semester."""
    return F.rank().over(Window.partitionBy(*within).orderBy(F.col(value).desc_nulls_last()))


def metrics(performance: DataFrame, departments: DataFrame) -> DataFrame:
    """Department semester metrics over all enrollments that were not withdrawn."""
    rows = performance.filter(~F.col("is_withdrawn")).withColumn("points", scaled(F.col("grade_points"), 4))
    counts = profile.member_counts(
        rows,
        DEPT_PERIOD,
        ["student_key", "points"],
        {
            "n": F.count(F.lit(1)),
            "att": F.sum(scaled(F.col("attendance_pct"), 2)),
            "att_n": F.count("attendance_pct"),
            "credits": F.sum("credit_hours").cast("bigint"),
            "earned": sum_where(F.col("is_passing"), F.col("credit_hours")),
            "passed": count_where(F.col("is_passing")),
            "failed": count_where(F.col("grade_letter") == "F"),
        },
    )
    # Fold the students of a group into one count before the window, which then sees grade values only.
    measures = ["n", "att", "att_n", "credits", "earned", "passed", "failed"]
    folded = counts.groupBy(*DEPT_PERIOD, "_member", "points").agg(
        profile.count_members("student_key").alias("students"), *(F.sum(m).alias(m) for m in measures)
    )
    points, n = F.col("points"), F.col("n")
    by_dept = (
        profile.with_running_count(folded, DEPT_PERIOD, "points", "n")
        .groupBy(*DEPT_PERIOD)
        .agg(
            F.sum("students").alias("enrolled_students"),
            half_up(
                F.sum(points * n), F.sum(F.when(points.isNotNull(), n)) * F.lit(_POINT_UNITS), 3
            ).alias("avg_gpa"),
            (profile.lower_median(points) / F.lit(float(_POINT_UNITS))).alias("median_gpa"),
            profile.deviation(points, n, _POINT_UNITS, 3).alias("gpa_stddev"),
            half_up(profile.sum_from("points", "att"), profile.sum_from("points", "att_n") * 100, 2).alias(
                "avg_attendance"
            ),
            profile.sum_from("points", "credits").alias("total_credits_attempted"),
            profile.sum_from("points", "earned").alias("total_credits_earned"),
            profile.sum_from("points", "passed").alias("courses_passed"),
            profile.sum_from("points", "n").alias("courses_taken"),
            sum_where(points >= HONORS_GPA * _POINT_UNITS, n).alias("honors_enrollments"),
            profile.sum_from("points", "failed").alias("fail_count"),
        )
    )
    return (
        by_dept.withColumns(
            {
                "pass_rate": percent(F.col("courses_passed"), F.col("courses_taken")),
                "credit_completion_rate": percent(F.col("total_credits_earned"), F.col("total_credits_attempted")),
                "fail_rate": percent(F.col("fail_count"), F.col("courses_taken")),
                "prev_avg_gpa": F.lag("avg_gpa").over(_in_time()),
                "gpa_rank": _rank("avg_gpa", *PERIOD),
            }
        )
        .withColumn("gpa_delta", F.round(F.col("avg_gpa") - F.col("prev_avg_gpa"), 3))
        .join(departments.select("department_key", "department_name", "college"), "department_key")
    )


def scorecard(semesters: DataFrame, departments: DataFrame) -> DataFrame:
    """Scorecard of every department and semester: rates, trend, score and four rankings.

    Semester rows are unique per student, so enrolled students are a plain count.
    """
    n, gpa = F.col("n"), F.col("gpa")
    values = semesters.groupBy(*DEPT_PERIOD, scaled(F.col("semester_gpa"), 3).alias("gpa")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(scaled(F.col("avg_attendance_pct"), 2)).alias("att"),
        F.count("avg_attendance_pct").alias("att_n"),
        *(
            F.sum(c).alias(c)
            for c in ("credit_hours_earned", "credit_hours_attempted", "courses_passed", "courses_taken")
        ),
    )
    base = (
        profile.with_running_count(values, DEPT_PERIOD, "gpa", "n")
        .groupBy(*DEPT_PERIOD)
        .agg(
            F.sum("n").alias("enrolled_students"),
            half_up(F.sum(gpa * n), F.sum(F.when(gpa.isNotNull(), n)) * 1000, 3).alias("avg_gpa"),
            profile.median(gpa, 1000, 3).alias("median_gpa"),
            profile.deviation(gpa, n, 1000, 3).alias("gpa_stddev"),
            half_up(F.sum("att"), F.sum("att_n") * 100, 2).alias("avg_attendance"),
            percent(F.sum("courses_passed"), F.sum("courses_taken")).alias("pass_rate"),
            percent(F.sum("credit_hours_earned"), F.sum("credit_hours_attempted")).alias("credit_completion_rate"),
            percent(sum_where(gpa >= HONORS_GPA * 1000, n), F.sum("n")).alias("honors_rate"),
            percent(sum_where(gpa < PROBATION_GPA * 1000, n), F.sum("n")).alias("probation_rate"),
        )
        .join(departments.select("department_key", "department_name", "college"), "department_key")
    )
    weights = SCORE_WEIGHTS
    score = (
        scaled(F.col("avg_gpa"), 4) * weights["avg_gpa"]
        + scaled(F.col("avg_attendance"), 4) * weights["avg_attendance"]
        + scaled(F.col("pass_rate"), 4) * weights["pass_rate"]
        + (F.lit(1_000_000) - scaled(F.col("probation_rate"), 4)) * weights["not_on_probation"]
    )
    delta = F.round(F.col("avg_gpa") - F.coalesce(F.col("prev_avg_gpa"), F.col("avg_gpa")), 3)
    trend = F.when(F.col("gpa_delta") > TREND_LIMIT, "Improving").when(
        F.col("gpa_delta") < -TREND_LIMIT, "Declining"
    )
    return (
        base.withColumns(
            {
                "prev_avg_gpa": F.lag("avg_gpa").over(_in_time()),
                "overall_rank": _rank("avg_gpa", *PERIOD),
                "attendance_rank": _rank("avg_attendance", *PERIOD),
                "pass_rate_rank": _rank("pass_rate", *PERIOD),
                "honors_rank": _rank("honors_rate", *PERIOD),
                "college_gpa_rank": _rank("avg_gpa", "college", *PERIOD),
                "performance_score": half_up(score, F.lit(1_000_000), 2),
                "avg_attendance_pct": reround(F.col("avg_attendance"), 2, 1),
            }
        )
        .withColumn("gpa_delta", delta)
        .withColumn("trend", trend.otherwise("Stable"))
        .select(
            "overall_rank", "department_name", "college", *PERIOD, "enrolled_students", "avg_gpa", "median_gpa",
            "gpa_stddev", "avg_attendance_pct", "pass_rate", "credit_completion_rate", "honors_rate",
            "probation_rate", "gpa_delta", "trend", "performance_score", "college_gpa_rank", "attendance_rank",
            "pass_rate_rank", "honors_rank",
        )
        .orderBy(F.desc("academic_year"), F.desc("semester"), "overall_rank", "department_name")
    )


def average_gpa(semesters: DataFrame, departments: DataFrame) -> DataFrame:
    """Mean semester GPA per department and semester."""
    means = semesters.groupBy(*DEPT_PERIOD).agg(mean_of(F.col("semester_gpa"), 3, 2).alias("avg_gpa"))
    return means.join(departments.select("department_key", "department_id"), "department_key").drop("department_key")


def summary(semesters: DataFrame, departments: DataFrame) -> DataFrame:
    """Mean GPA and number of students per department and semester."""
    rows = semesters.groupBy(*DEPT_PERIOD).agg(
        mean_of(F.col("semester_gpa"), 3, 2).alias("avg_gpa"), F.count(F.lit(1)).alias("student_count")
    )
    return rows.join(departments.select("department_key", "department_id"), "department_key").drop("department_key")


def trend(semesters: DataFrame) -> DataFrame:
    """Mean semester and running GPA of each department over time."""
    return semesters.groupBy(*DEPT_PERIOD).agg(
        mean_of(F.col("semester_gpa"), 3, 3).alias("semester_gpa"),
        mean_of(F.col("cumulative_gpa"), 3, 3).alias("cumulative_gpa"),
    )


def _first_per_department(rows: DataFrame, n: int, gpa_order: Column) -> DataFrame:
    """First ``n`` rows per department and semester; Spark cuts to ``n`` before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*DEPT_PERIOD).orderBy(gpa_order, "student_key"))
    return rows.withColumn("position", place).filter(F.col("position") <= n)


def _with_student(rows: DataFrame, students: DataFrame) -> DataFrame:
    who = students.select("student_key", "student_id", "first_name", "last_name")
    return rows.join(who, "student_key", "left").select(
        "department_key", *PERIOD, "position", "student_id", "first_name", "last_name", "semester_gpa",
        "avg_attendance_pct",
    )


def page_top(semesters: DataFrame, students: DataFrame, n: int = 10) -> DataFrame:
    """Top ``n`` students of each department and semester."""
    return _with_student(_first_per_department(semesters, n, F.col("semester_gpa").desc()), students)


def page_risk(semesters: DataFrame, students: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` lowest GPAs per department and semester among students under either limit."""
    risky = semesters.filter(
        (F.col("semester_gpa") < LOW_GPA_ON_PAGE) | (F.col("avg_attendance_pct") < LOW_ATTENDANCE)
    )
    return _with_student(_first_per_department(risky, n, F.col("semester_gpa").asc()), students)


def page_kpis(
    semesters: DataFrame, students: DataFrame, courses: DataFrame, departments: DataFrame, period: tuple[str, str]
) -> DataFrame:
    """Students, courses and the GPA and attendance of one semester for every department."""
    current = semesters.filter((F.col("academic_year") == period[0]) & (F.col("semester") == period[1]))
    means = current.groupBy("department_key").agg(
        mean_of(F.col("semester_gpa"), 3, 2).alias("avg_gpa"),
        mean_of(F.col("avg_attendance_pct"), 2, 1).alias("avg_attendance"),
    )
    heads = students.filter("is_current").groupBy("department_key").agg(F.count(F.lit(1)).alias("students"))
    offered = courses.groupBy("department_key").agg(F.count(F.lit(1)).alias("courses_offered"))
    return (
        departments.select("department_key", "department_id")
        .join(heads, "department_key", "left")
        .join(means, "department_key", "left")
        .join(offered, "department_key", "left")
        .na.fill(0, ["students", "courses_offered"])
        .drop("department_key")
    )


def stats(
    semesters: DataFrame, students: DataFrame, instructors: DataFrame, departments: DataFrame
) -> DataFrame:
    """Mean GPA and attendance over all semesters, head counts and the student-faculty ratio."""
    means = semesters.groupBy("department_key").agg(
        mean_of(F.col("semester_gpa"), 3, 2).alias("avg_gpa"),
        mean_of(F.col("avg_attendance_pct"), 2, 1).alias("avg_attendance_pct"),
    )
    heads = students.filter("is_current").groupBy("department_key").agg(F.count(F.lit(1)).alias("student_count"))
    staff = instructors.groupBy("department_key").agg(F.count(F.lit(1)).alias("faculty_count"))
    return (
        departments.select("department_key", "department_id", F.col("department_name").alias("name"))
        .join(means, "department_key", "left")
        .join(heads, "department_key", "left")
        .join(staff, "department_key", "left")
        .na.fill(0, ["student_count", "faculty_count"])
        .withColumn("student_faculty_ratio", half_up(F.col("student_count"), F.col("faculty_count"), 2))
        .drop("department_key")
    )


def attendance_below(semesters: DataFrame, departments: DataFrame, limit: float = LOW_ATTENDANCE) -> DataFrame:
    """Mean attendance per department and the number of student semesters under ``limit``."""
    rows = semesters.groupBy("department_key").agg(
        mean_of(F.col("avg_attendance_pct"), 2, 1).alias("avg_attendance_pct"),
        count_where(F.col("avg_attendance_pct") < limit).alias("below_75_pct_count"),
    )
    names = departments.select("department_key", "department_id", "department_name")
    return rows.join(names, "department_key").drop("department_key")


def course_list(courses: DataFrame, departments: DataFrame) -> DataFrame:
    """Courses with the department that owns them."""
    names = departments.select("department_key", "department_id")
    return courses.join(names, "department_key").select(
        "department_id", "course_id", "course_code", "course_name", "credit_hours", "level", "category"
    )
