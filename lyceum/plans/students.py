"""Rankings, honours, profiles and listings of students."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lyceum.functions import bands, text
from lyceum.functions.grades import HONORS_GPA
from lyceum.functions.numeric import reround
from lyceum.operators import gpa, ranking
from lyceum.operators.gpa import PERIOD
from lyceum.operators.ranking import Rank

# Honours and tier rules.
PERCENTILE_TIERS = [(0.90, "Top 10%"), (0.75, "Top 25%"), (0.50, "Above Average")]
HONOR_TIERS = [(4, "Presidential Scholar"), (2, "Returning Dean's List")]
DEANS_LIST_CREDITS = 12



def _in_time(student: str = "student_key") -> WindowSpec:
    return Window.partitionBy(student).orderBy(*PERIOD)


def named(semesters: DataFrame, students: DataFrame, departments: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Semester rows of current students with student and department names."""
    who = students.filter("is_current").select(
        "student_key",
        "student_id",
        text.full_name(F.col("first_name"), F.col("last_name")).alias("student_name"),
        *extra,
    )
    where = departments.select("department_key", "department_name", "college")
    return semesters.join(who, "student_key").join(where, "department_key")


def semester_ranks(semesters: DataFrame) -> DataFrame:
    """Semester and running GPA with the rank in the department and in the whole class."""
    return ranking.add_ranks(
        gpa.cumulative_gpa(semesters),
        "semester_gpa",
        {
            "dept_gpa_rank": Rank("rank", ("department_key", *PERIOD)),
            "class_gpa_rank": Rank("rank", tuple(PERIOD)),
        },
    ).select(
        "student_key", "department_key", *PERIOD, "semester_gpa", "cumulative_gpa", "credit_hours_earned",
        "credit_hours_attempted", "courses_taken", "courses_passed", "avg_attendance_pct", "dept_gpa_rank",
        "class_gpa_rank",
    )


def top_by_department(
    semesters: DataFrame,
    students: DataFrame,
    departments: DataFrame,
    n: int = 10,
    period: tuple[str, str] | None = None,
) -> DataFrame:
    """Best ``n`` GPA ranks of every department (ties kept), with tier and change since the last semester.

    Only current students of known departments are ranked, so a superseded version takes no place.
    The change looks at all semesters, so it is taken before the period is selected.  Ranks are cut
    on the table of distinct GPAs; only students at a surviving GPA are joined to their names.
    """
    semesters = semesters.join(students.filter("is_current").select("student_key"), "student_key", "left_semi").join(
        departments.select("department_key"), "department_key", "left_semi"
    )
    change = semesters.withColumn("prev_semester_gpa", F.lag("semester_gpa").over(_in_time()))
    chosen = change if period is None else change.filter(
        (F.col("academic_year") == period[0]) & (F.col("semester") == period[1])
    )
    counted = semesters if period is None else semesters.filter(
        (F.col("academic_year") == period[0]) & (F.col("semester") == period[1])
    )
    dept = ("department_key", *PERIOD)
    ranks = {
        "dept_rank": Rank("rank", dept),
        "overall_rank": Rank("dense_rank", tuple(PERIOD)),
        "dept_percentile": Rank("percent_rank", dept),
    }
    best = ranking.value_ranks(counted, "semester_gpa", ranks).filter(F.col("dept_rank") <= n)
    rows = ranking.attach(chosen, best, "semester_gpa", list(ranks))
    tier = F.when(F.col("dept_rank") == 1, "Top of Department").otherwise(
        bands.at_least(F.col("dept_percentile"), PERCENTILE_TIERS, "Below Average")
    )
    delta = F.round(
        F.col("semester_gpa") - F.coalesce(F.col("prev_semester_gpa"), F.col("semester_gpa")), 3
    )
    return named(rows, students, departments, ["program", "major"]).select(
        "student_id", "student_name", "program", "major", "department_name", "college", *PERIOD, "semester_gpa",
        "cumulative_gpa", "credit_hours_earned", "avg_attendance_pct", "dept_rank", "overall_rank",
        F.round("dept_percentile", 6).alias("dept_percentile"), "prev_semester_gpa", delta.alias("gpa_delta"),
        tier.alias("performance_tier"),
    )


def deans_list(semesters: DataFrame, students: DataFrame, departments: DataFrame) -> DataFrame:
    """Latest Dean's List semester of each full-time student and the honour its count earns."""
    qualifying = semesters.filter(
        (F.col("semester_gpa") >= HONORS_GPA) & (F.col("credit_hours_earned") >= DEANS_LIST_CREDITS)
    ).join(
        students.filter(F.col("is_current") & (F.col("student_type") == "Full-Time")).select("student_key"),
        "student_key",
        "left_semi",
    )
    # All qualifying semesters up to the latest one are simply all of them: one aggregate, no window.
    latest = qualifying.groupBy("student_key").agg(
        F.max_by(F.struct("department_key", *PERIOD, "semester_gpa", "credit_hours_earned"), F.struct(*PERIOD)).alias(
            "last"
        ),
        F.count(F.lit(1)).alias("consecutive_dl_count"),
    )
    rows = latest.select("student_key", "last.*", "consecutive_dl_count")
    return named(rows, students, departments).select(
        "student_id", "student_name", "department_name", *PERIOD, reround(F.col("semester_gpa"), 3, 2).alias("semester_gpa"),
        "credit_hours_earned", "consecutive_dl_count",
        bands.at_least(F.col("consecutive_dl_count"), HONOR_TIERS, "Dean's List").alias("honor_tier"),
    )


def by_id(rows: DataFrame, student_id: str, column: str = "student_id") -> DataFrame:
    """Point lookup of a typed id.  Stored ids are normalised already; the bare column lets statistics and
    buckets skip files."""
    return rows.filter(F.col(column) == F.lit(student_id.strip().upper()))


def profiles(semesters: DataFrame, students: DataFrame, departments: DataFrame) -> DataFrame:
    """Every student with the latest semester on record, if any."""
    latest = ranking.latest_per_key(semesters, ["student_key"], [F.col(c).desc() for c in PERIOD])
    last = latest.select(
        "student_key",
        F.col("academic_year").alias("latest_academic_year"),
        F.col("semester").alias("latest_semester"),
        F.col("semester_gpa").alias("latest_semester_gpa"),
        "cumulative_gpa",
        F.col("avg_attendance_pct").alias("latest_attendance_pct"),
    )
    return (
        students.filter("is_current")
        .select("student_key", "student_id", "first_name", "last_name", "program", "student_type", "department_key")
        .join(departments.select("department_key", "department_name"), "department_key")
        .join(last, "student_key", "left")
        .drop("department_key")
    )


def gpa_trend(semesters: DataFrame, students: DataFrame) -> DataFrame:
    """Semester and running GPA over time, in order within each student."""
    who = students.select("student_key", "student_id")
    return semesters.join(who, "student_key").select(
        "student_id", *PERIOD, F.row_number().over(_in_time()).alias("position"), "semester_gpa", "cumulative_gpa",
    )


def enrollment_history(performance: DataFrame, students: DataFrame) -> DataFrame:
    """Enrollments of students: term, course, grade, attendance and scores."""
    who = students.select("student_key", "student_id")
    return performance.join(who, "student_key").select(
        "student_id", *PERIOD, "course_key", "grade_letter", "attendance_pct", "midterm_score", "final_score",
    )


def in_period(semesters: DataFrame, period: tuple[str, str]) -> DataFrame:
    return semesters.filter((F.col("academic_year") == period[0]) & (F.col("semester") == period[1]))


def top_in_period(semesters: DataFrame, students: DataFrame, period: tuple[str, str], n: int = 10) -> DataFrame:
    """Best ``n`` students of one semester; equal GPAs are ordered by student key."""
    rows = ranking.top_n(in_period(semesters, period), n, F.col("semester_gpa").desc(), F.col("student_key"))
    return rows.join(students.select("student_key", "student_id", "first_name", "last_name"), "student_key").select(
        "student_id", "first_name", "last_name", *PERIOD, "semester_gpa", "avg_attendance_pct"
    )


def at_risk_in_period(
    semesters: DataFrame, students: DataFrame, period: tuple[str, str] | None = None,
    max_gpa: float = 2.0, max_attendance: float = 75.0,
) -> DataFrame:
    """Students at or below the GPA or attendance limit, in one semester or in all of them."""
    rows = semesters if period is None else in_period(semesters, period)
    low = (F.col("semester_gpa") <= max_gpa) | (F.col("avg_attendance_pct") <= max_attendance)
    return rows.filter(low).join(students.select("student_key", "student_id"), "student_key").select(
        "student_id", *PERIOD, "semester_gpa", "avg_attendance_pct"
    )


def listing(
    semesters: DataFrame, students: DataFrame, *, department_key: int | None = None, student_type: str | None = None,
    at_risk_only: bool = False,
) -> DataFrame:
    """Student list with the latest GPA and attendance and a risk flag, before paging."""
    latest = ranking.latest_per_key(semesters, ["student_key"], [F.col(c).desc() for c in PERIOD]).select(
        "student_key", F.col("semester_gpa").alias("gpa"), F.col("avg_attendance_pct").alias("attendance_pct")
    )
    rows = students.filter("is_current")
    if department_key is not None:
        rows = rows.filter(F.col("department_key") == department_key)
    if student_type is not None:
        rows = rows.filter(F.col("student_type") == student_type)
    flagged = rows.join(latest, "student_key", "left").withColumn(
        "risk_flag",
        F.coalesce((F.col("gpa") < 2.0) | (F.col("attendance_pct") < 75.0), F.lit(False)),
    )
    return flagged.filter("risk_flag") if at_risk_only else flagged


def list_page(rows: DataFrame, *, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of a listing in order of id, with the size of the whole listing on each row."""
    total = rows.select(F.count(F.lit(1))).scalar()
    return ranking.page(rows.withColumn("total", total), limit, offset, F.col("student_id"))


def gpa_tier(value: Column) -> Column:
    """Filter tier of a GPA."""
    return bands.at_least(value, [(3.5, "honors"), (3.0, "good"), (2.5, "average")], "at_risk")


def slider_filter(
    semesters: DataFrame, gpa_range: tuple[float, float] = (0.0, 4.0), attendance_range: tuple[float, float] = (0.0, 100.0),
    tier: str | None = None,
) -> DataFrame:
    """Range filters on GPA and attendance and an optional GPA tier."""
    rows = semesters.filter(
        F.col("semester_gpa").between(*gpa_range) & F.col("avg_attendance_pct").between(*attendance_range)
    )
    tagged = rows.withColumn("gpa_tier", gpa_tier(F.col("semester_gpa")))
    return tagged if tier is None else tagged.filter(F.col("gpa_tier") == tier)


