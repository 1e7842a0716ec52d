"""Registered queries: every plan bound to the test tables, whole tables only."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lyceum import schemas
from lyceum.functions import text
from lyceum.operators import cleaning, governance, gpa, keys, merge, quality, ranges, ranking
from lyceum.plans import attendance as att
from lyceum.plans import courses, departments, loads, overview, risk, students, views
from lyceum.sources import campus, date_dim, readers, sinks, staging, warehouse
from lyceum.streaming import attendance as stream
from lyceum.streaming import ledger

AS_OF = date(2002, 1, 1)
CURRENT_PERIOD = ("2000-2001", "Fall 2000")
CURRENT_YEAR = "2000-2001"
FIRST_LOAD_BEFORE = "1999-01-01"
FIRST_DELIVERY = "2001-07-01"
FIRST_EVENTS_BEFORE = "2024-01-16"
ADMIN = governance.Principal("dean", "DEPARTMENT_ADMIN", ("DEPT_ASIA_ADMIN", "DEPT_EUROPE_ADMIN"))
TEACHER = governance.Principal("Supplier#000000001", "INSTRUCTOR")
GUEST = governance.Principal("guest", "VISITOR")

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


# --- GPA and rankings ---------------------------------------------------------------------


@query
def semester_gpa(spark, sf):
    return campus.semester_gpa(spark, sf)


@query
def semester_gpa_ranked(spark, sf):
    kept = staging.stage(campus.semester_gpa(spark, sf), "semester-gpa")
    return students.semester_ranks(kept)


@query
def cumulative_gpa(spark, sf):
    return campus.semester_gpa_full(spark, sf)


@query
def gpa_pipeline_from_raw(spark, sf):
    lines = campus.enrollment_lines(spark, sf)
    term = campus.labelled_terms(spark, sf).withColumn("student_id", F.col("student_key").cast("string"))
    return loads.from_raw_enrollments(lines.join(term, lines.l_orderkey == term.o_orderkey))


@query
def top_students_by_department(spark, sf):
    kept = staging.stage(campus.semester_gpa_full(spark, sf), "semester-gpa")
    return students.top_by_department(kept, campus.students(spark, sf), campus.departments(spark, sf), n=10)


@query
def top_students_by_department_period(spark, sf):
    kept = staging.stage(campus.semester_gpa_full(spark, sf), "semester-gpa")
    return students.top_by_department(
        kept, campus.students(spark, sf), campus.departments(spark, sf), n=10, period=CURRENT_PERIOD
    )


@query
def top_students_with_history(spark, sf):
    """The same where accounts in debt are superseded versions of a student: they neither appear nor take a rank."""
    kept = staging.stage(campus.semester_gpa_full(spark, sf), "semester-gpa")
    people = campus.students(spark, sf).withColumn("is_current", F.col("scholarship_amount") >= 0)
    return students.top_by_department(kept, people, campus.departments(spark, sf), n=10)


@query
def deans_list(spark, sf):
    return students.deans_list(
        campus.semester_gpa(spark, sf), campus.students(spark, sf), campus.departments(spark, sf)
    )


# --- departments and courses --------------------------------------------------------------


@query
def department_metrics(spark, sf):
    return departments.metrics(campus.performance(spark, sf), campus.departments(spark, sf))


@query
def department_scorecard(spark, sf):
    return departments.scorecard(campus.semester_gpa(spark, sf), campus.departments(spark, sf))


@query
def course_difficulty(spark, sf):
    return courses.difficulty(
        campus.performance_terms(spark, sf), campus.courses(spark, sf), campus.departments(spark, sf)
    )


@query
def course_grade_buckets(spark, sf):
    return courses.grade_buckets(
        campus.performance_terms(spark, sf), campus.courses(spark, sf), campus.departments(spark, sf)
    )


@query
def dept_avg_gpa(spark, sf):
    return departments.average_gpa(campus.semester_gpa(spark, sf), campus.departments(spark, sf))


@query
def department_summary(spark, sf):
    return departments.summary(campus.semester_gpa(spark, sf), campus.departments(spark, sf))


@query
def department_trend(spark, sf):
    return departments.trend(campus.semester_gpa_full(spark, sf))


@query
def department_page_top(spark, sf):
    return departments.page_top(campus.semester_gpa(spark, sf), campus.students(spark, sf))


@query
def department_page_risk(spark, sf):
    return departments.page_risk(campus.semester_gpa(spark, sf), campus.students(spark, sf))


@query
def department_page_kpis(spark, sf):
    return departments.page_kpis(
        campus.semester_gpa(spark, sf), campus.students(spark, sf), campus.courses(spark, sf),
        campus.departments(spark, sf), CURRENT_PERIOD,
    )


@query
def department_stats(spark, sf):
    return departments.stats(
        campus.semester_gpa(spark, sf), campus.students(spark, sf), campus.instructors(spark, sf),
        campus.departments(spark, sf),
    )


@query
def dept_attendance_below_75(spark, sf):
    return departments.attendance_below(campus.semester_gpa(spark, sf), campus.departments(spark, sf))


@query
def department_courses(spark, sf):
    return departments.course_list(campus.courses(spark, sf), campus.departments(spark, sf))


# --- risk ---------------------------------------------------------------------------------


@query
def risk_early_warning(spark, sf):
    return risk.early_warning(
        campus.semester_gpa_full(spark, sf), campus.students(spark, sf), campus.departments(spark, sf)
    )


@query
def student_look_backs(spark, sf):
    return risk.look_backs(campus.semester_gpa_full(spark, sf))


@query
def risk_scoring(spark, sf):
    return risk.scoring(
        campus.semester_gpa_full(spark, sf), campus.students(spark, sf), campus.departments(spark, sf)
    )


@query
def probation(spark, sf):
    return risk.probation(
        campus.semester_gpa_full(spark, sf), campus.students(spark, sf), campus.departments(spark, sf)
    )


@query
def scholarship_at_risk(spark, sf):
    return risk.scholarship_at_risk(
        campus.semester_gpa(spark, sf), campus.students(spark, sf), campus.departments(spark, sf)
    )


@query
def dropout_signal(spark, sf):
    return risk.dropout_signal(
        campus.semester_gpa(spark, sf), campus.students(spark, sf), campus.departments(spark, sf), CURRENT_YEAR
    )


@query
def risk_profile(spark, sf):
    return risk.risk_profile(campus.semester_gpa(spark, sf), campus.students(spark, sf))


@query
def at_risk_period(spark, sf):
    return students.at_risk_in_period(campus.semester_gpa(spark, sf), campus.students(spark, sf))


@query
def university_risk_summary(spark, sf):
    return overview.risk_summary(campus.semester_gpa(spark, sf))


# --- overview -----------------------------------------------------------------------------


@query
def kpi_overview(spark, sf):
    return overview.kpis(campus.semester_gpa(spark, sf))


@query
def kpi_mean_of_means(spark, sf):
    return overview.mean_of_means(campus.semester_gpa(spark, sf))


@query
def gpa_by_semester(spark, sf):
    return overview.gpa_by_semester(campus.semester_gpa(spark, sf))


@query
def gpa_histogram(spark, sf):
    return overview.gpa_histogram(campus.semester_gpa(spark, sf))


@query
def grade_distribution(spark, sf):
    return overview.grade_distribution(campus.graded_lines(spark, sf))


@query
def attendance_heatmap(spark, sf):
    return overview.attendance_heatmap(campus.semester_gpa(spark, sf), campus.departments(spark, sf))


# --- students -----------------------------------------------------------------------------


@query
def student_profile(spark, sf):
    return students.profiles(
        campus.semester_gpa_full(spark, sf), campus.students(spark, sf), campus.departments(spark, sf)
    )


@query
def gpa_trend(spark, sf):
    return students.gpa_trend(campus.semester_gpa_full(spark, sf), campus.students(spark, sf))


@query
def enrollment_history(spark, sf):
    return students.enrollment_history(campus.performance(spark, sf), campus.students(spark, sf))


@query
def top_students_period(spark, sf):
    return students.top_in_period(
        campus.semester_gpa(spark, sf), campus.students(spark, sf), CURRENT_PERIOD, n=10
    )


@query
def student_list_page(spark, sf):
    rows = students.listing(campus.semester_gpa(spark, sf), campus.students(spark, sf))
    masked = governance.mask(rows, "DATA_ANALYST")
    kept = staging.stage(
        masked.select("student_id", "email", "department_key", "student_type", "gpa", "attendance_pct", "risk_flag"),
        "student-list",
    )
    return students.list_page(kept, limit=50, offset=100)


@query
def scholarship_ranks(spark, sf):
    """Ranks by scholarship, of which nearly every student has another, overall and within the department."""
    rows = campus.students(spark, sf).select("student_key", "department_key", "scholarship_amount")
    overall = ranges.with_ranks(rows, "scholarship_amount").withColumnsRenamed({"rank": "overall_rank", "dense_rank": "overall_dense"})
    return ranges.with_ranks(overall, "scholarship_amount", ["department_key"]).withColumnsRenamed({"rank": "dept_rank", "dense_rank": "dept_dense"})


@query
def student_pages(spark, sf):
    """First page and one past three quarters of a listing by scholarship, from a directory of its ranges."""
    order = [F.col("scholarship_amount").desc(), F.col("student_key").asc()]
    path = staging.scratch_path(spark, "student-pages")
    ranges.write_pages(campus.students(spark, sf).select("student_key", "student_id", "scholarship_amount"), path, order, ranges=8)
    deep = ranges.total_rows(spark, path) * 3 // 4
    pages = [ranges.read_page(spark, path, order, at, 50).withColumn("page_offset", F.lit(at).cast("bigint")) for at in (0, deep)]
    return pages[0].unionByName(pages[1])


@query
def student_risk_factors(spark, sf):
    return risk.risk_factors(students.listing(campus.semester_gpa(spark, sf), campus.students(spark, sf)))


@query
def gpa_tier_filter(spark, sf):
    return students.slider_filter(
        campus.semester_gpa(spark, sf), (1.0, 3.5), (60.0, 90.0), tier="average"
    )


# --- attendance ---------------------------------------------------------------------------


def _attendance(spark, sf):
    return att.derive(att.one_per_day(campus.attendance_events(spark, sf)))


def _attendance_with_department(spark, sf):
    rows = campus.attendance_events(spark, sf)
    return att.derive(rows).join(campus.students(spark, sf).select("student_key", "department_key"), "student_key")


@query
def attendance_pct(spark, sf):
    return att.student_course_pct(_attendance(spark, sf))


@query
def attendance_summary(spark, sf):
    return att.summary(_attendance_with_department(spark, sf), campus.departments(spark, sf))


@query
def attendance_kpis(spark, sf):
    return att.kpis(_attendance_with_department(spark, sf), by=["department_key"])


@query
def attendance_status(spark, sf):
    return att.by_status(campus.attendance_events(spark, sf))


@query
def attendance_daily(spark, sf):
    return att.daily(campus.attendance_events(spark, sf))


@query
def attendance_weekday(spark, sf):
    return att.by_weekday(campus.attendance_events(spark, sf))


@query
def top_absent_courses(spark, sf):
    return att.most_absent_courses(campus.attendance_events(spark, sf))


@query
def course_absence(spark, sf):
    return att.course_absence(campus.attendance_events(spark, sf))


@query
def attendance_backfill(spark, sf):
    """Class meetings are all attendance facts and, as their semesters hardly overlap with those of the
    enrollments, every line that was not withdrawn: one meeting per line."""
    facts = staging.stage(
        campus.performance(spark, sf).select(
            "student_key", "course_key", "instructor_key", "l_linenumber", "l_shipdate", *gpa.PERIOD, "grade_letter",
            "attendance_pct", "is_withdrawn",
        ),
        "performance",
    )
    keys_ = ["student_key", "course_key", *gpa.PERIOD, "is_present"]
    recorded = _attendance(spark, sf).select(*keys_)
    lines = facts.filter("NOT is_withdrawn").withColumn("is_present", F.col("attendance_pct") >= 75).select(*keys_)
    return loads.backfill_attendance(facts.drop("is_withdrawn"), recorded.unionByName(lines))


# --- cleaning and quality -----------------------------------------------------------------


def _checked(spark, sf):
    return cleaning.check_students(
        campus.registrations(spark, sf), ["enrollment_date", "form_id"], as_of=AS_OF
    )


@query
def clean_students_valid(spark, sf):
    return cleaning.accepted(_checked(spark, sf))


@query
def clean_students_rejected(spark, sf):
    return cleaning.rejected(_checked(spark, sf)).select("form_id", "student_id", "email", "validation_errors")


@query
def rejection_rate(spark, sf):
    return cleaning.rejection_rate(_checked(spark, sf))


@query
def enriched_grades(spark, sf):
    return cleaning.enrich_grades(campus.enrollment_lines(spark, sf)).select(
        "l_orderkey", "l_linenumber", "grade_letter", "grade_points", "credit_hours", "quality_points", "is_passing",
        "is_withdrawn", "is_incomplete", "overall_score",
    )


@query
def dq_report_students(spark, sf):
    rows = text.trim_strings(campus.registrations(spark, sf))
    return quality.report(rows, quality.students_suite())


@query
def dq_report_enrollments(spark, sf):
    rows = campus.enrollment_lines(spark, sf).withColumns(
        {
            "enrollment_id": F.concat_ws("-", "l_orderkey", "l_linenumber"),
            "student_id": F.col("l_orderkey"),
            "course_id": F.col("course_key"),
        }
    )
    rules = quality.enrollments_suite()
    orders = campus.table(spark, sf, "orders")
    reference = quality.referential_integrity(rows, "student_id", orders, "o_orderkey", position=len(rules))
    return quality.report(rows, rules).unionByName(reference)


@query
def dq_report_attendance(spark, sf):
    rows = campus.attendance_events(spark, sf).withColumn("student_id", F.col("student_key"))
    return quality.report(rows, quality.attendance_suite())


@query
def dq_summary(spark, sf):
    return quality.summary(dq_report_students(spark, sf), "STG_STUDENTS")


@query
def dq_offending_values(spark, sf):
    return quality.offending_values(
        text.trim_strings(campus.registrations(spark, sf)), "student_type", cleaning.STUDENT_TYPES
    )


@query
def dq_range_warn(spark, sf):
    rows = campus.table(spark, sf, "lineitem")
    return quality.report(rows, [quality.in_range("l_extendedprice", 1000, 100000), quality.in_range("l_tax", 0, 0.05)])


@query
def dq_ref_integrity(spark, sf):
    events = campus.attendance_events(spark, sf)
    return quality.referential_integrity(events, "course_key", campus.courses(spark, sf), "course_key")


@query
def dq_flag_audit(spark, sf):
    rows = campus.attendance_events(spark, sf).withColumns(
        {"student_id": F.col("student_key"), "course_id": F.col("course_key")}
    )
    severity = {
        "v_has_student_id": "FAIL", "v_has_course_id": "FAIL", "v_valid_date": "FAIL", "v_valid_status": "FAIL",
        "v_is_weekday": "WARN",
    }
    return quality.flag_audit(quality.attendance_flags(rows), severity)


# --- loads --------------------------------------------------------------------------------

_STUDENT_ATTRIBUTES = [
    "student_id", "first_name", "last_name", "email", "program", "major", "department_id", "student_type",
    "scholarship", "scholarship_amount", "row_hash",
]


def _versions(forms: DataFrame) -> DataFrame:
    """Latest form per student with the hash of its attributes."""
    latest = ranking.latest_per_key(
        text.trim_strings(forms), ["student_id"], [F.col("enrollment_date").desc(), F.col("form_id").desc()]
    )
    typed = latest.withColumns(
        {
            "scholarship": text.parse_flag(F.col("scholarship")),
            "scholarship_amount": text.parse_number(F.col("scholarship_amount"), 0.0),
        }
    )
    parts = [
        F.col(c).cast("decimal(18,2)") if c == "scholarship_amount" else F.col(c) for c in cleaning.VERSIONED_COLUMNS
    ]
    return typed.withColumn("row_hash", text.row_digest(*parts)).select(*_STUDENT_ATTRIBUTES)


@query
def scd2_student(spark, sf):
    """The dimension as loaded from the forms before a date, merged with the latest form of everyone."""
    forms = campus.registrations(spark, sf)
    first_load = _versions(forms.filter(F.col("enrollment_date") < FIRST_LOAD_BEFORE)).withColumns(
        {
            "effective_date": F.lit(FIRST_LOAD_BEFORE).cast("date"),
            "expiry_date": F.lit(merge.OPEN_END),
            "is_current": F.lit(True),
        }
    )
    return merge.scd2(first_load, _versions(forms), "student_id", AS_OF)


def _enrollment_versions(lines: DataFrame) -> DataFrame:
    keyed = lines.withColumn("enrollment_id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    order = ["l_shipdate", "course_key", "instructor_key", "final_score", "attendance_pct", "midterm_score", "grade_letter"]
    single = ranking.latest_per_key(keyed, ["enrollment_id"], [F.col(c).desc() for c in order])
    return loads.enrollment_hash(single).select(
        "enrollment_id", "course_key", "instructor_key", "grade_letter", "grade_points", "credit_hours",
        "quality_points", "attendance_pct", "assignments_completed", "midterm_score", "final_score", "overall_score",
        "is_passing", "is_withdrawn", "is_incomplete", "row_hash",
    )


@query
def upsert_performance(spark, sf):
    """Facts loaded from the lines shipped before a date, then upserted with the last version of every line."""
    lines = campus.graded_lines(spark, sf)
    first_load = lines.filter(F.col("l_shipdate") < F.lit(FIRST_LOAD_BEFORE).cast("date"))
    return loads.merge_performance(_enrollment_versions(first_load), _enrollment_versions(lines))


def _attendance_versions(spark, sf, before: str | None = None):
    rows = campus.attendance_events(spark, sf)
    if before is not None:
        rows = rows.filter(F.col("attendance_date") < F.lit(before).cast("date"))
    order = [F.col("event_time").desc(), F.col("event_id").desc()]
    single = ranking.latest_per_key(rows, ["student_key", "course_key"], order)
    return att.derive(single).select(
        "student_key", "course_key", "date_key", "status", "is_present", "is_excused", "minutes_late", "source_system"
    )


@query
def upsert_attendance(spark, sf):
    """Latest record per student and course: first half of the month, then the whole month."""
    return merge.upsert(
        _attendance_versions(spark, sf, FIRST_EVENTS_BEFORE), _attendance_versions(spark, sf),
        ["student_key", "course_key"], update=loads.ATTENDANCE_UPDATES, changed=("status",),
    )


@query
def insert_only_attendance(spark, sf):
    return merge.insert_new(
        _attendance_versions(spark, sf, FIRST_EVENTS_BEFORE), _attendance_versions(spark, sf),
        ["student_key", "course_key"],
    )


@query
def surrogate_keys(spark, sf):
    orders = campus.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return keys.with_surrogate_key(orders, ["o_orderkey"], "enrollment_key")


@query
def instructor_lookup(spark, sf):
    """Natural to surrogate key with a default for unmatched rows: only active instructors are known."""
    active = campus.instructors(spark, sf).filter("is_active").select(
        F.col("instructor_key").alias("natural_key"), F.col("instructor_key")
    )
    lines = campus.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("natural_key")
    )
    rows = keys.lookup(lines, active, "natural_key", "instructor_key", default=loads.UNKNOWN_INSTRUCTOR)
    return rows.groupBy("instructor_key").agg(F.count(F.lit(1)).alias("enrollments"))


@query
def orders_by_calendar(spark, sf):
    """Date dimension from the first to the last enrollment on file, with the enrollments of each day."""
    per_day = campus.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("full_date")).agg(
        F.count(F.lit(1)).alias("enrollments")
    )
    first, last = per_day.agg(F.min("full_date"), F.max("full_date")).first()
    days = date_dim.date_dim(spark, first, last) if first else date_dim.date_dim(spark).limit(0)
    return days.join(per_day, "full_date", "left").na.fill(0, ["enrollments"])


@query
def parameterised_period(spark, sf):
    """The SQL entry point: named parameters over a view."""
    campus.semester_gpa(spark, sf).createOrReplaceTempView("fact_semester_gpa")
    return readers.query(
        spark,
        """SELECT student_key, semester_gpa, avg_attendance_pct FROM fact_semester_gpa
           WHERE academic_year = :academic_year AND semester = :semester AND semester_gpa >= :floor""",
        academic_year=CURRENT_PERIOD[0], semester=CURRENT_PERIOD[1], floor=3.5,
    )


# --- governance ---------------------------------------------------------------------------


@query
def mask_student_analyst(spark, sf):
    return governance.mask(campus.students(spark, sf), "DATA_ANALYST")


@query
def mask_student_portal(spark, sf):
    return governance.mask(campus.students(spark, sf), "STUDENT_PORTAL")


def _grants(spark, sf):
    dept = campus.departments(spark, sf)
    return dept.select(
        F.concat(F.lit("DEPT_"), F.upper("college"), F.lit("_ADMIN")).alias("role_name"),
        "department_id",
        F.lit(True).alias("is_active"),
    )


@query
def rls_fact_dept_admin(spark, sf):
    rows = governance.visible_facts(
        campus.semester_gpa(spark, sf), ADMIN, grants=_grants(spark, sf), departments=campus.departments(spark, sf),
        instructors=campus.instructors(spark, sf),
    )
    return rows.groupBy("department_key").agg(F.count(F.lit(1)).alias("visible_rows"))


@query
def rls_fact_pruned(spark, sf):
    """Department grants on facts laid out by department: the scan opens the partitions of granted departments only."""
    facts = campus.semester_gpa(spark, sf)
    path = staging.scratch_path(spark, "gpa-by-department")
    sinks.write_clustered(facts, path, partition_by=["department_key"], cluster_by=["student_key"])
    depts = campus.departments(spark, sf)
    return governance.visible_facts(
        spark.read.schema(facts.schema).parquet(path), ADMIN, grants=governance.keyed_grants(_grants(spark, sf), depts),
        departments=depts, instructors=campus.instructors(spark, sf),
    ).select(*facts.columns)


@query
def rls_fact_instructor(spark, sf):
    return governance.visible_facts(
        campus.semester_gpa(spark, sf), TEACHER, grants=_grants(spark, sf),
        departments=campus.departments(spark, sf), instructors=campus.instructors(spark, sf),
    )


@query
def rls_student_instructor(spark, sf):
    return governance.visible_students(
        campus.students(spark, sf), TEACHER, grants=_grants(spark, sf), departments=campus.departments(spark, sf),
        performance=campus.performance(spark, sf), instructors=campus.instructors(spark, sf),
    ).select("student_key", "student_id", "department_key")


@query
def rls_student_dept_admin(spark, sf):
    return governance.visible_students(
        campus.students(spark, sf), ADMIN, grants=_grants(spark, sf), departments=campus.departments(spark, sf),
        performance=campus.performance(spark, sf), instructors=campus.instructors(spark, sf),
    ).select("student_key", "student_id", "department_key")


@query
def rls_default_deny_count(spark, sf):
    rows = governance.visible_facts(
        campus.semester_gpa(spark, sf), GUEST, grants=_grants(spark, sf), departments=campus.departments(spark, sf),
        instructors=campus.instructors(spark, sf),
    )
    return rows.agg(F.count(F.lit(1)).alias("visible_rows"))


@query
def seeded_grants(spark, sf):
    """Grants of every department, seeded over those that already exist for departments with customers in debt."""
    wanted = _grants(spark, sf)
    debt = campus.students(spark, sf).filter(F.col("scholarship_amount") < -950).select("department_key")
    chosen = campus.departments(spark, sf).join(debt, "department_key", "left_semi").select("department_id")
    existing = wanted.join(chosen, "department_id", "left_semi").withColumn("is_active", F.lit(False))
    return governance.seed_grants(existing.select(*wanted.columns), wanted)


# --- streaming ----------------------------------------------------------------------------


def _stream_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "event_time",
        F.col("course_key").alias("course_id"),
        F.col("student_key").alias("student_id"),
        "status",
    )


def _naive(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query
def attendance_window_batch(spark, sf):
    return _naive(stream.batch_windows(_stream_columns(campus.attendance_events(spark, sf))))


@query
def attendance_stream(spark, sf):
    """Replay of the event table through the stream until it is drained."""
    schema = campus.table(spark, sf, "events").schema
    # A glob, so that the source accepts both one file and a folder of that name.
    source = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    base = staging.scratch_path(spark, "attendance-stream")
    job = stream.start(
        _stream_columns(campus.as_attendance(source)), f"{base}/windows", f"{base}/checkpoint", available_now=True
    )
    job.awaitTermination()
    return _naive(stream.current_state(spark, f"{base}/windows"))


@query
def attendance_alerts(spark, sf):
    """Alert side output of the batch twin: windows under the limit."""
    windows = stream.batch_windows(_stream_columns(campus.attendance_events(spark, sf)))
    return _naive(windows.filter("absence_alert")).select("window_start", "course_id", "attendance_rate")




@query
def attendance_stream_json(spark, sf):
    """Events as JSON messages, delivered in four stretches of time and decoded by a stream that resumes for each."""
    rows = stream.current_state(spark, _replayed(spark, sf)[0])
    return _naive(rows).withColumn("course_id", F.col("course_id").cast("bigint"))


@query
def attendance_stream_alerts(spark, sf):
    """What the alert output of the same stream says last of each window."""
    alerts = stream.current_alerts(spark, _replayed(spark, sf)[1])
    return _naive(alerts).select("window_start", F.col("course_id").cast("bigint").alias("course_id"), "attendance_rate")


def _deliveries(spark, sf) -> DataFrame:
    """Events with the delivery that brings them: one per quarter of their time; every seventh event is one delivery late."""
    rows = campus.attendance_events(spark, sf)
    low, high = rows.agg(F.min(F.unix_micros("event_time")), F.max(F.unix_micros("event_time"))).first()
    quarter = F.floor((F.unix_micros("event_time") - F.lit(low)) * 4 / F.lit((high or 0) - (low or 0) + 1)).cast("int")
    return rows.withColumn("delivery", quarter + F.when(F.col("event_id") % 7 == 3, 1).otherwise(0))


def _ledgered(spark, sf) -> str:
    """Folder of a stream that gets five deliveries, of which the third comes twice and an old one last."""
    base = staging.scratch_path(spark, "ledgered")
    rows = staging.stage(_deliveries(spark, sf), "deliveries")
    sink = ledger.event_sink(base)
    columns = ["event_id", "event_time", F.col("course_key").alias("course_id"), F.col("student_key").alias("student_id"), "status"]
    for number in (0, 1, 2, 2, 3, 4, 1):
        sink(rows.filter(F.col("delivery") == number).select(*columns), number)
    return base


@query
def stream_with_late_events(spark, sf):
    """Windows of a stream in which every seventh event comes a delivery late: what is kept, per window and course."""
    return _naive(ledger.windows(spark, _ledgered(spark, sf)))


@query
def stream_late_events(spark, sf):
    """The events that came after their window had closed, kept aside."""
    rows = ledger.late_events(spark, _ledgered(spark, sf))
    return rows.select("event_id", F.col("event_time").cast("timestamp_ntz").alias("event_time"), "course_id", F.col("batch_id").cast("int").alias("batch_id"))


@query
def attendance_fact_replay(spark, sf):
    """Attendance facts from two batches, the first of which is replayed after the second."""
    base = staging.scratch_path(spark, "fact-replay")
    teacher = loads.default_instructor(campus.instructors(spark, sf))
    half = campus.attendance_events(spark, sf).withColumn("half", F.col("event_id") % 2)
    people = campus.students(spark, sf).select("student_key", "student_id")
    sink = ledger.fact_sink(f"{base}/facts", base)
    for number in (0, 1, 1, 0):
        raw = half.filter(F.col("half") == number).join(people, "student_key").select(
            "student_id", F.col("course_key").cast("string").alias("course_id"), F.col("attendance_date").cast("string").alias("attendance_date"),
            "status", "source_system", "minutes_late",
        )
        sink(loads.attendance_rows(raw, campus.students(spark, sf), campus.courses(spark, sf), teacher), number)
    return spark.read.schema(schemas.FACT_ATTENDANCE).parquet(f"{base}/facts").select("student_key", "course_key", "date_key", "status", "minutes_late")


def _replayed(spark, sf) -> tuple[str, str]:
    """Window and alert folders of a replay in four deliveries that are cut between windows."""
    rows = campus.attendance_events(spark, sf)
    message = F.to_json(
        F.struct(
            F.col("student_key").cast("string").alias("student_id"),
            F.col("course_key").cast("string").alias("course_id"),
            F.col("attendance_date").cast("string").alias("attendance_date"),
            "status",
            "source_system",
            F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        )
    )
    slot = F.floor(F.unix_micros("event_time") / 300_000_000)
    first, last = rows.agg(F.min(slot), F.max(slot)).first()
    base = staging.scratch_path(spark, "attendance-json")
    folders = f"{base}/windows", f"{base}/alerts"
    cuts = [first + (last - first + 1) * k // 4 for k in range(5)] if first is not None else [0, 0]
    for k, (low, high) in enumerate(zip(cuts, cuts[1:])):
        part = rows.filter((slot >= low) & (slot < high)).select(F.encode(message, "UTF-8").alias("value"))
        part.write.parquet(f"{base}/messages/part{k}")
        source = spark.readStream.schema("value binary").parquet(f"{base}/messages/*")
        job = stream.start(
            stream.decode(source), folders[0], f"{base}/checkpoint", alerts_path=folders[1], available_now=True
        )
        job.awaitTermination()
    return folders


# --- sources, sinks and loads -------------------------------------------------------------


@query
def csv_round_trip(spark, sf):
    """Orders written as CSV with quotes, separators and line breaks inside a field and some numbers that are none."""
    amount = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.col("o_totalprice").cast("decimal(12,2)").cast("string"))
    note = F.concat(F.lit('said "'), "o_orderpriority", F.lit('",\nthen '), "o_orderstatus")
    path = staging.scratch_path(spark, "orders-csv")
    sinks.write_csv(campus.table(spark, sf, "orders").select("o_orderkey", note.alias("note"), amount.alias("amount")), path)
    schema = "o_orderkey long, note string, amount double"
    rows = readers.read_csv(spark, path, T.StructType.fromDDL(schema), multi_line=True, keep_corrupt=True)
    return rows.select("o_orderkey", "note", "amount", F.col(readers.CORRUPT).isNotNull().alias("is_corrupt"))


@query
def json_round_trip(spark, sf):
    """Suppliers written as JSON lines and read with a schema."""
    path = staging.scratch_path(spark, "suppliers-json")
    sinks.write_table(campus.instructors(spark, sf), path, fmt="json")
    schema = T.StructType.fromDDL("instructor_key long, instructor_id string, department_key long, is_active boolean")
    return readers.read_json(spark, path, schema, outer_array=False)


@query
def clustered_table(spark, sf):
    """Orders appended in two deliveries, laid out by status and sorted within, and read through a catalog-free table."""
    orders = campus.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    path = staging.scratch_path(spark, "orders-appended")
    for half in (0, 1):
        sinks.append_rows(orders.filter(F.col("o_orderkey") % 2 == half), path)
    target = staging.scratch_path(spark, "orders-clustered")
    sinks.write_clustered(
        readers.read_table(spark, path, "parquet"), target, partition_by=["o_orderstatus"], cluster_by=["o_custkey"]
    )
    return readers.read_table(spark, target, "parquet").select(*orders.columns)


@query
def interleaved_table(spark, sf):
    """Lines laid out by course and day at once: a filter on either skips files."""
    lines = campus.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity")
    path = staging.scratch_path(spark, "lines-interleaved")
    sinks.write_interleaved(lines, path, keys=["l_partkey", "l_shipdate"])
    return readers.read_table(spark, path, "parquet").select(*lines.columns)


@query
def staging_reload(spark, sf):
    """Staging tables after two deliveries: students are replaced, attendance is appended."""
    folder = staging.scratch_path(spark, "staging")
    for _ in range(2):
        sinks.load_staging(campus.students(spark, sf), folder, "students", "students.csv")
        sinks.load_staging(campus.attendance_events(spark, sf), folder, "attendance", "attendance.csv")
    tables = [
        spark.read.parquet(f"{folder}/stg_{name}").groupBy("source_file", "is_valid").agg(F.count(F.lit(1)).alias("row_count"))
        for name in ("students", "attendance")
    ]
    return tables[0].unionByName(tables[1])


def _published(spark, sf):
    return views.publish(
        campus.semester_gpa_full(spark, sf),
        _attendance_with_department(spark, sf).drop("academic_year", "semester", "month_name"),
        campus.students(spark, sf), campus.departments(spark, sf), date_dim.date_dim(spark),
    )


@query
def view_scholarship_at_risk(spark, sf):
    _published(spark, sf)
    return readers.query(spark, f"SELECT * FROM {views.SCHOLARSHIP_AT_RISK}")


@query
def view_attendance_summary(spark, sf):
    _published(spark, sf)
    return readers.query(spark, f"SELECT * FROM {views.ATTENDANCE_SUMMARY}")


def _raw_enrollments(spark, sf):
    """Enrollments as extracts bring them: natural keys, raw grades, labels and text dates."""
    return _enrollment_extract(spark, sf).drop("l_orderkey", "l_linenumber")


def _enrollment_extract(spark, sf):
    """The same with the keys of their lines.  Students meet orders, not lines, so a line is moved once, by its order."""
    people = campus.students(spark, sf).select("student_key", "student_id")
    teachers = campus.instructors(spark, sf).select("instructor_key", "instructor_id")
    day = F.to_date(F.col("enrollment_date_key").cast("string"), "yyyyMMdd").cast("string")
    term = campus.labelled_terms(spark, sf).join(people, "student_key").withColumn("enrollment_date", day)
    lines = campus.enrollment_lines(spark, sf).join(teachers, "instructor_key")
    joined = lines.join(term, lines.l_orderkey == term.o_orderkey)
    return joined.select(
        "l_orderkey", "l_linenumber", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("enrollment_id"), "student_id",
        F.col("course_key").cast("string").alias("course_id"), "instructor_id", "semester", "academic_year", "enrollment_date", "grade",
        "grade_points", "attendance_pct", "assignments_completed", "assignments_total", "midterm_score", "final_score",
    )


@query
def performance_facts(spark, sf):
    """Raw enrollments to fact rows: keys of students, courses and instructors, measures and flags."""
    rows = loads.performance_rows(
        _raw_enrollments(spark, sf), campus.students(spark, sf), campus.courses(spark, sf), campus.instructors(spark, sf)
    )
    return rows.select(
        "enrollment_id", "student_key", "course_key", "instructor_key", "department_key", "enrollment_date_key", *gpa.PERIOD,
        "grade_letter", "grade_points", "credit_hours", "quality_points", "attendance_pct", "overall_score", "is_passing",
    )


def _raw_attendance(spark, sf):
    people = campus.students(spark, sf).select("student_key", "student_id")
    rows = campus.attendance_events(spark, sf).join(people, "student_key")
    return rows.select(
        "student_id", F.col("course_key").cast("string").alias("course_id"),
        F.col("attendance_date").cast("string").alias("attendance_date"), "status", "source_system", "minutes_late",
    )


@query
def attendance_facts(spark, sf):
    """Raw attendance to fact rows: known students and courses on weekdays, one row per student, course and day."""
    teacher = loads.default_instructor(campus.instructors(spark, sf))
    return loads.attendance_rows(_raw_attendance(spark, sf), campus.students(spark, sf), campus.courses(spark, sf), teacher)


def _delivery(spark, sf, before: str | None) -> dict[str, DataFrame]:
    """Extracts of one delivery: those up to a date, or all."""
    forms = campus.registrations(spark, sf).withColumn(
        "arrival", F.concat("enrollment_date", F.lpad(F.col("form_id").cast("string"), 20, "0"))
    )
    # Line numbers repeat within some orders; an extract has one row per enrollment.
    order = ["course_id", "instructor_id", "final_score", "attendance_pct", "midterm_score", "grade"]
    # The date is the order's, so all lines of an enrollment are in the delivery or none.
    lines = _enrollment_extract(spark, sf)
    lines = lines if before is None else lines.filter(F.col("enrollment_date") < before)
    enrollments = ranking.latest_per_key(lines, ["l_orderkey", "l_linenumber"], [F.col(c).desc() for c in order])
    teachers = campus.instructors(spark, sf).join(campus.departments(spark, sf), "department_key")
    owner = campus.departments(spark, sf).select(F.col("department_key"), "department_id")
    return {
        "students": forms if before is None else forms.filter(F.col("enrollment_date") < before),
        "departments": campus.departments(spark, sf).select(F.col("department_key").cast("string").alias("department_id"), "department_name", "college"),
        "courses": campus.courses(spark, sf).join(owner.drop("department_id"), "department_key").withColumn(
            "department_id", F.col("department_key").cast("string")
        ).drop("department_key", "course_key"),
        "instructors": teachers.withColumn("department_id", F.col("department_key").cast("string")).select("instructor_id", "department_id", "is_active"),
        "enrollments": enrollments.drop("l_orderkey", "l_linenumber"),
        "attendance": _raw_attendance(spark, sf),
    }


def _load_twice(spark, sf, folder: str, versions: bool = False) -> None:
    least = {"students": 1, "enrollments": 1, "attendance": 1}
    for before, as_of in ((FIRST_DELIVERY, date.fromisoformat(FIRST_DELIVERY)), (None, AS_OF)):
        loads.run(spark, _delivery(spark, sf, before), folder, as_of, minimums=least, versions=versions)


def _loaded(spark, sf) -> str:
    """Warehouse after two deliveries."""
    folder = staging.scratch_path(spark, "warehouse")
    _load_twice(spark, sf, folder)
    return folder


@query
def load_two_deliveries(spark, sf):
    """Rows and keys of every table after two loads into an empty warehouse."""
    folder = _loaded(spark, sf)
    student = spark.read.parquet(f"{folder}/dim_student")
    tables = {
        "dim_student": (student, "student_key"),
        "dim_student_current": (student.filter("is_current"), "student_id"),
        "fact_performance": (spark.read.parquet(f"{folder}/fact_performance"), "enrollment_id"),
        "fact_attendance": (spark.read.parquet(f"{folder}/fact_attendance"), "course_key"),
    }
    counted = [
        df.agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct(key).alias("keys")).withColumn("table_name", F.lit(name))
        for name, (df, key) in tables.items()
    ]
    merged = counted[0]
    for more in counted[1:]:
        merged = merged.unionByName(more)
    return merged


@query
def published_semester_gpa(spark, sf):
    """Semester GPA of both versions that two deliveries publish, each brought up to date from the semesters it touched."""
    folder = staging.scratch_path(spark, "versions")
    _load_twice(spark, sf, folder, versions=True)
    found = []
    for version in (1, 2):
        store = warehouse.Snapshot(spark, folder, version)
        people = store.read("dim_student", schemas.DIM_STUDENT).select("student_key", "student_id", "effective_date")
        owners = store.read("dim_department", schemas.DIM_DEPARTMENT).select("department_key", "department_id")
        rows = store.read("fact_semester_gpa", schemas.FACT_SEMESTER_GPA).join(people, "student_key").join(owners, "department_key")
        found.append(rows.drop("student_key", "department_key").withColumn("version", F.lit(version)))
    return found[0].unionByName(found[1])


def _refused(spark, sf) -> str:
    """Folder of a load that asks for more passed checks than there are."""
    folder = staging.scratch_path(spark, "refused")
    least = {"students": 1, "enrollments": 1, "attendance": 1}
    try:
        loads.run(spark, _delivery(spark, sf, None), folder, AS_OF, minimums=least, pass_rate=101.0)
    except quality.QualityGateError:
        return folder
    raise AssertionError("the delivery was not refused")


@query
def refused_delivery(spark, sf):
    """Run log of a refused delivery, with what lies in staging and in the warehouse."""
    folder = _refused(spark, sf)
    rows = spark.read.parquet(f"{folder}/etl_run_log").select("pipeline", "status", "rows_extracted", "rows_loaded", "rows_rejected")
    staged = spark.read.parquet(f"{folder}/stg_enrollments").agg(F.count("*").alias("staged_enrollments"))
    checks = spark.read.parquet(f"{folder}/data_quality_log").agg(F.count_distinct("table_name").alias("checked_tables"))
    merged = loads.existing(spark, f"{folder}/fact_performance", schemas.FACT_PERFORMANCE).agg(F.count("*").alias("merged_facts"))
    return rows.join(staged).join(checks).join(merged)


@query
def load_quarantine(spark, sf):
    """What a load sets aside: rejected registrations with their errors."""
    rows = spark.read.parquet(f"{_refused(spark, sf)}/stg_rejected_students")
    return rows.select("entity_type", "form_id", "student_id", "email", "validation_errors")


# --- governance on rows -------------------------------------------------------------------


@query
def student_lookup(spark, sf):
    """Point lookup of an id as typed, over ids that are stored in upper case."""
    stored = campus.students(spark, sf).withColumn("student_id", F.upper("student_id"))
    return students.by_id(stored, " customer#000000007 ").select("student_key", "student_id", "department_key")


@query
def department_scope_rows(spark, sf):
    """A department admin asks for department 5 and gets department 3, the one that is theirs."""
    rows = governance.department_scope(campus.students(spark, sf), who_department=3, asked=5)
    return rows.select("student_key", "department_key")


@query
def rls_student_portal(spark, sf):
    """Students in the portal see their own row only."""
    people = campus.students(spark, sf)
    accounts = people.select(F.lower("student_id").alias("username"), "student_id")
    return governance.visible_students(
        people, governance.Principal("customer#000000011", "STUDENT_PORTAL"), grants=_grants(spark, sf),
        departments=campus.departments(spark, sf), performance=campus.performance(spark, sf),
        instructors=campus.instructors(spark, sf), user_map=accounts,
    ).select("student_key", "student_id")


@query
def pii_inventory(spark, sf):
    """Tagged columns with their sensitivity and how many rows fill them."""
    tagged = governance.tag_pii(campus.students(spark, sf))
    columns = governance.pii_columns(tagged)
    counts = tagged.agg(*(F.count(c).alias(c) for c in columns))
    lines = [F.struct(F.lit(c).alias("column_name"), F.lit(level).alias("sensitivity"), F.col(c).alias("filled")) for c, level in columns.items()]
    return counts.select(F.inline(F.array(*lines)))


@query
def access_log(spark, sf):
    """What an admin's read of the visible students leaves in the access log, apart from its id and clock."""
    visible = governance.visible_students(
        campus.students(spark, sf), ADMIN, grants=_grants(spark, sf), departments=campus.departments(spark, sf),
        performance=campus.performance(spark, sf), instructors=campus.instructors(spark, sf),
    )
    rows, record = governance.audited(visible, ADMIN, "DIM_STUDENT", "department grants")
    staging.stage(rows, "visible-students")
    return record().select("session_user", "session_role", "table_name", "filter_context", "row_count")


@query
def scd2_null_hash(spark, sf):
    """The type-2 merge where part-time forms carry no hash: such rows can neither close nor repeat a version."""
    forms = campus.registrations(spark, sf)
    blank = F.when(F.col("student_type") != "Part-Time", F.col("row_hash"))
    first_load = _versions(forms.filter(F.col("enrollment_date") < FIRST_LOAD_BEFORE)).withColumns(
        {
            "row_hash": blank,
            "effective_date": F.lit(FIRST_LOAD_BEFORE).cast("date"),
            "expiry_date": F.lit(merge.OPEN_END),
            "is_current": F.lit(True),
        }
    )
    return merge.scd2(first_load, _versions(forms).withColumn("row_hash", blank), "student_id", AS_OF)
