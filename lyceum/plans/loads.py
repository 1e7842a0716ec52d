"""Fact rows from staging, dimension and fact merges, and the end-to-end load."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Mapping
from datetime import date, datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lyceum import schemas
from lyceum.functions import calendar, text
from lyceum.operators import cleaning, gpa, keys, merge, quality, ranking
from lyceum.plans import attendance as att
from lyceum.plans import gpa_refresh
from lyceum.sources import readers, sinks
from lyceum.sources.staging import scratch_run, stage
from lyceum.sources.warehouse import InPlace, Snapshot, Store, existing

log = logging.getLogger(__name__)

# Instructor key used when none is known, and columns a merge may change.
UNKNOWN_INSTRUCTOR = 1
PERFORMANCE_UPDATES = (
    "grade_letter", "grade_points", "quality_points", "attendance_pct", "overall_score", "midterm_score",
    "final_score", "is_passing", "is_withdrawn", "is_incomplete", "row_hash",
)
ATTENDANCE_KEYS = ["student_key", "course_key", "date_key"]
ATTENDANCE_UPDATES = ("status", "is_present", "is_excused", "minutes_late")
BACKFILL_KEYS = ["student_key", "course_key", *gpa.PERIOD]
FACT_PARTITIONS = ["academic_year", "semester"]
# How a load ended.
SUCCESS, REFUSED, FAILED = "SUCCESS", "REFUSED", "FAILED"


def enrollment_hash(rows: DataFrame) -> DataFrame:
    """Change hash of an enrollment; numbers enter as decimals so their text is engine-independent."""
    return rows.withColumn(
        "row_hash",
        text.row_digest(
            F.col("enrollment_id"),
            F.col("grade_letter"),
            F.col("attendance_pct").cast("decimal(9,2)"),
            F.col("final_score").cast("decimal(9,2)"),
        ),
    )


def performance_rows(
    enrollments: DataFrame, students: DataFrame, courses: DataFrame, instructors: DataFrame
) -> DataFrame:
    """Staged enrollments -> fact rows: valid rows only, surrogate keys, measures and hash."""
    flagged = quality.enrollment_flags(enrollments)
    valid = flagged.filter("v_has_student_id AND v_has_course_id AND v_valid_grade")
    known = students.filter("is_current").select("student_id", "student_key", "department_key")
    about = courses.select("course_id", "course_key", "credit_hours")
    staged = valid.drop("credit_hours").withColumns(
        {
            "attendance_pct": F.col("attendance_pct").try_cast("double"),
            "midterm_score": F.coalesce(F.col("midterm_score").try_cast("double"), F.lit(0.0)),
            "final_score": F.coalesce(F.col("final_score").try_cast("double"), F.lit(0.0)),
            "assignments_completed": F.coalesce(F.col("assignments_completed").try_cast("int"), F.lit(0)),
            "assignments_total": F.coalesce(F.col("assignments_total").try_cast("int"), F.lit(12)),
            "enrollment_date_key": calendar.date_key(calendar.parse_date(F.col("enrollment_date").cast("string"))),
        }
    )
    joined = staged.join(known, "student_id").join(about, "course_id")
    keyed = keys.lookup(joined, instructors, "instructor_id", "instructor_key", default=UNKNOWN_INSTRUCTOR)
    rows = enrollment_hash(cleaning.enrich_grades(keyed))
    return rows.select(*(F.col(f.name).cast(f.dataType) for f in schemas.FACT_PERFORMANCE.fields))


def default_instructor(instructors: DataFrame) -> int:
    """Smallest active instructor key; reads one row."""
    least = instructors.filter("is_active").agg(F.min("instructor_key")).first()[0]
    return UNKNOWN_INSTRUCTOR if least is None else least


def attendance_rows(raw: DataFrame, students: DataFrame, courses: DataFrame, instructor_key: int) -> DataFrame:
    """Staged attendance -> fact rows: valid weekday rows, one per student, course and day."""
    flagged = quality.attendance_flags(raw)
    valid = flagged.filter("v_has_student_id AND v_has_course_id AND v_valid_date AND v_valid_status AND v_is_weekday")
    rows = att.derive(valid.withColumn("attendance_date", calendar.parse_date(F.col("attendance_date").cast("string"))))
    known = students.filter("is_current").select("student_id", "student_key", "department_key")
    keyed = rows.join(known, "student_id").join(courses.select("course_id", "course_key"), "course_id")
    single = ranking.latest_per_key(
        keyed, ATTENDANCE_KEYS, [F.col("status").asc(), F.col("minutes_late").asc(), F.col("source_system").asc()]
    )
    return single.withColumn("instructor_key", F.lit(instructor_key)).select(
        *(F.col(f.name).cast(f.dataType) for f in schemas.FACT_ATTENDANCE.fields)
    )


def merge_performance(target: DataFrame, source: DataFrame, *, insert: bool = True) -> DataFrame:
    """Upsert on the enrollment id where the hash differs."""
    return merge.upsert(target, source, ["enrollment_id"], update=PERFORMANCE_UPDATES, changed=("row_hash",), insert=insert)


def merge_attendance(target: DataFrame, source: DataFrame, *, update: bool = True) -> DataFrame:
    """Upsert where the status differs, or insert only."""
    if not update:
        return merge.insert_new(target, source, ATTENDANCE_KEYS)
    return merge.upsert(target, source, ATTENDANCE_KEYS, update=ATTENDANCE_UPDATES, changed=("status",))


def upsert_attendance_table(spark: SparkSession, path: str, incoming: DataFrame) -> None:
    """Upsert rows (one per key) into the attendance table, which is partitioned by day.

    The day is part of the key, so only the days of the delivery are read, merged and overwritten.
    """
    sinks.overwrite_partitions(attendance_of_days(existing(spark, path, schemas.FACT_ATTENDANCE), incoming), path, ["date_key"])


def attendance_of_days(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored and incoming rows of the days of the delivery, merged."""
    new = stage(incoming, "attendance-incoming")
    return merge_attendance(touched_days(stored, new), new)


def touched_days(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored rows on the days of ``new``.  The days are literals (at most one per partition), so the scan opens
    their partitions only."""
    days = [r[0] for r in new.select("date_key").distinct().collect()]
    return stored.filter(F.col("date_key").isin(days)).select(*schemas.FACT_ATTENDANCE.names)


def _among(column: str, values: list) -> Column:
    """``column`` is one of ``values``.  A missing or empty value stands in the partition of NULL."""
    same = F.coalesce(F.col(column).isin([v for v in values if v is not None]), F.lit(False))
    return same | F.col(column).isNull() if None in values or "" in values else same


def touched_semesters(stored: DataFrame, touched: DataFrame) -> DataFrame:
    """Stored rows of the semesters in ``touched`` (at most one row per partition), as literals too."""
    names = [r[0] for r in touched.select("semester").distinct().collect()]
    years = [r[0] for r in touched.select("academic_year").distinct().collect()]
    chosen = stored.filter(_among("semester", names) & _among("academic_year", years))
    return chosen.select(*schemas.FACT_PERFORMANCE.names)


def dated(attendance: DataFrame) -> DataFrame:
    """Attendance facts with the labels of their semester."""
    day = F.to_date(F.col("date_key").cast("string"), "yyyyMMdd")
    return attendance.withColumns(calendar.term_labels(calendar.term_key(day)))


def upsert_performance_table(
    spark: SparkSession, path: str, incoming: DataFrame, attendance: DataFrame, days: DataFrame
) -> None:
    """Upsert enrollments and bring their attendance up to date, in the semesters concerned only.

    Those are the semesters of the incoming rows that are new or differ from the stored ones, the semesters in which
    their ids are already stored (found by a scan of four columns) and the semesters of the attendance ``days`` that
    were loaded.  The table is partitioned by semester; other partitions are not touched.
    """
    stored = existing(spark, path, schemas.FACT_PERFORMANCE)
    sinks.overwrite_partitions(performance_of_semesters(stored, incoming, attendance, days)[0], path, FACT_PARTITIONS)


def performance_of_semesters(
    stored: DataFrame, incoming: DataFrame, attendance: DataFrame, days: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Stored and incoming enrollments of the semesters concerned, merged, and these semesters."""
    new = stage(changed_rows(stored, incoming), "performance-incoming")
    known = new.filter("_known").select(*(F.col(f"_{c}").alias(c) for c in FACT_PARTITIONS))
    new_parts = new.select(*FACT_PARTITIONS).distinct()
    touched = stage(known.distinct().union(new_parts).union(dated(days.distinct()).select(*FACT_PARTITIONS)).distinct(), "semesters-touched")
    current = touched_semesters(stored, touched)
    # Attendance of a semester without enrollments has nothing to bring up to date.
    enrolled = stage(current.select(*FACT_PARTITIONS).distinct().union(new_parts).distinct(), "semesters-enrolled")
    recorded = dated(attendance)
    for semesters in (touched, enrolled):
        recorded = _of_semesters(recorded, semesters)
    actual = stage(att.student_course_pct(recorded), "attendance-pct")
    columns = schemas.FACT_PERFORMANCE.names
    # Most of a delivery is new or as stored; staged apart, few updates are broadcast and no stored row is shuffled.
    updates = stage(new.filter("_known").select(*columns), "performance-updates")
    inserts = new.filter(~F.col("_known")).select(*columns)
    merged = merge_performance(current, updates, insert=False).unionByName(inserts)
    return _backfill(merged, actual), touched


def changed_rows(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows that a merge would insert or update, with whether their id is stored (``_known``) and its semester there.

    A delivery repeats what earlier ones brought; rows with the stored hash change nothing, so their semesters stay closed.
    """
    there = stored.select(
        F.col("enrollment_id").alias("_id"), F.col("row_hash").alias("_hash"), *(F.col(c).alias(f"_{c}") for c in FACT_PARTITIONS)
    )
    met = incoming.join(there, F.col("enrollment_id") == F.col("_id"), "left").withColumn("_known", F.col("_id").isNotNull())
    return met.filter(~F.col("_known") | F.coalesce(F.col("row_hash") != F.col("_hash"), F.lit(False))).drop("_id", "_hash")


def _of_semesters(rows: DataFrame, semesters: DataFrame) -> DataFrame:
    left, right = rows.alias("a"), semesters.alias("s")
    return left.join(right, [F.col(f"a.{c}").eqNullSafe(F.col(f"s.{c}")) for c in FACT_PARTITIONS], "left_semi")


def backfill_attendance(performance: DataFrame, attendance: DataFrame) -> DataFrame:
    """Replace the attendance percentage of enrollments by what the attendance records say."""
    return _backfill(performance, att.student_course_pct(attendance))


def _backfill(performance: DataFrame, actual: DataFrame) -> DataFrame:
    return merge.update_from(performance, actual, BACKFILL_KEYS, {"attendance_pct": "actual_pct"})


def refresh_semester_gpa(performance: DataFrame) -> DataFrame:
    """FACT_SEMESTER_GPA with its running GPA."""
    return gpa.cumulative_gpa(gpa.semester_gpa(performance))


def from_raw_enrollments(enrollments: DataFrame) -> DataFrame:
    """Raw enrollments to semester and running GPA per student id."""
    graded = cleaning.enrich_grades(enrollments)
    semesters = gpa.semester_scores(graded, ["student_id", *gpa.PERIOD])
    return gpa.cumulative_gpa(semesters, student="student_id")


def run(
    spark: SparkSession,
    raw: Mapping[str, DataFrame],
    warehouse: str,
    as_of: date,
    *,
    minimums: Mapping[str, int] | None = None,
    pass_rate: float | None = None,
    versions: bool = False,
) -> dict[str, int]:
    """Load one delivery: clean, check, stage, merge dimensions and facts, refresh the aggregate.

    ``raw`` holds students, courses, instructors, departments, enrollments and attendance.  Each
    table is written once and read back by the steps after it, so no step recomputes another.
    Returns the row count of every table written.  What is staged on the way is removed at the end.

    With ``pass_rate`` a delivery of which fewer percent of all checks pass is refused after staging and before any merge.
    A refused delivery and a failed load leave a row in the run log.  With ``versions`` all dimensions and facts become visible
    together at the end (``sources.warehouse.Snapshot``).
    """
    store: Store = Snapshot(spark, warehouse) if versions else InPlace(spark, warehouse)
    run_id, started = str(uuid.uuid4()), datetime.now(timezone.utc)
    counts: dict[str, int] = {}

    def log_run(status: str) -> None:
        finished = datetime.now(timezone.utc)
        record = sinks.run_record(
            spark, run_id, "full_load", status, f"{started:%Y-%m-%d %H:%M:%S}", f"{finished:%Y-%m-%d %H:%M:%S}",
            extracted=counts.get("stg_students", 0) + counts.get("rejected", 0),
            loaded=sum(v for k, v in counts.items() if k.startswith(("dim_", "fact_"))) if status == SUCCESS else 0,
            rejected=counts.get("rejected", 0),
        )
        sinks.append_rows(record, f"{warehouse}/etl_run_log")

    with scratch_run(spark):
        try:
            _run(spark, raw, warehouse, store, as_of, run_id, counts, minimums, pass_rate)
            store.publish()
        except quality.QualityGateError:
            log_run(REFUSED)
            raise
        except Exception:
            log_run(FAILED)
            raise
        log_run(SUCCESS)
    log.info("load %s finished: %s", run_id, counts)
    return counts


def _run(
    spark: SparkSession, raw: Mapping[str, DataFrame], warehouse: str, store: Store, as_of: date, run_id: str,
    counts: dict[str, int], minimums: Mapping[str, int] | None, pass_rate: float | None,
) -> None:
    least = {"students": 100, "enrollments": 500, "attendance": 1000, **(minimums or {})}
    # The large extracts are parsed once; checks, staging tables and facts read the copy.
    raw = {**raw, "attendance": stage(raw["attendance"], "landed-attendance")}

    order = [c for c in ("arrival", "enrollment_date", "email") if c in raw["students"].columns]
    checked = stage(cleaning.check_students(raw["students"], order, as_of), "checked-students")
    clean, bad = stage(cleaning.accepted(checked), "clean-students"), cleaning.rejected(checked)
    report = stage(quality.validate_students(clean, least["students"]), "student-report")
    sinks.append_rows(quality.quality_log(report, "STG_STUDENTS", run_id), f"{warehouse}/data_quality_log")
    reports = [report]
    raw["enrollments"] = _landed(spark, raw["enrollments"], warehouse, "enrollments", counts)
    for name, lines in (
        ("STG_ENROLLMENTS", quality.validate_enrollments(raw["enrollments"], clean, least["enrollments"])),
        ("STG_ATTENDANCE", quality.validate_attendance(raw["attendance"], least["attendance"])),
    ):
        reports.append(stage(lines, "report"))
        sinks.append_rows(quality.quality_log(reports[-1], name, run_id), f"{warehouse}/data_quality_log")

    staged = {"students": clean, **{k: raw[k] for k in ("courses", "instructors", "attendance")}}
    for entity, rows in staged.items():
        counts[f"stg_{entity}"] = sinks.load_staging(rows, warehouse, entity, source_file=entity)
    counts["rejected"] = sinks.load_rejected(bad, warehouse, "students")
    # Staged rows and the quarantine stay for inspection; nothing below runs for a delivery that is refused.
    quality.require_no_failure(report, "STG_STUDENTS")
    if pass_rate is not None and not quality.gate(reduce(DataFrame.unionByName, reports), pass_rate):
        raise quality.QualityGateError(f"run {run_id} passed less than {pass_rate} % of its checks")

    def numbered(name: str, schema: StructType, incoming: DataFrame, natural: str, key: str) -> DataFrame:
        old = store.read(name, schema)
        fresh = incoming.join(old.select(natural), natural, "left_anti")
        shaped = fresh.select(
            *(
                (F.col(f.name) if f.name in fresh.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in schema.fields
            )
        )
        counts[name] = store.replace(name, keys.append_with_keys(old, shaped.drop(key), [natural], key))
        return store.read(name, schema)

    departments = numbered(
        "dim_department", schemas.DIM_DEPARTMENT, raw["departments"], "department_id", "department_key"
    )
    dept = departments.select("department_id", "department_key")
    courses = numbered("dim_course", schemas.DIM_COURSE, raw["courses"].join(dept, "department_id"), "course_id", "course_key")
    instructors = numbered(
        "dim_instructor", schemas.DIM_INSTRUCTOR, raw["instructors"].join(dept, "department_id"),
        "instructor_id", "instructor_key",
    )
    students = _load_students(store, clean.join(dept, "department_id"), as_of, counts)

    present = stage(
        attendance_rows(raw["attendance"], students, courses, default_instructor(instructors)), "attendance-rows"
    )
    stored = store.read("fact_attendance", schemas.FACT_ATTENDANCE)
    store.overwrite("fact_attendance", attendance_of_days(stored, present), ["date_key"])
    attendance = store.read("fact_attendance", schemas.FACT_ATTENDANCE)
    counts["fact_attendance"] = attendance.count()

    incoming = performance_rows(raw["enrollments"], students, courses, instructors)
    stored = store.read("fact_performance", schemas.FACT_PERFORMANCE)
    merged, touched = performance_of_semesters(stored, incoming, attendance, present.select("date_key").distinct())
    store.overwrite("fact_performance", merged, FACT_PARTITIONS)
    facts = store.read("fact_performance", schemas.FACT_PERFORMANCE)
    counts["fact_performance"] = facts.count()
    counts["fact_semester_gpa"] = gpa_refresh.refresh(store, facts, touched)


def _landed(spark: SparkSession, rows: DataFrame, warehouse: str, entity: str, counts: dict[str, int]) -> DataFrame:
    """``rows`` of an entity whose staging table is replaced by a delivery, as read back from that table."""
    table = f"stg_{entity}"
    if any(f"/{table}/" in f for f in rows.inputFiles()):  # never over the files that are read
        rows = stage(rows, f"landed-{entity}")
    counts[table] = sinks.load_staging(rows, warehouse, entity, source_file=entity)
    return spark.read.schema(rows.schema).parquet(f"{warehouse}/{table}")


def _load_students(store: Store, clean: DataFrame, as_of: date, counts: dict[str, int]) -> DataFrame:
    """Type-2 merge of the student dimension; new versions get keys after the highest one."""
    schema = schemas.DIM_STUDENT
    old = store.read("dim_student", schema)
    attributes = [f.name for f in schema.fields if f.name not in ("student_key", *merge.VALIDITY)]
    source = clean.select(*attributes).withColumn("student_key", F.lit(None).cast("bigint"))
    state = stage(merge.scd2(old, source, "student_id", as_of), "dim-student")
    kept = state.filter(F.col("student_key").isNotNull())
    fresh = state.filter(F.col("student_key").isNull()).drop("student_key")
    result = keys.append_with_keys(kept, fresh, ["student_id"], "student_key")
    counts["dim_student"] = store.replace("dim_student", result.select(*schema.names))
    return store.read("dim_student", schema)


def read_extracts(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """CSV extracts of one delivery, one file or folder per entity."""
    landed = {
        "students": schemas.as_landed(schemas.RAW_STUDENTS),
        "enrollments": schemas.RAW_ENROLLMENTS,
        "courses": schemas.RAW_COURSES,
        "instructors": schemas.RAW_INSTRUCTORS,
        "attendance": schemas.RAW_ATTENDANCE,
        "departments": schemas.RAW_DEPARTMENTS,
    }
    return {name: readers.read_csv(spark, f"{folder}/{name}*", schema) for name, schema in landed.items()}
