from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from lyceum import jobs, schemas
from lyceum.operators.quality import QualityGateError
from lyceum.plans import loads, views
from lyceum.sources import date_dim, sinks

AS_OF = date(2024, 10, 1)
SMALL = {"students": 3, "enrollments": 3, "attendance": 3}


def students(spark, **changes):
    base = [
        ["STU000001", "ann", "lee", "ann@u.edu", "2004-01-01", "Female", "Irish", "2023-09-01", "BSc", "Maths", "CS001", "Full-Time", "True", "100"],
        ["STU000002", "bob", "ray", "bob@u.edu", "2003-01-01", None, "Irish", "2023-09-01", "BSc", "Maths", "BA001", "Part-Time", "no", "x"],
        ["STU000003", "cyd", "fox", "cyd@u.edu", "2002-01-01", "Male", "Irish", "2023-09-01", "BSc", "Maths", "CS001", "Full-Time", "1", "7"],
        ["STU000004", "dan", "bad", "nobody", "2002-01-01", "Male", "Irish", "2023-09-01", "BSc", "Maths", "CS001", "Full-Time", "1", "7"],
    ]
    for row in base:
        if row[0] in changes:
            row[9] = changes[row[0]]
    return spark.createDataFrame(base, schemas.as_landed(schemas.RAW_STUDENTS))


def delivery(spark, grade="A", status="ABSENT", **changes):
    return {
        "students": students(spark, **changes),
        "departments": spark.createDataFrame([("CS001", "Computing", "Eng"), ("BA001", "Business", "Biz")], schemas.RAW_DEPARTMENTS),
        "courses": spark.createDataFrame(
            [("CRS0001", "CS1", "Intro", 4, "UG", "Core", "CS001", True), ("CRS0002", "BA1", "Money", 3, "UG", "Core", "BA001", True)],
            schemas.RAW_COURSES,
        ),
        "instructors": spark.createDataFrame(
            [("INS0001", "I", "J", "i@u.edu", "Prof", "Tenured", "CS001", "2010-01-01", True)], schemas.RAW_INSTRUCTORS
        ),
        "enrollments": spark.createDataFrame(
            [
                ("E1", "STU000001", "CRS0001", "INS0001", "Fall 2024", "2024-2025", "2024-09-01", grade, None, 90.0, 5, 12, 80.0, 90.0),
                ("E2", "STU000001", "CRS0002", "INS9999", "Fall 2024", "2024-2025", "2024-09-01", "C", None, 70.0, 5, 12, 60.0, 50.0),
                ("E3", "STU000002", "CRS0002", None, "Fall 2024", "2024-2025", "2024-09-01", "W", 0.0, 20.0, 0, 12, None, None),
                ("E4", "STU000002", "CRS0077", "INS0001", "Fall 2024", "2024-2025", "2024-09-01", "B", None, 20.0, 0, 12, None, None),
                ("E5", "STU000003", "CRS0001", "INS0001", "Fall 2024", "2024-2025", "2024-09-01", "??", None, 20.0, 0, 12, None, None),
            ],
            schemas.RAW_ENROLLMENTS,
        ),
        "attendance": spark.createDataFrame(
            [
                ("STU000001", "CRS0001", "2024-09-02", "PRESENT", "LMS", 0),
                ("STU000001", "CRS0001", "2024-09-03", status, None, None),
                ("STU000001", "CRS0001", "2024-09-07", "PRESENT", "LMS", 0),
                ("STU000002", "CRS0002", "2024-09-02", "LATE", "RFID", 6),
            ],
            schemas.RAW_ATTENDANCE,
        ),
    }


def read(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}")


def test_full_load_and_reload(spark, tmp_path):
    folder = str(tmp_path / "warehouse")
    counts = loads.run(spark, delivery(spark), folder, AS_OF, minimums=SMALL)
    assert {k: counts[k] for k in ("stg_students", "rejected", "dim_student", "dim_course", "fact_performance", "fact_attendance", "fact_semester_gpa")} == {
        # E4 has an unknown course and E5 an unknown grade; the Saturday record is not loaded.
        "stg_students": 3, "rejected": 1, "dim_student": 3, "dim_course": 2, "fact_performance": 3, "fact_attendance": 3, "fact_semester_gpa": 1,
    }
    facts = {r["enrollment_id"]: r for r in read(spark, folder, "fact_performance").collect()}
    assert (facts["E1"]["quality_points"], facts["E1"]["credit_hours"], facts["E1"]["is_passing"]) == (16.0, 4, True)
    assert facts["E1"]["attendance_pct"] == 50.0 and facts["E2"]["attendance_pct"] == 70.0
    assert facts["E2"]["instructor_key"] == 1 and facts["E3"]["grade_points"] is None
    gpa = read(spark, folder, "fact_semester_gpa").first()
    assert (gpa["semester_gpa"], gpa["cumulative_gpa"]) == (round((16 + 6) / 7, 3),) * 2

    # The same delivery again changes nothing.
    again = loads.run(spark, delivery(spark), folder, AS_OF, minimums=SMALL)
    assert {k: v for k, v in again.items() if k.startswith(("dim_", "fact_"))} == {
        k: v for k, v in counts.items() if k.startswith(("dim_", "fact_"))
    }

    # A changed student, grade and attendance status.
    later = date(2024, 11, 1)
    loads.run(spark, delivery(spark, grade="B", status="EXCUSED", STU000002="Law"), folder, later, minimums=SMALL)
    versions = read(spark, folder, "dim_student").filter("student_id = 'STU000002'").orderBy("effective_date").collect()
    assert [(r["major"], r["is_current"], r["expiry_date"]) for r in versions] == [
        ("Maths", False, later), ("Law", True, date(9999, 12, 31)),
    ]
    assert len({r["student_key"] for r in read(spark, folder, "dim_student").collect()}) == 4
    assert {r["grade_letter"] for r in read(spark, folder, "fact_performance").filter("enrollment_id = 'E1'").collect()} == {"B"}
    statuses = read(spark, folder, "fact_attendance").filter("date_key = 20240903").collect()
    assert [(r["status"], r["is_excused"], r["source_system"]) for r in statuses] == [("EXCUSED", True, "UNKNOWN")]
    assert read(spark, folder, "etl_run_log").count() == 3
    assert read(spark, folder, "stg_rejected_students").count() == 3
    assert read(spark, folder, "data_quality_log").select("table_name").distinct().count() == 3


def test_a_failed_student_suite_stops_the_load(spark, tmp_path):
    with pytest.raises(QualityGateError, match="min_row_count"):
        loads.run(spark, delivery(spark), str(tmp_path / "w"), AS_OF)
    assert not (tmp_path / "w" / "dim_student").exists()


def test_extracts_are_read_from_a_folder(spark, tmp_path):
    for name, df in delivery(spark).items():
        df.write.option("header", True).csv(str(tmp_path / name))
    raw = loads.read_extracts(spark, str(tmp_path))
    assert {k: v.count() for k, v in raw.items()} == {
        "students": 4, "departments": 2, "courses": 2, "instructors": 1, "enrollments": 5, "attendance": 4,
    }
    assert raw["enrollments"].schema == schemas.RAW_ENROLLMENTS


def test_raw_enrollments_to_running_gpa(spark):
    out = loads.from_raw_enrollments(delivery(spark)["enrollments"].withColumn("credit_hours", F.lit(3)))
    row = {r["student_id"]: r for r in out.collect()}["STU000001"]
    assert (row["semester_gpa"], row["midterm_avg"], row["final_avg"], row["cumulative_gpa"]) == (3.0, 70.0, 70.0, 3.0)


def test_jobs_and_views_run_on_a_loaded_warehouse(spark, tmp_path):
    folder = str(tmp_path / "warehouse")
    loads.run(spark, delivery(spark), folder, AS_OF, minimums=SMALL)
    assert jobs.semester_job(spark, folder) == 1
    assert jobs.department_job(spark, folder) == {"department_metrics": 1, "course_difficulty": 2}
    ranked = read(spark, folder, "fact_semester_gpa_ranked").first()
    assert (ranked["dept_gpa_rank"], ranked["class_gpa_rank"]) == (1, 1)
    metrics = read(spark, folder, "department_metrics").first()
    assert (metrics["department_name"], metrics["courses_taken"], metrics["enrolled_students"]) == ("Computing", 2, 1)
    names = views.publish(
        read(spark, folder, "fact_semester_gpa"), read(spark, folder, "fact_attendance"), read(spark, folder, "dim_student"),
        read(spark, folder, "dim_department"), date_dim.date_dim(spark),
    )
    counts = {n: spark.table(n).count() for n in names}
    assert counts == {
        "v_attendance_summary": 2, "v_at_risk_students": 0, "v_probation_candidates": 0, "v_scholarship_at_risk": 1,
    }
    computing = spark.sql("SELECT * FROM v_attendance_summary WHERE department_name = 'Computing'").first()
    assert (computing["total_records"], computing["attendance_rate_pct"], computing["month_name"]) == (2, 50.0, "September")


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "fact")
    names = schemas.FACT_ATTENDANCE.names
    base = dict(zip(names, (1, 1, 1, 1, 20240902, "ABSENT", False, False, 0, "LMS")))

    def rows(*changes):
        return spark.createDataFrame([[{**base, **c}[n] for n in names] for c in changes], schemas.FACT_ATTENDANCE)

    def files(day):
        return {f.name for f in (tmp_path / "fact" / f"date_key={day}").glob("*.parquet")}

    loads.upsert_attendance_table(spark, path, rows({}, {"date_key": 20240903}))
    first, second = files(20240902), files(20240903)
    loads.upsert_attendance_table(spark, path, rows({"date_key": 20240903, "status": "EXCUSED", "is_excused": True}))
    assert files(20240902) == first and files(20240903) != second
    assert spark.read.parquet(path).count() == 2


def test_an_enrollment_stays_in_the_semester_it_was_stored_in(spark, tmp_path):
    path = str(tmp_path / "fact")
    row = dict(
        enrollment_id="E1", student_key=1, course_key=1, academic_year="2024-2025", semester="Fall 2024",
        grade_letter="A", attendance_pct=80.0, row_hash="x",
    )

    def facts(**changes):
        values = {**row, **changes}
        return spark.createDataFrame([[values.get(n) for n in schemas.FACT_PERFORMANCE.names]], schemas.FACT_PERFORMANCE)

    none = spark.createDataFrame([], schemas.FACT_ATTENDANCE)
    for change in ({}, {"semester": "Spring 2025", "grade_letter": "B", "row_hash": "y"}):
        loads.upsert_performance_table(spark, path, facts(**change), none, none.select("date_key"))
    stored = loads.existing(spark, path, schemas.FACT_PERFORMANCE).collect()
    assert [(r["enrollment_id"], r["semester"], r["grade_letter"]) for r in stored] == [("E1", "Fall 2024", "B")]


@pytest.mark.parametrize("semester, year", [(None, "2024-2025"), ("Fall 2024", None), (None, None), ("", "2024-2025")])
def test_facts_without_a_semester_outlast_the_next_delivery(spark, tmp_path, semester, year):
    path = str(tmp_path / "fact")

    def facts(*ids):
        rows = [dict(enrollment_id=i, student_key=1, course_key=1, academic_year=year, semester=semester, row_hash="x") for i in ids]
        return spark.createDataFrame([[r.get(n) for n in schemas.FACT_PERFORMANCE.names] for r in rows], schemas.FACT_PERFORMANCE)

    none = spark.createDataFrame([], schemas.FACT_ATTENDANCE)
    for ids in (("E1", "E2"), ("E2", "E3")):
        loads.upsert_performance_table(spark, path, facts(*ids), none, none.select("date_key"))
    stored = loads.existing(spark, path, schemas.FACT_PERFORMANCE).collect()
    assert sorted(r["enrollment_id"] for r in stored) == ["E1", "E2", "E3"]


def test_only_a_missing_table_counts_as_empty(spark, tmp_path):
    assert loads.existing(spark, str(tmp_path / "none"), schemas.FACT_ATTENDANCE).isEmpty()
    with pytest.raises(Exception):
        loads.existing(spark, "nosuchscheme://x/y", schemas.FACT_ATTENDANCE).count()


def test_rows_as_stored_open_no_semester(spark, tmp_path):
    path = str(tmp_path / "fact")

    def facts(*changes):
        base = dict(student_key=1, course_key=1, academic_year="2024-2025", semester="Fall 2024", final_score=5.0, row_hash="x")
        return spark.createDataFrame([[{**base, **c}.get(n) for n in schemas.FACT_PERFORMANCE.names] for c in changes], schemas.FACT_PERFORMANCE)

    one, two = {"enrollment_id": "E1"}, {"enrollment_id": "E2", "semester": "Spring 2025"}
    none = loads.existing(spark, str(tmp_path / "none"), schemas.FACT_ATTENDANCE)
    days = none.select("date_key")
    loads.upsert_performance_table(spark, path, facts(one, two), none, days)
    stored = loads.existing(spark, path, schemas.FACT_PERFORMANCE)
    same, touched = loads.performance_of_semesters(stored, facts(one, two), none, days)
    assert same.isEmpty() and touched.isEmpty()
    # An update takes a value that became NULL, and an overwrite may read the partitions it replaces.
    changed = facts(one, {**two, "row_hash": "y", "final_score": None}, {"enrollment_id": "E3", "semester": "Spring 2025"})
    merged, touched = loads.performance_of_semesters(stored, changed, none, days)
    assert [r["semester"] for r in touched.collect()] == ["Spring 2025"]
    sinks.overwrite_partitions(merged, path, loads.FACT_PARTITIONS)
    after = loads.existing(spark, path, schemas.FACT_PERFORMANCE).select("enrollment_id", "row_hash", "final_score").collect()
    assert sorted(map(tuple, after)) == [("E1", "x", 5.0), ("E2", "y", None), ("E3", "x", 5.0)]
