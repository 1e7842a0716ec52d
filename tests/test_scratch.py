from __future__ import annotations

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lyceum import schemas
from lyceum.operators import quality
from lyceum.plans import loads, overview, students
from lyceum.sources import staging


def left_behind(spark) -> set[str]:
    folder = f"{staging.shared_folder(spark)}/lyceum"
    return {name for name in os.listdir(folder) if name.startswith("run-")} if os.path.isdir(folder) else set()


def test_a_run_removes_what_it_staged(spark):
    with staging.scratch_run(spark) as folder:
        kept = staging.stage(spark.range(5), "five")
        with staging.scratch_run(spark) as inner:
            assert inner == folder
        assert kept.count() == 5 and left_behind(spark)
    assert not left_behind(spark)


def test_an_error_leaves_nothing_behind(spark):
    with pytest.raises(ValueError), staging.scratch_run(spark):
        staging.stage(spark.range(5), "five")
        raise ValueError
    assert not left_behind(spark)


def stored(spark, path, schema, rows, by):
    spark.createDataFrame(rows, schema).write.partitionBy(*by).parquet(path)
    return spark.read.schema(schema).parquet(path)


def filters(df) -> str:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("PartitionFilters: [")[1].split("]")[0]


def test_loads_open_the_partitions_of_a_delivery_only(spark, tmp_path):
    days = [(1, 1, 1, 1, day, "ABSENT", False, False, 0, "LMS") for day in (20240901, 20240902, 20240903)]
    attendance = stored(spark, str(tmp_path / "a"), schemas.FACT_ATTENDANCE, days, ["date_key"])
    touched = loads.touched_days(attendance, attendance.filter("date_key = 20240902"))
    assert touched.count() == 1 and "20240902" in filters(touched) and "20240901" not in filters(touched)

    def row(year, term):
        values = {"enrollment_id": term, "academic_year": year, "semester": term}
        return tuple(values.get(f.name) for f in schemas.FACT_PERFORMANCE)

    rows = [row("2023-2024", "Spring 2024"), row("2024-2025", "Fall 2024")]
    facts = stored(spark, str(tmp_path / "p"), schemas.FACT_PERFORMANCE, rows, loads.FACT_PARTITIONS)
    chosen = loads.touched_semesters(facts, facts.filter("semester = 'Fall 2024'"))
    assert [r.semester for r in chosen.collect()] == ["Fall 2024"]
    assert "Fall 2024" in filters(chosen) and "Spring 2024" not in filters(chosen)


def test_superseded_students_take_no_rank(spark):
    semesters = spark.createDataFrame(
        [(1, 7, "2024-2025", "Fall 2024", 4.0, 4.0, 12, 90.0), (2, 7, "2024-2025", "Fall 2024", 3.0, 3.0, 12, 90.0)],
        "student_key long, department_key long, academic_year string, semester string, semester_gpa double, cumulative_gpa double, credit_hours_earned long, avg_attendance_pct double",
    )
    people = spark.createDataFrame(
        [(1, "S1", "a", "b", "p", "m", False), (2, "S1", "a", "b", "p", "m", True)],
        "student_key long, student_id string, first_name string, last_name string, program string, major string, is_current boolean",
    )
    names = spark.createDataFrame([(7, "D7", "C")], "department_key long, department_name string, college string")
    rows = students.top_by_department(semesters, people, names).collect()
    assert [(r.dept_rank, r.overall_rank, r.performance_tier) for r in rows] == [(1, 1, "Top of Department")]


def test_calendar_and_heat_map_follow_the_data(spark, tmp_path):
    from lyceum.queries import REGISTRY

    orders = [(k, datetime(year, 5, 17)) for k, year in enumerate((1990, 1998, 2030))]
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp_ntz").write.parquet(str(tmp_path / "orders.parquet"))
    days = REGISTRY["orders_by_calendar"](spark, str(tmp_path))
    got = {r.year for r in days.filter(F.col("enrollments") > 0).select("year").collect()}
    assert got == {1990, 1998, 2030} and days.agg(F.sum("enrollments")).first()[0] == 3
    cells = spark.createDataFrame([("A", "Fall 1990", 80.0), ("B", "Fall 2030", 70.0)], "department_id string, semester string, attendance double")
    assert set(overview.heatmap_grid(cells).columns) == {"department_id", "Fall 1990", "Fall 2030"}


def test_a_suite_scans_its_input_once(spark, tmp_path):
    spark.createDataFrame([("S1", "a@b", "x", "Full-Time")], "student_id string, email string, department_id string, student_type string").write.parquet(str(tmp_path / "s"))
    lines = quality.report(spark.read.parquet(str(tmp_path / "s")), quality.students_suite(1))
    assert lines._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert {r.result for r in lines.collect()} == {"PASS"}
