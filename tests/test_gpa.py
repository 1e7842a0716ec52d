from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lyceum.functions import grades
from lyceum.operators import cleaning, gpa
from lyceum.plans import departments, students

PERFORMANCE = """student_key long, department_key long, academic_year string, semester string, grade_points double,
 credit_hours int, quality_points double, attendance_pct double, is_passing boolean, is_withdrawn boolean,
 is_incomplete boolean"""
FALL, SPRING = ("2024-2025", "Fall 2024"), ("2023-2024", "Spring 2024")


@pytest.fixture(scope="module")
def performance(spark):
    rows = [
        (1, 10, *FALL, 4.0, 4, 16.0, 97.0, True, False, False),
        (1, 10, *FALL, 3.3, 2, 6.6, 81.0, True, False, False),
        (1, 10, *FALL, None, 3, None, 50.0, False, False, False),  # audited
        (2, 10, *FALL, 2.3, 3, 6.9, 70.0, True, False, False),
        (2, 10, *FALL, 2.7, 3, 8.1, 74.0, True, False, False),
        (2, 10, *FALL, None, 3, None, 30.0, False, True, False),
        (3, 20, *FALL, 2.3, 3, 6.9, 60.0, True, False, False),  # ties with student 2
        (3, 20, *FALL, 2.7, 3, 8.1, 66.0, True, False, False),
        (3, 20, *FALL, 0.0, 0, 0.0, 10.0, False, False, False),  # no credits
        (1, 10, *SPRING, 3.0, 3, 9.0, 90.0, True, False, False),
    ]
    return spark.createDataFrame(rows, PERFORMANCE)


def by_student(df, semester="Fall 2024"):
    return {r["student_key"]: r for r in df.filter(F.col("semester") == semester).collect()}


def test_withdrawn_and_audited_rows_do_not_count(performance):
    rows = by_student(gpa.semester_gpa(performance))
    assert {k: r["courses_taken"] for k, r in rows.items()} == {1: 2, 2: 2, 3: 3}


def test_semester_gpa_is_credit_weighted(performance):
    rows = by_student(gpa.semester_gpa(performance))
    assert {k: r["semester_gpa"] for k, r in rows.items()} == {1: 3.767, 2: 2.5, 3: 2.5}


def test_earned_and_attempted_credits(performance):
    row = by_student(gpa.semester_gpa(performance))[3]
    assert (row["credit_hours_earned"], row["credit_hours_attempted"]) == (6, 6)


def test_attendance_mean(performance):
    assert by_student(gpa.semester_gpa(performance))[1]["avg_attendance_pct"] == 89.0


def test_two_step_sums_equal_one_step(performance):
    fine = gpa.credit_sums(performance, [*gpa.SEMESTER_KEYS, "attendance_pct"])
    two = gpa.finish(gpa.combine(fine, gpa.SEMESTER_KEYS), gpa.SEMESTER_KEYS)
    assert sorted(two.collect()) == sorted(gpa.semester_gpa(performance).collect())


def test_running_gpa_follows_the_academic_year(performance):
    rows = by_student(gpa.cumulative_gpa(gpa.semester_gpa(performance)))
    assert rows[1]["cumulative_gpa"] == pytest.approx((3.0 * 3 + 3.767 * 6) / 9, abs=5e-4)


def test_ranks_start_at_one(performance):
    ranked = by_student(students.semester_ranks(gpa.semester_gpa(performance)))
    assert {k: r["class_gpa_rank"] for k, r in ranked.items()} == {1: 1, 2: 2, 3: 2}
    assert {k: r["dept_gpa_rank"] for k, r in ranked.items()} == {1: 1, 2: 2, 3: 1}


def test_department_pass_counts(spark, performance):
    names = spark.createDataFrame([(10, "CS", "Eng"), (20, "BA", "Biz")], "department_key long, department_name string, college string")
    rows = performance.withColumn("grade_letter", F.when(F.col("grade_points") == 0, "F").otherwise("B"))
    out = {r["department_key"]: r for r in departments.metrics(rows, names).filter("semester = 'Fall 2024'").collect()}
    # The withdrawn row is not part of the metrics; the audited one is taken but not passed.
    assert (out[10]["courses_taken"], out[10]["courses_passed"], out[10]["enrolled_students"]) == (5, 4, 2)
    assert (out[20]["fail_count"], out[20]["fail_rate"], out[20]["median_gpa"]) == (1, 33.33, 2.3)
    assert set(out) == {10, 20}


def enrollments(spark, rows):
    return spark.createDataFrame(
        rows, "enrollment_id string, student_id string, grade string, grade_points double, credit_hours string, attendance_pct double"
    )


def test_plain_mean_of_three_grades(spark):
    raw = enrollments(spark, [(str(i), "S", g, p, "3", 90.0) for i, (g, p) in enumerate([("A", 4.0), ("B", 3.0), ("C", 2.0)])])
    rows = cleaning.enrich_grades(raw).withColumns({"academic_year": F.lit("2024-2025"), "semester": F.lit("Fall 2024")})
    assert gpa.semester_gpa(rows, ["student_id", *gpa.PERIOD]).first()["semester_gpa"] == 3.0


def test_withdrawal_leaves_the_gpa_alone(spark):
    raw = enrollments(spark, [("1", "S", "A", 4.0, "3", 90.0), ("2", "S", " w ", 0.0, None, 90.0)])
    rows = cleaning.enrich_grades(raw).withColumns({"academic_year": F.lit("2024-2025"), "semester": F.lit("Fall 2024")})
    assert gpa.semester_gpa(rows, ["student_id", *gpa.PERIOD]).first()["semester_gpa"] == 4.0


def test_enrichment_flags_and_defaults(spark):
    rows = [(g, g, g, None, c, 80.0) for g, c in [("A+", "4"), ("B-", "x"), ("F", None), ("W", "3"), ("I", "3"), ("AU", "3"), ("zz", "3")]]
    out = {r["grade_letter"]: r for r in cleaning.enrich_grades(enrollments(spark, rows)).collect()}
    assert out["A+"]["quality_points"] == 16.0 and out["B-"]["credit_hours"] == 3
    assert [out[g]["grade_points"] for g in ("F", "W", "I", "AU", "ZZ")] == [0.0, None, None, None, None]
    assert [out[g]["is_passing"] for g in ("A+", "F", "AU")] == [True, False, False]
    assert out["W"]["is_withdrawn"] and out["I"]["is_incomplete"]


def test_letter_lookup_matches_the_ladder(spark):
    points = [-0.1, *(i / 100 for i in range(401)), 4.3]
    rows = spark.createDataFrame([(p,) for p in points], "p double").select("p", grades.letter_for(F.col("p")).alias("g")).collect()
    ladder = sorted(((v, k) for k, v in grades.GRADE_POINTS.items() if k != "A+"), reverse=True)
    for p, g in rows:
        assert g == next(k for v, k in ladder if max(p, 0) >= v - 1e-9)


def test_null_gpa_stays_null(spark):
    row = spark.createDataFrame([(1, 1, *FALL, None, 0, 0, 1, 0, None)], """student_key long, department_key long,
      academic_year string, semester string, semester_gpa double, credit_hours_earned long, credit_hours_attempted long,
      courses_taken long, courses_passed long, avg_attendance_pct double""")
    assert gpa.cumulative_gpa(row).first()["cumulative_gpa"] is None


def test_half_up_is_symmetric_and_equals_plain_rounding_elsewhere(spark):
    from lyceum.functions.numeric import half_up, mean_of

    rows = spark.createDataFrame([(n, d) for n in range(-45, 46) for d in (1, 3, 7, 10)], "n long, d long")
    for r in rows.select("n", "d", half_up(F.col("n"), F.col("d"), 1).alias("h")).collect():
        exact = abs(r["n"]) * 10 / r["d"]
        want = (int(exact + 0.5) if abs(exact % 1 - 0.5) > 1e-9 else int(exact) + 1) / 10
        assert r["h"] == (-want if r["n"] < 0 else want)
    assert spark.range(1).select(half_up(F.lit(-15), F.lit(10), 0)).first()[0] == -2.0
    values = rows.select((F.col("n") / 100).alias("v"))
    got = values.agg(mean_of(F.col("v"), 2, 3).alias("m"), F.round(F.avg("v"), 3).alias("plain")).first()
    assert got["m"] == got["plain"]
