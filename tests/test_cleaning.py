from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from lyceum import schemas
from lyceum.functions import calendar, text
from lyceum.operators import cleaning

AS_OF = date(2024, 10, 1)
GOOD = dict(
    student_id=" STU000001 ", first_name="aNNa", last_name="o'neil-smith", email="Anna.Smith@Uni.edu",
    date_of_birth="2004-05-06", gender=None, nationality=" Irish ", enrollment_date="2023-09-01", program="BSc",
    major="Maths", department_id="MA001", student_type="Full-Time", scholarship="Yes", scholarship_amount="12.5",
)
SCHEMA = "arrival long, " + ", ".join(f"{c} string" for c in cleaning.STUDENT_COLUMNS)


def frame(spark, *changes):
    rows = [(i, *({**GOOD, **c}[k] for k in cleaning.STUDENT_COLUMNS)) for i, c in enumerate(changes)]
    return spark.createDataFrame(rows, SCHEMA)


def run(spark, *changes):
    return cleaning.clean_students(frame(spark, *changes), ["arrival"], AS_OF)


def test_missing_columns_are_reported(spark):
    with pytest.raises(ValueError, match="Missing required columns"):
        cleaning.check_students(frame(spark, {}).drop("email"), ["arrival"])


def test_normalisation(spark):
    row = run(spark, {})[0].first()
    assert row["student_id"] == "STU000001" and row["email"] == "anna.smith@uni.edu"
    assert (row["first_name"], row["last_name"]) == ("Anna", "O'Neil-Smith")
    assert (row["gender"], row["nationality"], row["scholarship"], row["scholarship_amount"]) == (
        "Prefer not to say", "Irish", True, 12.5
    )
    assert len(row["row_hash"]) == 32


def test_last_arrival_wins(spark):
    clean, rejected = run(spark, {"major": "Old"}, {"major": "New"})
    assert [r["major"] for r in clean.collect()] == ["New"] and rejected.count() == 0


@pytest.mark.parametrize(
    "change,message",
    [
        ({"student_id": None}, "NULL student_id"),
        ({"email": "nobody"}, "Invalid email: nobody"),
        ({"email": None}, "Invalid email: NULL"),
        ({"email": "a@b.co.uk"}, "Invalid email: a@b.co.uk"),
        ({"date_of_birth": "31/12/2000"}, "NULL date_of_birth"),
        ({"date_of_birth": "2014-10-01"}, "Unrealistic age: 10.0 years"),
        ({"enrollment_date": ""}, "NULL enrollment_date"),
        ({"enrollment_date": "1999-12-31"}, "Enrollment year out of range: 1999"),
        ({"enrollment_date": "2026-01-01"}, "Enrollment year out of range: 2026"),
        ({"student_type": "Alien"}, "Invalid student_type: Alien"),
        ({"email": "x", "student_type": None}, "Invalid email: x; Invalid student_type: NULL"),
    ],
)
def test_errors(spark, change, message):
    clean, rejected = run(spark, change)
    assert clean.count() == 0
    assert rejected.first()["validation_errors"] == message


def test_rows_without_id_are_all_rejected(spark):
    clean, rejected = run(spark, {"student_id": None}, {"student_id": None}, {})
    assert (clean.count(), rejected.count()) == (1, 2)


def test_hash_ignores_letter_case_but_not_content(spark):
    one, two, three = (run(spark, c)[0].first()["row_hash"] for c in ({}, {"first_name": "ANNA"}, {"major": "Art"}))
    assert one == two != three


def test_rejection_rate(spark):
    checked = cleaning.check_students(frame(spark, {}, {"student_id": "STU000002", "email": "x"}), ["arrival"], AS_OF)
    assert tuple(cleaning.rejection_rate(checked).first()) == (2, 1, 50.0)


def test_next_year_is_the_last_valid_enrollment_year(spark):
    assert run(spark, {"enrollment_date": "2025-09-01"})[0].count() == 1


def test_academic_calendar(spark):
    days = [date(2024, 8, 31), date(2024, 9, 1), date(2024, 12, 31), date(2025, 1, 1), date(2025, 5, 31), date(2025, 6, 1)]
    rows = spark.createDataFrame([(d,) for d in days], "d date")
    labels = calendar.term_labels(calendar.term_key(F.col("d")))
    out = rows.select(
        calendar.academic_year(F.col("d")), calendar.semester(F.col("d")), labels["academic_year"], labels["semester"],
        calendar.date_key(F.col("d")),
    ).collect()
    assert [tuple(r)[:2] for r in out] == [
        ("2023-2024", "Summer 2024"), ("2024-2025", "Fall 2024"), ("2024-2025", "Fall 2024"),
        ("2024-2025", "Spring 2025"), ("2024-2025", "Spring 2025"), ("2024-2025", "Summer 2025"),
    ]
    assert all(tuple(r)[:2] == tuple(r)[2:4] for r in out)
    assert out[0][4] == 20240831


def test_semester_order_is_chronological_and_unknown_terms_come_first(spark):
    rows = [("2024-2025", s) for s in ("Fall 2024", "Spring 2025", "Summer 2025", "Winter 2025")]
    out = spark.createDataFrame(rows, "y string, s string").select(calendar.semester_order(F.col("y"), F.col("s")))
    assert [r[0] for r in out.collect()] == [20241, 20242, 20243, 20240]


def test_masked_email(spark):
    emails = ["john@example.edu", "jo@x.edu", "j@x.edu", "joe@x.edu", None]
    out = spark.createDataFrame([(e,) for e in emails], "e string").select(text.masked_email(F.col("e"))).collect()
    assert [r[0] for r in out] == ["jo***@example.edu", "***@x.edu", "***@x.edu", "jo***@x.edu", None]


def test_landed_schema_is_text():
    assert {f.dataType.simpleString() for f in schemas.as_landed(schemas.RAW_STUDENTS).fields} == {"string"}


def test_id_patterns(spark):
    rows = spark.createDataFrame([("STU000123", "INS0042"), ("STU12", "INS1")], "s string, i string")
    out = rows.select(text.matches(F.col("s"), text.STUDENT_ID_PATTERN), text.matches(F.col("i"), text.INSTRUCTOR_ID_PATTERN))
    assert [tuple(r) for r in out.collect()] == [(True, True), (False, False)]
