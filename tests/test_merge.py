from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from lyceum.operators import governance, merge

DIM = "id string, name string, row_hash string, effective_date date, expiry_date date, is_current boolean"
SRC = "id string, name string, row_hash string"
DAY1, DAY2 = date(2024, 1, 1), date(2024, 6, 1)


@pytest.fixture(scope="module")
def dimension(spark):
    return spark.createDataFrame(
        [
            ("a", "A0", "h0", date(2023, 1, 1), DAY1, False),
            ("a", "A1", "h1", DAY1, merge.OPEN_END, True),
            ("b", "B1", "h2", DAY1, merge.OPEN_END, True),
            ("c", "C1", "h3", DAY1, merge.OPEN_END, True),
        ],
        DIM,
    )


@pytest.fixture(scope="module")
def incoming(spark):
    return spark.createDataFrame([("a", "A2", "h9"), ("b", "B1", "h2"), ("d", "D1", "h4")], SRC)


def test_scd2_closes_and_opens(dimension, incoming):
    rows = {(r["id"], r["name"]): r for r in merge.scd2(dimension, incoming, "id", DAY2).collect()}
    assert set(rows) == {("a", "A0"), ("a", "A1"), ("a", "A2"), ("b", "B1"), ("c", "C1"), ("d", "D1")}
    assert (rows["a", "A1"]["expiry_date"], rows["a", "A1"]["is_current"]) == (DAY2, False)
    assert (rows["a", "A2"]["effective_date"], rows["a", "A2"]["expiry_date"]) == (DAY2, merge.OPEN_END)
    assert rows["b", "B1"]["effective_date"] == DAY1 and rows["c", "C1"]["is_current"]


def test_scd2_is_idempotent_with_one_current_row(dimension, incoming):
    once = merge.scd2(dimension, incoming, "id", DAY2)
    twice = merge.scd2(once, incoming, "id", DAY2)
    assert sorted(once.collect()) == sorted(twice.collect())
    assert twice.filter("is_current").groupBy("id").count().filter("count > 1").isEmpty()


def test_scd2_into_an_empty_dimension(spark, incoming):
    assert merge.scd2(spark.createDataFrame([], DIM), incoming, "id", DAY2).filter("is_current").count() == 3


def test_null_hash_never_closes_a_row(spark, dimension):
    source = spark.createDataFrame([("b", "B2", None)], SRC)
    rows = [r for r in merge.scd2(dimension, source, "id", DAY2).collect() if r["id"] == "b"]
    assert any(r["name"] == "B1" and r["is_current"] for r in rows)


def facts(spark, rows):
    return spark.createDataFrame(rows, "k string, grade string, kept int, row_hash string")


def test_upsert_updates_inserts_and_keeps(spark):
    target = facts(spark, [("1", "A", 1, "x"), ("2", "B", 2, "y"), ("3", "C", 3, None)])
    source = facts(spark, [("1", "A+", 9, "x2"), ("2", "Z", 9, "y"), ("3", "D", 9, "z"), ("4", "F", 9, "n")])
    once = merge.upsert(target, source, ["k"], update=["grade", "row_hash"], changed=("row_hash",))
    # Row 3 has no hash to compare, so it stays; row 1 keeps the column that is not updated.
    assert sorted(map(tuple, once.collect()), key=str) == [
        ("1", "A+", 1, "x2"), ("2", "B", 2, "y"), ("3", "C", 3, None), ("4", "F", 9, "n"),
    ]
    twice = merge.upsert(once, source, ["k"], update=["grade", "row_hash"], changed=("row_hash",))
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str)


def test_upsert_on_several_keys(spark):
    schema = "s long, c long, d int, status string"
    target = spark.createDataFrame([(1, 1, 1, "ABSENT"), (1, 2, 1, "LATE")], schema)
    source = spark.createDataFrame([(1, 1, 1, "EXCUSED"), (2, 1, 1, "PRESENT")], schema)
    out = merge.upsert(target, source, ["s", "c", "d"], update=["status"], changed=("status",))
    assert sorted(map(tuple, out.collect())) == [(1, 1, 1, "EXCUSED"), (1, 2, 1, "LATE"), (2, 1, 1, "PRESENT")]


def test_insert_new_never_changes_rows(spark):
    target = facts(spark, [("1", "A", 1, "x")])
    out = merge.insert_new(target, facts(spark, [("1", "B", 2, "y"), ("2", "C", 3, "z")]), ["k"])
    assert sorted(map(tuple, out.collect())) == [("1", "A", 1, "x"), ("2", "C", 3, "z")]


def test_update_from_keeps_unmatched_values(spark):
    target = facts(spark, [("1", "A", 1, "x"), ("2", "B", 2, "y")])
    out = merge.update_from(target, spark.createDataFrame([("1", 7)], "k string, v int"), ["k"], {"kept": "v"})
    assert sorted((r["k"], r["kept"]) for r in out.collect()) == [("1", 7), ("2", 2)]


# --- governance ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def campus(spark):
    return dict(
        grants=spark.createDataFrame(
            [("DEPT_CS_ADMIN", "CS001", True), ("DEPT_BA_ADMIN", "BA001", True), ("DEPT_OLD", "MA001", False)],
            "role_name string, department_id string, is_active boolean",
        ),
        departments=spark.createDataFrame([(1, "CS001"), (2, "BA001"), (3, "MA001")], "department_key long, department_id string"),
        instructors=spark.createDataFrame(
            [(5, "INS0005", 2, True), (6, "INS0006", 3, False)],
            "instructor_key long, instructor_id string, department_key long, is_active boolean",
        ),
    )


@pytest.fixture(scope="module")
def performance(spark):
    return spark.createDataFrame(
        [(1, 1, 5), (2, 2, 5), (3, 3, 6)], "student_key long, department_key long, instructor_key long"
    )


def who(role, user="u", *grants):
    return governance.Principal(user, role, grants)


@pytest.mark.parametrize(
    "principal,want",
    [
        (who("UNIVERSITY_ADMIN"), {1, 2, 3}),
        (who("READONLY_DASHBOARD"), {1, 2, 3}),
        (who("DEPARTMENT_ADMIN", "u", "DEPT_CS_ADMIN"), {1}),
        (who("DEPARTMENT_ADMIN", "u", "DEPT_OLD"), set()),
        (who("DEPARTMENT_ADMIN"), set()),
        (who("INSTRUCTOR", "INS0005"), {2}),
        (who("INSTRUCTOR", "INS0006"), set()),
        (who("STUDENT_PORTAL"), set()),
        (who("NOBODY"), set()),
    ],
)
def test_fact_rows(performance, campus, principal, want):
    rows = governance.visible_facts(performance, principal, **campus)
    assert {r["department_key"] for r in rows.collect()} == want


@pytest.mark.parametrize(
    "principal,want",
    [
        (who("DATA_ANALYST"), {1, 2, 3}),
        (who("DEPARTMENT_ADMIN", "u", "DEPT_CS_ADMIN", "DEPT_BA_ADMIN"), {1, 2}),
        (who("INSTRUCTOR", "INS0005"), {1, 2}),
        (who("STUDENT_PORTAL", "ann"), {2}),
        (who("NOBODY"), set()),
    ],
)
def test_student_rows(spark, performance, campus, principal, want):
    students = performance.select("student_key", "department_key").withColumn("student_id", F.concat(F.lit("S"), "student_key"))
    users = spark.createDataFrame([("ann", "S2")], "username string, student_id string")
    rows = governance.visible_students(students, principal, performance=performance, user_map=users, **campus)
    assert {r["student_key"] for r in rows.collect()} == want


def test_masking_by_role(spark):
    row = spark.createDataFrame(
        [("john@x.edu", date(2001, 5, 6), "John", "Doe", 10.0)],
        "email string, date_of_birth date, first_name string, last_name string, scholarship_amount double",
    )
    assert governance.mask(row, "UNIVERSITY_ADMIN").first() == row.first()
    assert tuple(governance.mask(row, "INSTRUCTOR").first()) == ("jo***@x.edu", date(2001, 1, 1), "John", "Doe", -1.0)
    assert tuple(governance.mask(row, "STUDENT_PORTAL").first())[2:4] == ("***", "***")
    assert governance.mask(row, "DATA_ENGINEER", {"first_name": "full"}).first()["first_name"] == "***REDACTED***"
    assert governance.masked_columns("DATA_ENGINEER") == []


def test_pii_tags_survive_a_projection_and_a_file(spark, tmp_path):
    rows = spark.createDataFrame([("a@b.cd", 1)], "email string, n int")
    tagged = governance.tag_pii(rows).select("n", "email")
    assert governance.pii_columns(tagged) == {"email": "HIGH"}
    tagged.write.parquet(str(tmp_path / "t"))
    assert governance.pii_columns(spark.read.parquet(str(tmp_path / "t"))) == {"email": "HIGH"}


def test_seeded_grants_do_not_overwrite(spark):
    schema = "role_name string, department_id string, is_active boolean"
    old = spark.createDataFrame([("R", "CS001", False)], schema)
    new = spark.createDataFrame([("R", "CS001", True), ("R", "BA001", True)], schema)
    assert sorted(map(tuple, governance.seed_grants(old, new).collect())) == [("R", "BA001", True), ("R", "CS001", False)]


def test_department_scope_of_the_principal_wins(performance):
    assert [r["department_key"] for r in governance.department_scope(performance, 1, 2).collect()] == [1]
    assert [r["department_key"] for r in governance.department_scope(performance, None, 2).collect()] == [2]
    assert governance.department_scope(performance, None, None).count() == 3


def test_access_record(performance):
    row = governance.access_record(performance, who("INSTRUCTOR", "INS0005"), "FACT", "department").first()
    assert (row["row_count"], row["session_role"], row["table_name"]) == (3, "INSTRUCTOR", "FACT")
