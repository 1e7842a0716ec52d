from __future__ import annotations

import pytest

from lyceum.operators import quality as q


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"c {kind}")


def result(spark, values, rule, kind="string"):
    return q.report(column(spark, values, kind), [rule]).first()["result"]


@pytest.mark.parametrize("values,threshold,want", [("abc", 0.0, "PASS"), (["a", None, None, None], 0.5, "FAIL"), (["a", "b", None], 0.4, "PASS")])
def test_not_null(spark, values, threshold, want):
    assert result(spark, list(values), q.not_null("c", threshold)) == want


@pytest.mark.parametrize("values,want", [(["A1", "A2", "A3"], "PASS"), (["A1", "A1", "A3"], "FAIL"), (["A1", None, "A3", None], "PASS")])
def test_unique(spark, values, want):
    assert result(spark, values, q.unique("c")) == want


def test_in_set(spark):
    assert result(spark, ["PRESENT", "ABSENT", None], q.in_set("c", ["PRESENT", "ABSENT", "LATE", "EXCUSED"])) == "PASS"
    assert result(spark, ["PRESENT", "MISSING"], q.in_set("c", ["PRESENT", "ABSENT"])) == "FAIL"


def test_in_range(spark):
    assert result(spark, [0.0, 2.5, 3.7, 4.0], q.in_range("c", 0, 4), "double") == "PASS"
    assert result(spark, [0.0, 4.5, 3.7], q.in_range("c", 0, 4), "double") == "FAIL"
    assert result(spark, ["1"] * 200 + ["9", "n/a"], q.in_range("c", 0, 4)) == "WARN"


def test_min_rows(spark):
    assert result(spark, ["x"] * 100, q.min_rows(50)) == "PASS"
    assert result(spark, ["x"] * 10, q.min_rows(50)) == "FAIL"


def test_referential_integrity(spark):
    ref = column(spark, ["CS001", "BA001", "MA001"])
    assert q.referential_integrity(column(spark, ["CS001", "BA001"]), "c", ref, "c").first()["result"] == "PASS"
    line = q.referential_integrity(column(spark, ["CS001", "ZZZZZ", "ZZZZZ", None]), "c", ref, "c").first()
    assert (line["result"], line["actual"], line["row_count"]) == ("FAIL", "3 orphaned FK values", 4)


def test_orphan_rows(spark):
    rows = q.orphans(column(spark, ["CS001", "ZZZZZ"]), "c", column(spark, ["CS001"]), "c")
    assert [r["c"] for r in rows.collect()] == ["ZZZZZ"]


def test_summary_and_gate(spark):
    lines = q.report(column(spark, ["a", "a"]), [q.min_rows(1), q.unique("c")])
    assert q.summary(lines, "T").first().asDict() == {
        "table_name": "T", "total": 2, "passed": 1, "failed": 1, "pass_rate": "50.0%", "ok": False,
    }
    assert not q.gate(lines) and q.gate(lines, 50.0)
    with pytest.raises(q.QualityGateError, match="unique:c"):
        q.require_no_failure(lines, "T")


def test_warning_lowers_the_rate_without_failing(spark):
    lines = q.report(column(spark, [1.0] * 200 + [9.0], "double"), [q.in_range("c", 0, 4)])
    row = q.summary(lines, "T").first()
    assert (row["failed"], row["ok"]) == (1, True)


def test_empty_table(spark):
    lines = {r["check_name"]: r["result"] for r in q.report(column(spark, []), [q.min_rows(0), q.not_null("c"), q.unique("c")]).collect()}
    assert set(lines.values()) == {"PASS"} and len(lines) == 3


def test_attendance_suite_has_a_minimum_argument(spark):
    rows = spark.createDataFrame([("S", "2024-09-02", "PRESENT")] * 3, "student_id string, attendance_date string, status string")
    assert q.gate(q.validate_attendance(rows, minimum=3)) and not q.gate(q.validate_attendance(rows))


def test_offending_values_are_limited_and_ordered(spark):
    rows = q.offending_values(column(spark, ["ok", "z", "y", "y", "a", "b", "c", "d"]), "c", ["ok"])
    assert [tuple(r) for r in rows.collect()] == [("a", 1), ("b", 1), ("c", 1), ("d", 1), ("y", 2)]


def test_row_flags(spark):
    rows = spark.createDataFrame(
        [("S", "C", "2024-09-02", "PRESENT"), (None, "C", "2024-09-07", "GONE"), ("S", None, "x", None)],
        "student_id string, course_id string, attendance_date string, status string",
    )
    flags = [tuple(r)[4:] for r in q.attendance_flags(rows).collect()]
    assert flags == [(True, True, True, True, True), (False, True, True, False, False), (True, False, False, False, False)]


def test_enrollment_flags(spark):
    rows = spark.createDataFrame(
        [("S", "C", "au ", "99.5", "2024-09-02"), ("S", "C", "Z", "1000", "bad"), (None, None, None, None, None)],
        "student_id string, course_id string, grade string, attendance_pct string, enrollment_date string",
    )
    flags = [tuple(r)[5:] for r in q.enrollment_flags(rows).collect()]
    assert flags == [(True,) * 5, (True, True, False, False, False), (False,) * 5]


def test_quality_log_has_the_audit_columns(spark):
    from lyceum import schemas

    log = q.quality_log(q.report(column(spark, ["a"]), [q.min_rows(1)]), "T", "run")
    assert log.columns == schemas.DATA_QUALITY_LOG.names and log.count() == 1
