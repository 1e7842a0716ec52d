"""Versions of a warehouse, refused deliveries and the incremental semester GPA."""

from __future__ import annotations

import json

import pytest

from lyceum import schemas
from lyceum.operators import gpa
from lyceum.operators.quality import QualityGateError
from lyceum.plans import gpa_refresh, loads
from lyceum.sources.warehouse import InPlace, Snapshot
from test_pipeline import AS_OF, SMALL, delivery


def facts(spark, rows):
    """``(enrollment, student, year, semester, points)``; withdrawn without points."""
    base = dict(course_key=1, department_key=1, credit_hours=3, attendance_pct=80.0, is_incomplete=False)
    made = [
        {**base, "enrollment_id": e, "student_key": s, "academic_year": y, "semester": t, "grade_points": p, "is_passing": bool(p),
         "quality_points": None if p is None else 3 * p, "is_withdrawn": p is None}
        for e, s, y, t, p in rows
    ]
    return spark.createDataFrame([[r.get(n) for n in schemas.FACT_PERFORMANCE.names] for r in made], schemas.FACT_PERFORMANCE)


F24, S25, F25, S26 = ("2024-2025", "Fall 2024"), ("2024-2025", "Spring 2025"), ("2025-2026", "Fall 2025"), ("2025-2026", "Spring 2026")
STEPS = [  # each state of the facts, and the semesters that changed
    ([("a", 1, *F24, 4.0), ("b", 2, *F24, 2.0), ("c", 1, *S25, 3.0)], [F24, S25]),
    ([("a", 1, *F24, 4.0), ("b", 2, *F24, 2.0), ("c", 1, *S25, 3.0), ("d", 1, *F25, 1.0), ("e", 3, *F25, 2.5)], [F25]),
    ([("a", 1, *F24, 4.0), ("b", 2, *F24, 2.0), ("c", 1, *S25, 2.0), ("f", 2, *S25, 4.0), ("d", 1, *F25, 1.0), ("e", 3, *F25, 2.5)], [S25]),
    ([("a", 1, *F24, 4.0), ("b", 2, *F24, 2.0), ("c", 1, *S25, 2.0), ("f", 2, *S25, 4.0), ("d", 1, *F25, None), ("e", 3, *F25, None)], [F25]),
    ([("a", 1, *F24, 3.0), ("b", 2, *F24, 2.0), ("c", 1, *S25, 2.0), ("f", 2, *S25, 4.0), ("g", 3, *S26, 3.5), ("h", 1, None, None, 1.0)], [F24, F25, S26, (None, None)]),
]


@pytest.mark.parametrize("kind", [InPlace, Snapshot])
def test_refresh_equals_a_full_recompute(spark, tmp_path, kind):
    folder = str(tmp_path / "w")
    for rows, changed in STEPS:
        store = kind(spark, folder)
        touched = spark.createDataFrame(changed, "academic_year string, semester string")
        store.replace("fact_performance", facts(spark, rows))
        now = store.read("fact_performance", schemas.FACT_PERFORMANCE)
        count = gpa_refresh.refresh(store, now, touched)
        store.publish()
        kept = kind(spark, folder).read("fact_semester_gpa", schemas.FACT_SEMESTER_GPA).select(*schemas.FACT_SEMESTER_GPA.names)
        want = gpa.cumulative_gpa(gpa.semester_gpa(now)).select(*schemas.FACT_SEMESTER_GPA.names)
        key = lambda r: tuple(str(v) for v in r)
        assert sorted(kept.collect(), key=key) == sorted(want.collect(), key=key)
        assert count == kept.count()
        totals = kind(spark, folder).read("semester_gpa_totals", schemas.SEMESTER_GPA_TOTALS).collect()
        assert len(totals) == len({r.student_key for r in totals})


def test_earlier_semesters_are_not_opened(spark, tmp_path):
    store = InPlace(spark, str(tmp_path))
    gpa_refresh.refresh(store, facts(spark, STEPS[1][0]), spark.createDataFrame([F24, S25, F25], "academic_year string, semester string"))
    parts = spark.createDataFrame([S25], "academic_year string, semester string").collect()
    opened = gpa_refresh.opened_rows(store, parts)
    assert {(r.academic_year, r.semester) for r in opened.collect()} == {S25, F25}
    assert len(opened.inputFiles()) >= 2
    plan = opened._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "Fall 2025" in plan and "Fall 2024" not in plan


def test_a_load_becomes_visible_at_once(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "w")
    loads.run(spark, delivery(spark), folder, AS_OF, minimums=SMALL, versions=True)

    def state():
        store = Snapshot(spark, folder)
        grades = store.read("fact_performance", schemas.FACT_PERFORMANCE).filter("enrollment_id = 'E1'").collect()
        return store.version, store.read("dim_student", schemas.DIM_STUDENT).count(), [r.grade_letter for r in grades]

    assert state() == (1, 3, ["A"])

    def killed(*_):
        raise RuntimeError("executor and driver lost")

    with monkeypatch.context() as broken:  # dimensions and facts are written, the aggregate is not
        broken.setattr(gpa_refresh, "refresh", killed)
        with pytest.raises(RuntimeError, match="lost"):
            loads.run(spark, delivery(spark, grade="B", STU000002="Law"), folder, AS_OF, minimums=SMALL, versions=True)
    assert state() == (1, 3, ["A"])
    loads.run(spark, delivery(spark, grade="B", STU000002="Law"), folder, AS_OF, minimums=SMALL, versions=True)
    assert state() == (2, 4, ["B"])
    first = Snapshot(spark, folder, version=1)
    assert first.read("dim_student", schemas.DIM_STUDENT).count() == 3
    status = [r.status for r in spark.read.parquet(f"{folder}/etl_run_log").orderBy("finished_at").collect()]
    assert sorted(status) == ["FAILED", "SUCCESS", "SUCCESS"]


def test_of_two_loads_one_publishes(spark, tmp_path):
    folder = str(tmp_path / "w")
    one, two = Snapshot(spark, folder), Snapshot(spark, folder)
    one.replace("t", spark.range(3))
    two.replace("t", spark.range(5))
    one.publish()
    with pytest.raises(RuntimeError, match="another load"):
        two.publish()
    named = json.loads((tmp_path / "w" / "_versions" / "00000001.json").read_text())
    assert list(named) == ["t"] and Snapshot(spark, folder).read("t", spark.range(1).schema).count() == 3
    assert [p.name for p in (tmp_path / "w" / "_versions").iterdir() if not p.name.startswith(".")] == ["00000001.json"]


def test_a_refused_delivery_is_staged_and_not_merged(spark, tmp_path):
    folder = str(tmp_path / "w")
    with pytest.raises(QualityGateError, match="passed less"):
        loads.run(spark, delivery(spark), folder, AS_OF, minimums=SMALL, pass_rate=100.0)
    assert spark.read.parquet(f"{folder}/stg_enrollments").count() == 5 and not (tmp_path / "w" / "dim_student").exists()
    row = spark.read.parquet(f"{folder}/etl_run_log").first()
    assert (row.status, row.rows_loaded, row.rows_extracted, row.rows_rejected) == ("REFUSED", 0, 4, 1)
    assert spark.read.parquet(f"{folder}/stg_rejected_students").first().student_id == "STU000004"
    loads.run(spark, delivery(spark), folder, AS_OF, minimums=SMALL, pass_rate=50.0)
    assert spark.read.parquet(f"{folder}/dim_student").count() == 3
