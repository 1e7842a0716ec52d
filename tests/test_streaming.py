from __future__ import annotations

import json
import os
from datetime import datetime

from pyspark.sql import functions as F

from lyceum.plans import attendance
from lyceum.schemas import FACT_ATTENDANCE
from lyceum.streaming import attendance as stream

# Three courses over one morning, one event without a student.
EVENTS = [
    ("P-7", "BIO", "2031-03-10", "PRESENT", "LMS", "2031-03-10T08:01:00"),
    ("P-8", "BIO", "2031-03-10", "LATE", "APP", "2031-03-10T08:03:30"),
    (None, "BIO", "2031-03-10", "ABSENT", "APP", "2031-03-10T08:04:59"),
    ("P-7", "ART", "2031-03-10", "EXCUSED", "LMS", "2031-03-10T08:05:00"),
    ("P-9", "ART", "2031-03-10", "ABSENT", "LMS", "2031-03-10T08:09:59"),
    ("P-9", "LAW", "2031-03-10", "PRESENT", "APP", "2031-03-10T08:12:00"),
    ("P-7", "BIO", "2031-03-10", "ABSENT", "LMS", "2031-03-10T08:14:00"),
]
NAMES = ["student_id", "course_id", "attendance_date", "status", "source_system", "timestamp"]


def write_batch(folder, number, rows):
    folder.mkdir(exist_ok=True)
    path = folder / f"{number:03d}.json"
    path.write_text("\n".join(json.dumps({"value": json.dumps(dict(zip(NAMES, r)))}) for r in rows))
    # The file source reads in order of modification time.
    os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))


def source(spark, folder):
    raw = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).json(str(folder))
    return stream.decode(raw)


def run(spark, folder, out, **options):
    job = stream.start(
        source(spark, folder), str(out / "windows"), str(out / "checkpoint"), available_now=True, **options
    )
    job.awaitTermination()


def batch(spark, rows):
    events = spark.createDataFrame(rows, " string, ".join(NAMES) + " string")
    return events.withColumn("event_time", F.try_to_timestamp("timestamp"))


def sorted_rows(df, columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_flags_and_absence_rate(spark):
    events = batch(spark, EVENTS)
    raw = events.withColumns({"student_key": F.col("student_id"), "course_key": F.col("course_id")})
    rows = {r["course_key"]: r for r in attendance.course_absence(raw).collect()}
    assert raw.filter(attendance.attended(F.col("status"))).count() == 3
    bio = rows["BIO"]
    assert (bio["total_events"], bio["absences"], bio["absence_rate"], bio["unique_students"]) == (4, 2, 50.0, 2)


def test_window_counts(spark):
    rows = {(r["course_id"], r["window_start"].minute): r for r in stream.batch_windows(batch(spark, EVENTS)).collect()}
    first = rows["BIO", 0]
    assert (first["total_events"], first["present_count"], first["late_count"], first["absent_count"], first["unique_students"]) == (3, 1, 1, 1, 2)
    assert (first["attendance_rate"], first["absence_alert"], rows["LAW", 10]["absence_alert"]) == (33.33, True, False)


def test_stream_equals_batch_over_several_micro_batches(spark, tmp_path):
    folder = tmp_path / "in"
    later = [(f"Q-{i % 7}", "BIO", "2031-03-10", "PRESENT", "LMS", f"2031-03-10T08:1{i % 5}:30") for i in range(40)]
    for i, part in enumerate([EVENTS[:2], EVENTS[3:5] + EVENTS[2:3], EVENTS[5:], later]):
        write_batch(folder, i, part)
    run(spark, folder, tmp_path / "out")
    got = stream.current_state(spark, str(tmp_path / "out" / "windows"))
    want = stream.batch_windows(batch(spark, EVENTS + later))
    assert sorted_rows(got, want.columns) == sorted_rows(want, want.columns)


def test_reads_from_a_time_on_open_their_days_only(spark, tmp_path):
    folder = tmp_path / "in"
    for i in range(3):
        write_batch(folder, i, [("A", "C1", "d", "ABSENT", "LMS", f"2031-03-{10 + i}T08:30:00")])
    run(spark, folder, tmp_path / "out", alerts_path=str(tmp_path / "out" / "alerts"))
    path = str(tmp_path / "out" / "windows")
    later = stream.state_rows(spark, path, since=datetime(2031, 3, 12, 8, 0))
    assert later.count() == 1
    plan = later._jdf.queryExecution().executedPlan().toString()
    assert "window_day" in plan.split("PartitionFilters: [")[1].split("]")[0] and "20310312" in plan
    assert stream.current_alerts(spark, str(tmp_path / "out" / "alerts")).count() == 3


def test_a_batch_without_rows_writes_no_folder(spark, tmp_path):
    rows = stream.student_windows(batch(spark, EVENTS))
    sink = stream.batch_sink(str(tmp_path / "w"), str(tmp_path / "alerts"))
    sink(rows.limit(0), 0)
    assert not [p for p in os.listdir(tmp_path / "w") if p.startswith("window_day")] and not (tmp_path / "alerts").exists()
    sink(rows, 1)
    sink(rows, 1)  # a retry overwrites its own partitions
    assert spark.read.parquet(str(tmp_path / "w")).count() == rows.count()


def test_windows_are_sent_again_and_counted_once(spark, tmp_path):
    folder = tmp_path / "in"
    base = ("CRS001", "2024-09-02", "PRESENT", "LMS")
    write_batch(folder, 0, [("A", *base, "2024-09-02T09:00:00")])
    write_batch(folder, 1, [("A", *base, "2024-09-02T09:01:00"), ("B", *base, "2024-09-02T09:02:00")])
    run(spark, folder, tmp_path / "out")
    stored = spark.read.parquet(str(tmp_path / "out" / "windows"))
    assert stored.count() == 3
    row = stream.current_state(spark, str(tmp_path / "out" / "windows")).first()
    assert (row["total_events"], row["unique_students"]) == (3, 2)


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    folder = tmp_path / "in"
    base = ("CRS001", "2024-09-02", "PRESENT", "LMS")
    write_batch(folder, 0, [("A", *base, "2024-09-02T10:00:00")])
    write_batch(folder, 1, [("A", *base, "2024-09-02T10:01:00")])
    write_batch(folder, 2, [("B", *base, "2024-09-02T09:00:00"), ("B", *base, "2024-09-02T09:56:00")])
    run(spark, folder, tmp_path / "out")
    starts = {r["window_start"] for r in stream.current_state(spark, str(tmp_path / "out" / "windows")).collect()}
    assert starts == {datetime(2024, 9, 2, 10, 0), datetime(2024, 9, 2, 9, 55)}


def test_alerts_see_the_whole_window(spark, tmp_path):
    folder = tmp_path / "in"
    write_batch(folder, 0, [("A", "C1", "d", "ABSENT", "LMS", "2024-09-02T09:00:00"), ("A", "C2", "d", "PRESENT", "LMS", "2024-09-02T09:00:00")])
    write_batch(folder, 1, [(f"S{i}", "C1", "d", "PRESENT", "LMS", "2024-09-02T09:01:00") for i in range(4)])
    run(spark, folder, tmp_path / "out", alerts_path=str(tmp_path / "out" / "alerts"))
    alerts = spark.read.parquet(str(tmp_path / "out" / "alerts"))
    assert [(r["course_id"], r["attendance_rate"], r["batch_id"]) for r in alerts.collect()] == [("C1", 0.0, 0)]


def test_compaction_keeps_the_state(spark, tmp_path):
    folder = tmp_path / "in"
    for i in range(3):
        write_batch(folder, i, [(f"S{i}", "C1", "d", "PRESENT", "LMS", f"2024-09-02T09:0{i}:00")])
    run(spark, folder, tmp_path / "out")
    path = str(tmp_path / "out" / "windows")
    before = stream.current_state(spark, path).collect()
    assert stream.compact(spark, path, datetime(2024, 9, 2, 9, 30)) == 0  # the day is not over
    assert stream.compact(spark, path, datetime(2024, 9, 3)) == 1
    assert stream.current_state(spark, path).collect() == before
    assert [p.name for p in (tmp_path / "out" / "windows" / "window_day=20240902").glob("batch_id=*")] == ["batch_id=2"]
    assert stream.compact(spark, path, datetime(2024, 9, 3)) == 0


def test_bad_times_are_dropped_by_the_decoder(spark):
    record = {**dict(zip(NAMES, EVENTS[0])), "timestamp": "soon"}
    rows = spark.createDataFrame([(json.dumps(record).encode(),), (json.dumps(dict(zip(NAMES, EVENTS[1]))).encode(),)], "value binary")
    assert stream.decode(rows).count() == 1


def test_micro_batches_upsert_the_attendance_fact(spark, tmp_path):
    names = FACT_ATTENDANCE.names
    path = str(tmp_path / "fact")

    def rows(*changes):
        base = dict(
            student_key=1, course_key=1, instructor_key=1, department_key=1, date_key=20240902, status="ABSENT",
            is_present=False, is_excused=False, minutes_late=0, source_system="LMS",
        )
        return spark.createDataFrame([[{**base, **c}[n] for n in names] for c in changes], FACT_ATTENDANCE)

    sink = stream.fact_sink(path)
    sink(rows({}, {"date_key": 20240903}), 0)
    sink(rows({"status": "EXCUSED", "is_excused": True}, {"student_key": 2}), 1)
    sink(rows({"status": "EXCUSED", "is_excused": True}, {"student_key": 2}), 1)
    sink(rows({}).limit(0), 2)
    stored = spark.read.schema(FACT_ATTENDANCE).parquet(path)
    assert sorted((r["student_key"], r["date_key"], r["status"], r["is_excused"]) for r in stored.collect()) == [
        (1, 20240902, "EXCUSED", True), (1, 20240903, "ABSENT", False), (2, 20240902, "ABSENT", False),
    ]
