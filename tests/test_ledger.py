from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from lyceum.schemas import FACT_ATTENDANCE
from lyceum.sources import sinks
from lyceum.streaming import attendance as stream
from lyceum.streaming import ledger

START = datetime(2024, 9, 2, 9, 0)
KIND = "event_time timestamp, course_id string, student_id string, status string"


def events(spark, *minutes, status="PRESENT"):
    return spark.createDataFrame([(START + timedelta(minutes=m), "C1", f"S{k}", status) for k, m in enumerate(minutes)], KIND)


def counts(spark, path):
    return {(r.window_start - START).seconds // 60: r.total_events for r in ledger.windows(spark, path).collect()}


def test_late_rows_are_kept_aside(spark, tmp_path):
    path = str(tmp_path)
    sink = ledger.event_sink(path)
    sink(events(spark, 0, 21), 0)  # the watermark is at minute 11 from now on
    sink(events(spark, 3, 4, 7, 12), 1)  # windows 0 to 5 and 5 to 10 are closed, 10 to 15 is open
    assert counts(spark, path) == {0: 1, 20: 1, 10: 1}
    late = ledger.late_events(spark, path).collect()
    assert sorted((r.event_time - START).seconds // 60 for r in late) == [3, 4, 7] and {r.batch_id for r in late} == {1}
    entry = ledger.Ledger(spark, path).last()
    assert (entry.batch_id, entry.events, entry.late) == (1, 6, 3)


def test_replays_change_nothing(spark, tmp_path):
    path = str(tmp_path)
    sink = ledger.event_sink(path)
    for number, minutes in ((0, [0, 1]), (1, [2]), (1, [2]), (0, [0, 1]), (2, [])):
        sink(events(spark, *minutes), number)
    assert counts(spark, path) == {0: 3}
    assert ledger.Ledger(spark, path).last() == ledger.Entry(2, ledger.Ledger(spark, path).last().newest, 3, 0)


def test_a_batch_that_dies_is_not_read_and_comes_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    sink = ledger.event_sink(path)
    sink(events(spark, 0), 0)
    with monkeypatch.context() as broken:
        broken.setattr(ledger.Ledger, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            sink(events(spark, 1, 2), 1)
    assert counts(spark, path) == {0: 1}
    sink(events(spark, 1, 2), 1)
    assert counts(spark, path) == {0: 3}


def test_the_stream_commits_through_the_ledger(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    for minutes in ([0, 1, 30], [2, 31]):
        sinks.append_rows(events(spark, *minutes), source)
        ledger.start(spark.readStream.schema(KIND).parquet(source), path, str(tmp_path / "check"), available_now=True).awaitTermination()
    assert counts(spark, path) == {0: 2, 30: 2}
    assert ledger.late_events(spark, path).count() == 1


def test_rows_dropped_by_the_watermark_are_counted(spark, tmp_path):
    source = str(tmp_path / "in")
    dropped = 0
    for minutes in ([0, 60], [1, 2, 61], [3, 62]):
        sinks.append_rows(events(spark, *minutes), source)
        query = stream.start(spark.readStream.schema(KIND).parquet(source), str(tmp_path / "out"), str(tmp_path / "check"), available_now=True)
        query.awaitTermination()
        dropped += ledger.dropped_by_watermark(query)
    assert dropped == 3


def test_an_old_fact_batch_cannot_undo_a_newer_one(spark, tmp_path):
    base = dict(zip(FACT_ATTENDANCE.names, (1, 1, 1, 1, 20240902, "ABSENT", False, False, 0, "LMS")))

    def rows(**changes):
        return spark.createDataFrame([[{**base, **changes}[n] for n in FACT_ATTENDANCE.names]], FACT_ATTENDANCE)

    path = str(tmp_path / "facts")
    sink = ledger.fact_sink(path, str(tmp_path))
    old, new = rows(), rows(status="EXCUSED", is_excused=True)
    for number, batch in ((0, old), (1, new), (0, old), (1, new), (2, old.limit(0))):
        sink(batch, number)
    assert [r.status for r in spark.read.schema(FACT_ATTENDANCE).parquet(path).collect()] == ["EXCUSED"]
    assert ledger.Ledger(spark, str(tmp_path)).last().batch_id == 2
