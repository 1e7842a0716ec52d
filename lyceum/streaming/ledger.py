"""Micro-batches that count once, and events that come too late.

A ledger file is put in place after a batch's data: it names the batch, the watermark that follows from it and what the batch held.
A batch that fails before that is written again over its own files; a batch that is replayed after a newer one finds
its number below the ledger's and changes nothing.  Readers see committed batches only.

Late events (their window had ended by the watermark of the batches before) are kept beside the windows instead of vanishing.
Each batch writes what it adds to its windows, so no state is held between batches, however many windows are open.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lyceum.operators.ranking import latest_per_key
from lyceum.plans import loads
from lyceum.sources.staging import stage
from lyceum.sources.warehouse import Files
from lyceum.streaming import attendance as stream

_MINUTES = {"minute": 60_000_000, "minutes": 60_000_000}


def _micros(interval: str) -> int:
    number, unit = interval.split()
    return int(number) * _MINUTES[unit]


class Entry(NamedTuple):
    batch_id: int  # last committed batch, -1 before the first
    newest: int | None  # latest event time so far, in microseconds
    events: int  # so far
    late: int


class Ledger:
    """One small file per committed batch; only the last one is kept."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._files = f"{path}/_ledger", Files(spark, path)

    def last(self) -> Entry:
        names = [n for n in self._files.names(self.path) if n.endswith(".json")]
        return Entry(*json.loads(self._files.read(f"{self.path}/{names[-1]}"))) if names else Entry(-1, None, 0, 0)

    def commit(self, entry: Entry) -> None:
        before = [n for n in self._files.names(self.path) if n.endswith(".json")]
        if not self._files.create(f"{self.path}/{entry.batch_id:012d}.json", json.dumps(entry)):
            raise RuntimeError(f"batch {entry.batch_id} was committed by another query")
        for name in before:
            self._files.delete(f"{self.path}/{name}")


def event_sink(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function over events: adds the batch to its windows and keeps late events aside."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ledger = Ledger(spark, path)
        last = ledger.last()
        if batch_id <= last.batch_id:
            return
        window = F.window("event_time", stream.WINDOW)
        bar = None if last.newest is None else last.newest - _micros(stream.WATERMARK)
        late = F.lit(False) if bar is None else F.unix_micros(window["end"]) <= F.lit(bar)
        seen = Observation("batch")
        newest = F.max(F.unix_micros("event_time"))
        watched = batch.withColumn("is_late", late).observe(seen, newest.alias("newest"), F.count(F.lit(1)).alias("n"), F.count_if("is_late").alias("late"))
        events = stage(watched, "batch")
        kept = stream.student_windows(events.filter("NOT is_late").drop("is_late"))
        mark = F.lit(batch_id).cast("bigint")
        keyed = kept.withColumns({"window_day": stream.day_of(F.col("window_start")), "batch_id": mark})
        _put(keyed.hint("rebalance", "window_day"), f"{path}/windows", stream.PARTITIONS)
        aside = events.filter("is_late").drop("is_late").withColumn("batch_id", mark)
        _put(aside, f"{path}/late", ["batch_id"])
        found = seen.get
        high = [x for x in (last.newest, found["newest"]) if x is not None]
        ledger.commit(Entry(batch_id, max(high, default=None), last.events + found["n"], last.late + found["late"]))

    return write


def _put(rows: DataFrame, path: str, partition_by: list[str]) -> None:
    """A batch's own partitions; a second attempt overwrites them."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def start(events: DataFrame, path: str, checkpoint: str, *, available_now: bool = False) -> StreamingQuery:
    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(event_sink(path))
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=stream.TRIGGER)).start()


def windows(spark: SparkSession, path: str, schema: object = None) -> DataFrame:
    """Windows of all committed batches: what they added, summed."""
    added = _committed(spark, path, "windows", schema)
    keys = ["window_start", "window_end", "course_id", "student_id"]
    names = ["total_events", "present_count", "absent_count", "late_count"]
    return stream.totals(added.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in names)))


def late_events(spark: SparkSession, path: str, schema: object = None) -> DataFrame:
    """Events of committed batches that came after their window had closed, with the batch that brought them."""
    return _committed(spark, path, "late", schema)


def _committed(spark: SparkSession, path: str, name: str, schema: object) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{path}/{name}").filter(F.col("batch_id") <= Ledger(spark, path).last().batch_id)


def fact_sink(path: str, ledger_path: str) -> Callable[[DataFrame, int], None]:
    """``stream.fact_sink`` behind a ledger: a batch that is replayed after a newer one cannot undo it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        ledger = Ledger(batch.sparkSession, ledger_path)
        last = ledger.last()
        if batch_id <= last.batch_id:
            return
        order = [F.col(c).asc() for c in ("status", "minutes_late", "source_system")]
        rows = stage(latest_per_key(batch, loads.ATTENDANCE_KEYS, order), "fact-batch")
        count = rows.count()
        if count:
            loads.upsert_attendance_table(batch.sparkSession, path, rows)
        ledger.commit(Entry(batch_id, last.newest, last.events + count, last.late))

    return write


def dropped_by_watermark(query: StreamingQuery) -> int:
    """Rows that a stateful query has dropped as late, by its recent progress."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
