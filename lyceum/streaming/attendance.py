"""Five-minute attendance windows per course, as a stream and as its batch twin.

Distinct students are exact: the state has one fixed-width row per window, course and student, so
a course that receives a large share of the events is spread over all tasks, and readers add up.

Update mode sends a row again whenever it changes.  The sink therefore writes one partition per
day of windows and micro-batch (a retried batch overwrites its own, an empty one writes none) and
readers keep the last version of each state row.  A read from some time on opens the partitions of
those days only, however old the stream is; ``compact`` rewrites the days that are closed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lyceum.functions.numeric import count_where, percent
from lyceum.operators.ranking import latest_per_key
from lyceum.plans import loads
from lyceum.schemas import ATTENDANCE_EVENT, FACT_ATTENDANCE
from lyceum.sources.readers import parse_payload
from lyceum.sources.staging import stage

# Timing of the job and the alert limit.
WINDOW = "5 minutes"
WATERMARK = "10 minutes"
TRIGGER = "30 seconds"
ALERT_BELOW = 60.0
PARTITIONS = ["window_day", "batch_id"]

_KEYS = ["window_start", "window_end", "course_id"]
_COUNTS = ["total_events", "present_count", "absent_count", "late_count"]
_STATE = ["window_start", "course_id", "student_id"]


def decode(records: DataFrame, schema: T.StructType = ATTENDANCE_EVENT) -> DataFrame:
    """Kafka records -> events with a parsed event time; unparsable times become NULL and are dropped."""
    events = parse_payload(records, schema)
    return events.withColumn("event_time", F.try_to_timestamp("timestamp")).filter(F.col("event_time").isNotNull())


def _status_counts() -> list:
    status = F.col("status")
    return [
        F.count(F.lit(1)).alias("total_events"),
        count_where(status == "PRESENT").alias("present_count"),
        count_where(status == "ABSENT").alias("absent_count"),
        count_where(status == "LATE").alias("late_count"),
    ]


def _flat(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"window_start": F.col("window.start"), "window_end": F.col("window.end")}).drop("window")


def student_windows(events: DataFrame) -> DataFrame:
    """Counts per window, course and student, of a table or (behind a watermark) of a stream."""
    rows = events.withWatermark("event_time", WATERMARK) if events.isStreaming else events
    return _flat(rows.groupBy(F.window("event_time", WINDOW), "course_id", "student_id").agg(*_status_counts()))


def day_of(start: Column) -> Column:
    """Partition of a window: its day as a number such as 20240102."""
    return F.date_format(start, "yyyyMMdd").cast("int")


def rated(windows: DataFrame, alert_below: float = ALERT_BELOW) -> DataFrame:
    """Attendance rate and alert flag; only PRESENT counts here, unlike in the attendance fact."""
    rate = percent(F.col("present_count"), F.col("total_events"))
    return windows.withColumn("attendance_rate", rate).withColumn(
        "absence_alert", F.col("attendance_rate") < alert_below
    )


def totals(student_rows: DataFrame) -> DataFrame:
    """Student rows added up per window and course; events without a student are no student."""
    sums = [F.sum(c).alias(c) for c in _COUNTS]
    return rated(student_rows.groupBy(*_KEYS).agg(*sums, F.count("student_id").alias("unique_students")))


def batch_windows(events: DataFrame) -> DataFrame:
    """The same result over a finished table."""
    return totals(student_windows(events))


def state_rows(spark: SparkSession, path: str, since: object = None) -> DataFrame:
    """Latest version of every state row, optionally only of windows from ``since`` on."""
    rows = spark.read.parquet(path)
    if since is not None:
        start = F.lit(since).cast("timestamp")
        rows = rows.filter((F.col("window_day") >= day_of(start)) & (F.col("window_start") >= start))
    return latest_per_key(rows, _STATE, [F.col("batch_id").desc()])


def current_state(spark: SparkSession, path: str, since: object = None) -> DataFrame:
    """Latest version of every window, optionally only windows from ``since`` on."""
    return totals(state_rows(spark, path, since))


def compact(spark: SparkSession, path: str, before: object) -> int:
    """Rewrite each day of windows before the day ``before`` (days that no batch writes to any more) as one version.

    The rows are staged first and a day is replaced as a whole, so a reader sees the old or the new files.
    Returns the number of days rewritten.
    """
    closed = spark.read.parquet(path).filter(F.col("window_day") < day_of(F.lit(before).cast("timestamp")))
    several = closed.select(*PARTITIONS).distinct().groupBy("window_day").count().filter("count > 1")
    days = [r.window_day for r in several.collect()]
    if not days:
        return 0
    kept = stage(latest_per_key(closed.filter(F.col("window_day").isin(days)), _STATE, [F.col("batch_id").desc()]), "compacted")
    for day in days:  # one write per closed day
        rows = kept.filter(F.col("window_day") == day).drop("window_day")
        last = rows.agg(F.max("batch_id")).first()[0]
        rows.withColumn("batch_id", F.lit(last)).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(
            "batch_id"
        ).parquet(f"{path}/window_day={day}")
    return len(days)


def batch_sink(path: str, alerts_path: str | None = None):
    """``foreachBatch`` function: the batch's state rows by day, then alerts for the windows it touched."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        keyed = batch.withColumns({"window_day": day_of(F.col("window_start")), "batch_id": F.lit(batch_id).cast("bigint")})
        (
            # Few files per day; a day that holds most rows is split between tasks.
            keyed.hint("rebalance", "window_day")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*PARTITIONS)
            .parquet(path)
        )
        if alerts_path is None:
            return
        written = spark.read.schema(keyed.schema).parquet(path).filter(F.col("batch_id") == batch_id)
        first = written.agg(F.min("window_start")).first()[0]
        if first is None:
            return
        touched = written.select("window_start", "course_id").distinct()
        state = current_state(spark, path, since=first).join(touched, ["window_start", "course_id"], "left_semi")
        state.filter("absence_alert").write.mode("overwrite").parquet(f"{alerts_path}/batch_id={batch_id}")

    return write


def current_alerts(spark: SparkSession, alerts_path: str) -> DataFrame:
    """The last word of the alert output on each window: its latest row."""
    return latest_per_key(spark.read.parquet(alerts_path), ["window_start", "course_id"], [F.col("batch_id").desc()])


def start(
    events: DataFrame,
    path: str,
    checkpoint: str,
    *,
    alerts_path: str | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Run the job: every 30 seconds, or over everything available and then stop."""
    writer = (
        student_windows(events)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(batch_sink(path, alerts_path))
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=TRIGGER)
    return writer.start()


def start_console(events: DataFrame, checkpoint: str) -> StreamingQuery:
    """Monitoring output on the console in update mode."""
    return (
        student_windows(events)
        .writeStream.format("console")
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .option("truncate", False)
        .trigger(processingTime=TRIGGER)
        .start()
    )


def fact_sink(path: str):
    """``foreachBatch`` function that upserts attendance fact rows into a table partitioned by day.

    Only the days of the batch are read, merged and overwritten, so the cost follows the batch and
    not the table.  Repeating a batch changes nothing, since equal statuses do not update.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        order = [F.col(c).asc() for c in ("status", "minutes_late", "source_system")]
        single = latest_per_key(batch, loads.ATTENDANCE_KEYS, order)
        loads.upsert_attendance_table(batch.sparkSession, path, single)

    return write
