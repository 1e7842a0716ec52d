"""Jobs for ``spark-submit``: ``jobs.py {semester,departments,stream,load} ...`` on tables of a warehouse folder."""

from __future__ import annotations

import argparse
from datetime import date

from pyspark.sql import SparkSession

from lyceum.operators import gpa, quality
from lyceum.plans import courses, departments, loads, students
from lyceum.session import build_session
from lyceum.sources import readers, sinks
from lyceum.sources.staging import scratch_run, stage
from lyceum.streaming import attendance as stream


def semester_job(spark: SparkSession, warehouse: str, fmt: str = "parquet") -> int:
    """Enrollment facts -> semester GPA, running GPA and ranks, partitioned by semester."""
    facts = readers.read_table(spark, f"{warehouse}/fact_performance", fmt)
    ranked = students.semester_ranks(stage(gpa.semester_gpa(facts), "semester-gpa"))
    return sinks.write_table(
        ranked, f"{warehouse}/fact_semester_gpa_ranked", fmt=fmt, partition_by=loads.FACT_PARTITIONS
    )


def department_job(spark: SparkSession, warehouse: str, fmt: str = "parquet") -> dict[str, int]:
    """Department metrics and course difficulty."""

    def table(name: str):
        return readers.read_table(spark, f"{warehouse}/{name}", fmt)

    facts, dept, course = table("fact_performance"), table("dim_department"), table("dim_course")
    results = {
        "department_metrics": departments.metrics(facts, dept),
        "course_difficulty": courses.difficulty(facts, course, dept),
    }
    return {name: sinks.write_table(df, f"{warehouse}/{name}", fmt=fmt) for name, df in results.items()}


def load_job(
    spark: SparkSession, landing: str, warehouse: str, as_of: date, gate: bool = False, versions: bool = False
) -> dict[str, int]:
    """Load one delivery; with ``gate`` it is refused before the merge when too few of its quality checks passed."""
    minimum = quality.GATE_PASS_RATE if gate else None
    return loads.run(spark, loads.read_extracts(spark, landing), warehouse, as_of, pass_rate=minimum, versions=versions)


def stream_job(spark: SparkSession, servers: str, topic: str, warehouse: str, checkpoint: str) -> None:
    """Attendance windows and alerts from Kafka until stopped."""
    events = stream.decode(readers.read_kafka(spark, servers, topic))
    stream.start(
        events, f"{warehouse}/attendance_windows", checkpoint, alerts_path=f"{warehouse}/attendance_alerts"
    ).awaitTermination()


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("job", choices=["semester", "departments", "stream", "load"])
    parser.add_argument("--warehouse", required=True)
    parser.add_argument("--landing", help="folder of the extracts, for load")
    parser.add_argument("--as-of", type=date.fromisoformat, default=date.today(), help="load date")
    parser.add_argument("--gate", action="store_true", help="fail a load below the pass rate of its checks")
    parser.add_argument("--versions", action="store_true", help="publish a load as one version")
    parser.add_argument("--servers", help="Kafka bootstrap servers, for stream")
    parser.add_argument("--topic", default="attendance-events")
    parser.add_argument("--checkpoint", help="stream checkpoint folder")
    args = parser.parse_args(argv)
    spark = build_session(f"lyceum-{args.job}")
    if args.job != "stream":
        with scratch_run(spark):
            if args.job == "semester":
                semester_job(spark, args.warehouse)
            elif args.job == "departments":
                department_job(spark, args.warehouse)
            else:
                load_job(spark, args.landing, args.warehouse, args.as_of, args.gate, args.versions)
    else:
        stream_job(spark, args.servers, args.topic, args.warehouse, args.checkpoint)


if __name__ == "__main__":
    main()
