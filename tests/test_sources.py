from __future__ import annotations

import json
from datetime import date

from pyspark.sql import functions as F

from lyceum import schemas
from lyceum.sources import date_dim, readers, sinks, staging


def test_csv_dialect(spark, tmp_path):
    path = tmp_path / "students.csv"
    path.write_text(
        "student_id,first_name,scholarship_amount\n"
        'STU000001,"Ann, ""Nan""",12.5\nSTU000002,NULL,\n,null,x\n'
    )
    schema = "student_id string, first_name string, scholarship_amount double"
    rows = readers.read_csv(spark, str(path), spark.createDataFrame([], schema).schema).collect()
    assert [tuple(r) for r in rows] == [("STU000001", 'Ann, "Nan"', 12.5), ("STU000002", None, None), (None, None, None)]


def test_csv_round_trip_counts_rows(spark, tmp_path):
    df = spark.createDataFrame([("CS001", "Computing", "Eng"), ("BA001", "Business", "Biz")], schemas.RAW_DEPARTMENTS)
    assert sinks.write_csv(df, str(tmp_path / "d")) == 2
    assert sorted(readers.read_csv(spark, str(tmp_path / "d"), schemas.RAW_DEPARTMENTS).collect()) == sorted(df.collect())


def test_json_arrays_and_lines(spark, tmp_path):
    rows = [{"department_id": "A", "department_name": "x", "college": "c"}, {"department_id": "B"}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "l.json").write_text("\n".join(map(json.dumps, rows)))
    one = readers.read_json(spark, str(tmp_path / "a.json"), schemas.RAW_DEPARTMENTS)
    two = readers.read_json(spark, str(tmp_path / "l.json"), schemas.RAW_DEPARTMENTS, outer_array=False)
    assert one.collect() == two.collect() and one.count() == 2


def test_tables_modes_and_counts(spark, tmp_path):
    path, df = str(tmp_path / "t"), spark.range(5)
    assert sinks.write_table(df, path) == 5
    assert sinks.append_rows(spark.range(5, 7), path) == 2
    assert readers.read_table(spark, path, fmt="parquet").count() == 7


def test_replace_a_table_from_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_table(spark.range(10), path)
    current = spark.read.parquet(path)
    assert sinks.replace_table(current.filter("id < 4"), path) == 4
    assert spark.read.parquet(path).count() == 4


def test_clustered_layout_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "facts")
    df = spark.range(1000).select("id", (F.col("id") % 3).cast("string").alias("academic_year"))
    sinks.write_clustered(df, path, partition_by=["academic_year"], cluster_by=["id"], files=6)
    chosen = spark.read.parquet(path).filter("academic_year = '1'")
    assert chosen.count() == 333
    assert "PartitionFilters: [isnotnull(academic_year" in chosen._jdf.queryExecution().executedPlan().toString()


def test_staging_columns_and_modes(spark, tmp_path):
    df = spark.createDataFrame([("S1",)], "student_id string")
    folder = str(tmp_path)
    for _ in range(2):
        sinks.load_staging(df, folder, "students", "s.csv")
        sinks.load_staging(df, folder, "attendance", "a.csv")
    students, attendance = (spark.read.parquet(f"{folder}/stg_{e}") for e in ("students", "attendance"))
    assert (students.count(), attendance.count()) == (1, 2)
    row = students.first()
    assert (row["source_file"], row["is_valid"], row["validation_errors"]) == ("s.csv", True, None)


def test_rejected_rows_are_appended_and_empty_input_writes_nothing(spark, tmp_path):
    df = spark.createDataFrame([("S1", "bad")], "student_id string, validation_errors string")
    assert sinks.load_rejected(df.limit(0), str(tmp_path), "students") == 0
    assert not (tmp_path / "stg_rejected_students").exists()
    assert sinks.load_rejected(df, str(tmp_path), "students") == 1
    assert spark.read.parquet(str(tmp_path / "stg_rejected_students")).first()["entity_type"] == "students"


def test_run_record(spark):
    row = sinks.run_record(
        spark, "r", "load", "SUCCESS", "2024-01-01 00:00:00", "2024-01-01 00:01:30", extracted=3, loaded=2, rejected=1
    )
    assert row.columns == schemas.ETL_RUN_LOG.names and row.first()["duration_secs"] == 90


def test_date_dimension(spark):
    dim = date_dim.date_dim(spark)
    assert dim.schema.names == schemas.DIM_DATE.names
    assert [f.dataType for f in dim.schema.fields] == [f.dataType for f in schemas.DIM_DATE.fields]
    assert dim.count() == (date(2036, 1, 1) - date(2010, 1, 1)).days
    row = dim.filter("date_key = 20240901").first()
    assert (row["day_of_week"], row["day_name"], row["is_weekday"], row["academic_year"], row["semester"]) == (
        7, "Sunday", False, "2024-2025", "Fall 2024"
    )


def test_parameters_are_bound_not_spliced(spark):
    spark.range(5).createOrReplaceTempView("numbers")
    assert readers.query(spark, "SELECT * FROM numbers WHERE id >= :low", low=3).count() == 2
    assert readers.query(spark, "SELECT :text AS t", text="x'; DROP").first()["t"] == "x'; DROP"


def test_stage_reads_back_the_same_rows(spark):
    df = spark.range(100).withColumn("s", F.lit("x"))
    kept = staging.stage(df, "test")
    assert kept.dtypes == df.dtypes and kept.count() == 100
    assert staging.shared_folder(spark) in kept.inputFiles()[0].replace("file://", "")


def test_published_view(spark):
    sinks.publish_view(spark.range(3), "three")
    assert readers.read_table(spark, "three").count() == 3


def test_tables_bucketed_alike_join_without_a_shuffle(spark, tmp_path):
    for name in ("facts_b", "students_b"):
        df = spark.range(200).select((F.col("id") % 50).alias("student_key"), F.col("id").alias(f"v_{name}"))
        sinks.write_bucketed(df, name, by="student_key", buckets=4, path=str(tmp_path / name))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("facts_b").join(spark.table("students_b"), "student_key")
        per_student = joined.groupBy("student_key").count()
        assert per_student.count() == 50
        assert "Exchange hashpartitioning" not in per_student._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE facts_b")
        spark.sql("DROP TABLE students_b")
