"""Results on tables in which one key holds a large share of the rows, without broadcasts to help."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import oracle_check
from lyceum.queries import REGISTRY

QUERIES = [
    "semester_gpa_ranked", "department_metrics", "department_scorecard", "course_grade_buckets",
    "top_students_by_department", "risk_scoring", "kpi_overview", "upsert_performance", "scd2_student",
    "attendance_summary", "attendance_pct", "attendance_window_batch", "attendance_stream", "dq_report_enrollments",
    "rls_student_instructor", "surrogate_keys",
]


@pytest.fixture(scope="module")
def skewed(spark, sf_dir, tmp_path_factory):
    """The test tables with hot orders, students, courses and event users."""
    folder = tmp_path_factory.mktemp("skew")

    def hot(name, **keys):
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        order = F.xxhash64(*df.columns)
        for column, value in keys.items():
            mark = F.pmod(order, F.lit(5)) < 2
            df = df.withColumn(column, F.when(mark, F.lit(value)).otherwise(F.col(column)).cast(df.schema[column].dataType))
        df.coalesce(1).write.parquet(str(folder / f"{name}.parquet"))

    for name in ("region", "nation", "customer", "supplier", "part"):
        hot(name)
    hot("orders", o_custkey=3)
    hot("lineitem", l_orderkey=7, l_partkey=11)
    hot("events", user_id=5)
    return str(folder)


@pytest.fixture(scope="module")
def duck(skewed):
    con = oracle_check.duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{skewed}/{name}.parquet/*.parquet'")
    return con


@pytest.fixture(scope="module", autouse=True)
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", QUERIES)
def test_skewed_tables(spark, skewed, duck, name):
    result = REGISTRY[name](spark, skewed).toArrow()
    assert oracle_check.compare(result, oracle_check.twin(duck, name)) == ""
