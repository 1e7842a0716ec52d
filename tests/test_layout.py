from __future__ import annotations

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lyceum.operators import governance
from lyceum.sources import sinks

ADMIN = governance.Principal("dean", "DEPARTMENT_ADMIN", ("DEPT_A",))


def opened(path: str, column: str, low, high) -> tuple[int, int]:
    """Files whose statistics allow a value in the range, and all files."""
    hit, files = 0, glob.glob(f"{path}/*.parquet")
    for name in files:
        meta = pq.ParquetFile(name).metadata
        at = meta.schema.names.index(column)
        groups = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
        hit += any(s.has_min_max and s.min <= high and s.max >= low for s in groups)
    return hit, len(files)


@pytest.fixture(scope="module")
def points(spark):
    return spark.range(40_000).select(
        "id", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000)).alias("a"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1_000)).cast("int")).alias("b"),
    )


def test_files_are_skipped_on_every_key(spark, points, tmp_path):
    path = str(tmp_path / "z")
    sinks.write_interleaved(points, path, keys=["a", "b"], files=64)
    assert spark.read.parquet(path).exceptAll(points).isEmpty() and spark.read.parquet(path).count() == 40_000
    first, total = opened(path, "a", 500, 540)
    day = points.select(F.date_add(F.lit("2020-01-01").cast("date"), 500)).first()[0]
    second, _ = opened(path, "b", day, day)
    assert total == 64 and first < total / 2 and second < total / 2


def test_clustering_on_one_key_opens_most_files_for_the_other(points, tmp_path):
    path = str(tmp_path / "one")
    points.repartitionByRange(64, "a").sortWithinPartitions("a").write.parquet(path)
    day = points.select(F.date_add(F.lit("2020-01-01").cast("date"), 500)).first()[0]
    hit, total = opened(path, "b", day, day)
    assert hit > total / 2


def test_nulls_hot_values_empty_tables_and_clashing_names(spark, tmp_path):
    rows = [(1, None, 5.0), (2, None, None), *((7, 7, 7.0) for _ in range(900))]
    odd = spark.createDataFrame(rows, "_0 int, _order int, _split double")
    sinks.write_interleaved(odd, str(tmp_path / "odd"), keys=["_order", "_split"], files=4)
    back = spark.read.parquet(str(tmp_path / "odd"))
    assert back.columns == odd.columns and back.exceptAll(odd).isEmpty() and back.count() == len(rows)
    sinks.write_interleaved(odd.limit(0), str(tmp_path / "none"), keys=["_0"])
    assert spark.read.schema(odd.schema).parquet(str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        sinks.write_interleaved(odd, str(tmp_path / "wide"), keys=["_0", "_order"], bits=32)


def test_equal_keys_are_split_over_files(spark, tmp_path):
    same = spark.range(8_000).select("id", F.lit(1).alias("k"))
    sinks.write_interleaved(same, str(tmp_path / "hot"), keys=["k"], files=8)
    sizes = [pq.ParquetFile(f).metadata.num_rows for f in glob.glob(f"{tmp_path}/hot/*.parquet")]
    assert len(sizes) == 8 and max(sizes) < 2_000


def test_grants_prune_departments_before_the_scan(spark, tmp_path):
    facts = spark.range(5_000).select(F.col("id").alias("student_key"), (F.col("id") % 20).alias("department_key"))
    path = str(tmp_path / "facts")
    sinks.write_clustered(facts, path, partition_by=["department_key"], cluster_by=["student_key"])
    stored = spark.read.schema(facts.schema).parquet(path)
    depts = spark.range(20).select(F.col("id").alias("department_key"), F.concat(F.lit("D"), "id").alias("department_id"))
    grants = depts.select(
        F.when(F.col("department_key") < 2, "DEPT_A").otherwise("DEPT_B").alias("role_name"), "department_id", F.lit(True).alias("is_active")
    )
    others = {"departments": depts, "instructors": spark.createDataFrame([], "instructor_id string, is_active boolean, department_key long")}
    pruned = governance.visible_facts(stored, ADMIN, grants=governance.keyed_grants(grants, depts), **others)
    plain = governance.visible_facts(facts, ADMIN, grants=grants, **others)
    assert "dynamicpruningexpression(department_key" in pruned._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, pruned.select(*facts.columns).collect())) == sorted(map(tuple, plain.select(*facts.columns).collect()))
    assert pruned.count() == 500
