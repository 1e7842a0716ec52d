from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lyceum.operators import ranges


@pytest.fixture
def rows(spark):
    values = [(k, k % 3, None if k % 40 == 7 else float(k * 7919 % 1000 // 2)) for k in range(400)]
    values += [(1000 + k, 1, 250.0) for k in range(200)]  # a value that a third of all rows have
    return spark.createDataFrame(values, "id long, grp long, v double")


@pytest.mark.parametrize("group", [[], ["grp"]])
@pytest.mark.parametrize("parts", [1, 7])
def test_ranks_equal_a_window(rows, group, parts):
    got = ranges.with_ranks(rows, "v", group, ranges=parts).toPandas()
    frame = rows.toPandas()
    key = frame.v.fillna(-1)
    by = (lambda s: s.groupby(frame[group[0]])) if group else (lambda s: s)
    frame["rank"] = by(key).rank(method="min", ascending=False).astype(int)
    frame["dense_rank"] = by(key).rank(method="dense", ascending=False).astype(int)
    columns = ["id", "rank", "dense_rank"]
    pd.testing.assert_frame_equal(got[columns].sort_values("id", ignore_index=True), frame[columns].sort_values("id", ignore_index=True), check_dtype=False)


def test_ranks_of_nothing(rows):
    assert ranges.with_ranks(rows.limit(0), "v", ["grp"]).count() == 0


def test_pages(spark, rows, tmp_path):
    path, order = str(tmp_path), [F.col("v").desc_nulls_last(), F.col("id").asc()]
    ranges.write_pages(rows, path, order, ranges=10)
    want = [r.id for r in rows.orderBy(*order).collect()]
    assert ranges.total_rows(spark, path) == len(want) == 600
    for offset in (0, 30, 299, 555, 590, 600, 700):
        got = ranges.read_page(spark, path, order, offset, 25)
        assert [r.id for r in got.collect()] == want[offset : offset + 25]
        assert len(ranges.page_ranges(spark, path, offset, 25)[0]) <= 2  # a deep page opens no more than an early one
    plan = ranges.read_page(spark, path, order, 299, 25)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "range" in plan[plan.index("PartitionFilters: ["):]
