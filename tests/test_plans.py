"""Physical plans and whole-table results against the SQL twins."""

from __future__ import annotations

import re

import pyarrow as pa
import pytest

import oracle_check
from lyceum.oracle import ORACLE
from lyceum.queries import REGISTRY

def plan(spark, name, sf_dir):
    return REGISTRY[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle_check.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_equals_sql_twin_without_python_or_nested_loops(spark, duck, sf_dir, name):
    result = REGISTRY[name](spark, sf_dir)
    assert oracle_check.compare(result.toArrow(), oracle_check.twin(duck, name)) == ""
    text = result._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Pandas" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_every_query_has_a_twin():
    assert set(ORACLE) == set(REGISTRY)


def test_the_comparison_sees_differences():
    one = pa.table({"a": [1, 2], "b": [0.5, None]})
    assert oracle_check.compare(one, pa.table({"b": [None, 0.5], "a": [2, 1]})) == ""
    assert "rows differ" in oracle_check.compare(one, pa.table({"a": [1, 2], "b": [0.5000001, None]}))
    assert "rows" in oracle_check.compare(one, one.slice(1))
    assert "types" in oracle_check.compare(one, pa.table({"a": pa.array([1, 2], pa.int32()), "b": [0.5, None]}))
    assert "columns" in oracle_check.compare(one, one.rename_columns(["a", "c"]))


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(spark, "semester_gpa", sf_dir)
    scan = next(line for line in text.splitlines() if "lineitem" in line)
    assert "Not(EqualTo(l_returnflag,R))" in scan
    columns = re.search(r"FileScan parquet \[([^\]]*)", scan).group(1)
    assert {c.split("#")[0] for c in columns.split(",")} == {
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag"
    }


def test_partial_aggregation_before_every_shuffle_of_the_base(spark, sf_dir):
    text = plan(spark, "semester_gpa", sf_dir)
    assert text.count("partial_sum(") > 0 and text.count("Exchange hashpartitioning") == 2


def test_one_shuffle_serves_all_history_windows(spark, sf_dir):
    text = plan(spark, "risk_scoring", sf_dir)
    assert len(re.findall(r"Exchange hashpartitioning\(student_key#\d+L, \d+\)", text)) == 1
