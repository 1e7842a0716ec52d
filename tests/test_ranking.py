from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lyceum.functions.numeric import half_up, scaled
from lyceum.operators import keys, profile, ranking
from lyceum.operators.ranking import Rank


@pytest.fixture(scope="module")
def scores(spark):
    random.seed(7)
    rows = [
        # Group 0 holds a third of the rows and most of them share one value.
        (i, 0 if i % 3 == 0 else random.randrange(1, 6), random.randrange(2), random.choice([0.0, 0.0, 1.5, 2.25, 3.999, None]))
        for i in range(900)
    ]
    return spark.createDataFrame(rows, "id long, dept int, term int, gpa double")


def test_value_ranks_equal_native_windows(scores):
    ranks = {
        "r": Rank("rank", ("dept", "term")), "c": Rank("rank", ("term",)),
        "d": Rank("dense_rank", ("term",)), "p": Rank("percent_rank", ("dept", "term")),
    }
    got = ranking.add_ranks(scores, "gpa", ranks).select("id", "r", "c", "d", "p")
    high, term = F.col("gpa").desc_nulls_last(), Window.partitionBy("term")
    dept = Window.partitionBy("dept", "term")
    want = scores.select(
        "id", F.rank().over(dept.orderBy(high)).alias("r"), F.rank().over(term.orderBy(high)).alias("c"),
        F.dense_rank().over(term.orderBy(high)).alias("d"),
        F.percent_rank().over(dept.orderBy(F.col("gpa").asc_nulls_first())).alias("p"),
    )
    assert sorted(got.collect()) == sorted(want.collect())


def test_lowest_value_ranks_first_when_asked(spark):
    rows = spark.createDataFrame([(1, 10, 3.8), (2, 10, 2.1), (3, 10, 3.0)], "course long, dept long, gpa double")
    got = {r["course"]: r["r"] for r in ranking.add_ranks(rows, "gpa", {"r": Rank("rank", ("dept",))}, best="low").collect()}
    assert got == {2: 1, 3: 2, 1: 3}


def test_single_row_group_has_percent_rank_zero(spark):
    rows = spark.createDataFrame([(1, 2.0)], "g int, v double")
    assert ranking.add_ranks(rows, "v", {"p": Rank("percent_rank", ("g",))}).first()["p"] == 0.0


def test_latest_per_key_limits_before_the_shuffle(scores):
    latest = ranking.latest_per_key(scores, ["dept"], [F.col("id").desc()])
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    want = scores.groupBy("dept").agg(F.max("id").alias("id"))
    assert sorted(r["id"] for r in latest.collect()) == sorted(r["id"] for r in want.collect())


def test_page_limits(scores):
    assert [r["id"] for r in ranking.page(scores, 3, 5, F.col("id")).collect()] == [5, 6, 7]
    with pytest.raises(ValueError):
        ranking.page(scores, 0, 0, F.col("id"))
    with pytest.raises(ValueError):
        ranking.page(scores, 201, 0, F.col("id"))


def test_profile_matches_builtin_statistics(scores):
    counts = scores.groupBy("dept", scaled(F.col("gpa"), 3).alias("u")).agg(F.count(F.lit(1)).alias("n"))
    got = profile.with_running_count(counts, ["dept"], "u", "n").groupBy("dept").agg(
        profile.median(F.col("u"), 1000, 3).alias("m"), (profile.lower_median(F.col("u")) / 1000).alias("lo"),
        profile.deviation(F.col("u"), F.col("n"), 1000, 3).alias("s"),
    )
    want = scores.groupBy("dept").agg(
        F.round(F.median("gpa"), 3).alias("m"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY gpa)").alias("lo"),
        F.round(F.stddev_samp("gpa"), 3).alias("s"),
    )
    assert sorted(got.collect()) == sorted(want.collect())


def test_member_counts_equal_distinct_counts(scores):
    counts = profile.member_counts(scores, ["term"], ["dept", "gpa"], {"n": F.count(F.lit(1))})
    got = counts.groupBy("term").agg(
        profile.count_members("dept").alias("a"), profile.count_members("gpa").alias("b"), profile.sum_from("dept", "n").alias("n")
    )
    want = scores.groupBy("term").agg(F.countDistinct("dept").alias("a"), F.countDistinct("gpa").alias("b"), F.count(F.lit(1)).alias("n"))
    assert sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize("num,den,digits,want", [(5, 2000, 3, 0.003), (5, 1000, 2, 0.01), (1, 3, 2, 0.33), (0, 7, 1, 0.0), (7, 0, 2, None)])
def test_half_up(spark, num, den, digits, want):
    row = spark.range(1).select(half_up(F.lit(num), F.lit(den), digits).alias("x")).first()
    assert row["x"] == want


def test_surrogate_keys_are_dense_and_ordered(spark):
    rows = spark.range(0, 5000).select((F.col("id") * 7 % 5000).alias("natural")).repartition(13)
    out = keys.with_surrogate_key(rows, ["natural"], "key", start=10)
    assert [tuple(r) for r in out.orderBy("natural").collect()] == [(i, i + 10) for i in range(5000)]


def test_new_rows_continue_the_numbering(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "natural string, key long")
    out = keys.append_with_keys(old, spark.createDataFrame([("d",), ("c",)], "natural string"), ["natural"], "key")
    assert sorted(map(tuple, out.collect())) == [("a", 1), ("b", 2), ("c", 3), ("d", 4)]


def test_lookup_with_and_without_default(spark):
    facts = spark.createDataFrame([("x",), ("y",)], "id string")
    dim = spark.createDataFrame([("x", 7)], "id string, key long")
    assert [tuple(r) for r in keys.lookup(facts, dim, "id", "key").collect()] == [("x", 7)]
    assert sorted(map(tuple, keys.lookup(facts, dim, "id", "key", default=1).collect())) == [("x", 7), ("y", 1)]
