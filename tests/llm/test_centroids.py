from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pytest

from lyceum.llm import centroids

KIND = "vec_id long, embedding array<float>, label int, cluster string, distance string"


def brute(rows: list[tuple], k: int = 8, rounds: int = 10):
    """Rows of the result, by plain loops over Python's whole numbers."""
    kept = []
    for i, v in rows:
        if i is None or v is None or len(v) != 64 or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(1024 * float(x)) for x in v]))
    centres = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        groups = [[] for _ in centres]
        for _, v in kept:
            groups[near(v)[1]].append(v)
        centres = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, centres)]
    last = [(i, *near(v)) for i, v in kept]
    inertia = [sum(d for _, d, n in last if n == c) for c in range(len(centres))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    top = centroids.LONGEST
    return sorted((i, n, min(d, top), min(inertia[n], top), min(sum(inertia), top), digest[n]) for i, d, n in last)


def result(df):
    return sorted(tuple(r) for r in centroids.cluster(df).collect())


def frame(spark, rows, kind=KIND):
    return spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], kind)


def test_the_table(spark, sf_dir):
    table = pd.read_parquet(f"{sf_dir}/embeddings.parquet")
    want = brute(list(zip(table.vec_id.tolist(), [v.tolist() for v in table.embedding])))
    assert result(spark.read.parquet(f"{sf_dir}/embeddings.parquet")) == want


def test_popcounts_are_dot_products():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 1 << 12, (50, 64)), rng.integers(0, 1 << 12, 64)
    planes = centroids.pack(a, 12)
    assert (centroids._weighted(planes, centroids.pack(b[None], 12)[:, 0]) == a @ b).all()
    assert (centroids._weighted(planes, planes) == (a * a).sum(1)).all()


def test_odd_cases(spark):
    rng = np.random.default_rng(4)
    some = [(i, rng.normal(0, 1, 64).astype(np.float32).tolist()) for i in range(60)]
    bad = [(100, None), (101, []), (102, [0.0] * 63), (103, [0.0] * 63 + [None]), (104, [float("nan")] + [0.0] * 63),
           (105, [float("inf")] + [0.0] * 63), (None, some[0][1]), (106, [0.0] * 65)]
    rows = some + bad + [some[1], some[1], (107, some[1][1]), (1, some[2][1]), (108, [0.0] * 64)]
    assert result(frame(spark, rows)) == brute(rows)
    few = some[:3]
    assert result(frame(spark, few)) == brute(few)
    same = [(i, [0.25] * 64) for i in range(12)]  # seven centroids stay empty
    assert result(frame(spark, same)) == brute(same)
    assert {r[1] for r in result(frame(spark, same))} == {0}
    none = centroids.cluster(frame(spark, bad))
    assert none.count() == 0 and none.columns == centroids.cluster(frame(spark, few)).columns
    assert centroids.cluster(frame(spark, few).limit(0)).count() == 0


@pytest.mark.parametrize("scale", [1e5, 1e9, 1e12])
def test_wide_numbers(spark, scale):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(0, scale, 64)).tolist()) for i in range(40)] + [(99, [1e30] * 64)]
    kind = KIND.replace("float", "double")
    assert result(frame(spark, rows, kind)) == brute(rows[:-1])  # the last is beyond the exact numbers


def test_a_hot_vector_in_many_tasks(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(0, 0.2, 64).astype(np.float32).tolist()) for i in range(40)]
    rows += [(i, rows[0][1]) for i in range(40, 240)]
    assert result(frame(spark, rows).repartition(13)) == brute(rows)
