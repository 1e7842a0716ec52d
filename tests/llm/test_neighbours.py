from __future__ import annotations

import numpy as np
import pandas as pd

from lyceum.llm import neighbours


def brute(rows: dict[int, np.ndarray], k: int) -> dict[int, list[tuple[int, float]]]:
    ids = np.array(sorted(rows))
    x = np.stack([rows[i] for i in ids]).astype(np.float64)
    out = {}
    for q in ids[ids % 20 == 0]:
        s = (x * rows[q].astype(np.float64)).sum(1)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out[int(q)] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def test_recall_over_shards(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, np.float32) for r in table.collect()}
    want = brute(rows, 20)
    got = neighbours.search(neighbours.usable(table), shard_rows=150, query_block=10).toPandas()
    assert set(got.query_id) == set(want)
    hits = sum(len({i for i, _ in want[q]} & set(g.vec_id)) for q, g in got.groupby("query_id"))
    assert hits / (20 * len(want)) >= 0.95
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21)) and g.score.is_monotonic_decreasing
        exact = {i: float((rows[i].astype(np.float64) * rows[q].astype(np.float64)).sum()) for i in g.vec_id}
        assert np.allclose(g.score, [exact[i] for i in g.vec_id], rtol=0, atol=1e-12)


def test_graph_of_unnormed_vectors():
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(2500, 24)) * rng.uniform(0.2, 2, (2500, 1))).astype(np.float32)
    layers = neighbours.build(neighbours.augment(x))
    q = rng.normal(size=(100, 24)).astype(np.float32)
    found, _ = neighbours.descend(neighbours.augment(x), layers[::-1], np.column_stack([q, np.zeros(100, np.float32)]), 128)
    true = np.argsort(-(q @ x.T), 1)[:, :20]
    assert np.mean([len(set(a) & set(b[:20])) / 20 for a, b in zip(true, found)]) >= 0.9
    assert all((a < len(a)).all() and (a >= -1).all() for a in layers)


def test_recall_on_uneven_lengths(spark):
    rng = np.random.default_rng(4)
    gauss = rng.normal(size=(4_000, 64)).astype(np.float32)
    uneven = (rng.normal(size=(4_000, 64)) * rng.lognormal(0, 0.7, (4_000, 1))).astype(np.float32)
    for x in (gauss, uneven):
        frame = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "v": x.tolist()}), "id long, v array<float>")
        got = neighbours.search(frame, shard_rows=1_500).toPandas()
        want = brute(dict(enumerate(x)), 20)
        assert len(got) == 20 * len(want)
        assert sum(len({i for i, _ in want[q]} & set(g.vec_id)) for q, g in got.groupby("query_id")) / len(got) >= 0.97


def test_odd_cases(spark):
    v = [1.0, 2.0]
    rows = [(0, v), (20, None), (40, []), (60, [0.0, 0.0]), (80, [1.0, None]), (100, [float("nan"), 1.0]), (120, [float("inf"), 1.0]), (None, v), (0, v), (140, [1.0, 2.0, 3.0])]
    rows += [(k, v) for k in range(1, 60) if k % 20] + [(200, [-1.0, 0.5])]
    frame = spark.createDataFrame([(i, e, 5, "x") for i, e in rows], "vec_id long, embedding array<double>, id int, v string")
    got = neighbours.search(neighbours.usable(frame)).toPandas()
    assert set(got.query_id) == {0, 200}  # vector 140 has no other of its length
    own = got[got.query_id == 0].sort_values("rank")
    assert own.vec_id.tolist() == [k for k in range(1, 60) if k % 20][:20] and set(own.score) == {5.0}
    assert neighbours.search(neighbours.usable(frame.limit(0))).count() == 0


def test_fewer_than_k(spark):
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": range(20, 27), "embedding": [[float(i), 1.0] for i in range(7)]}))
    got = neighbours.search(neighbours.usable(frame)).toPandas().sort_values("rank")
    assert got.vec_id.tolist() == [21, 22, 23, 24, 25, 26] or got.score.tolist() == [1.0] * 6
