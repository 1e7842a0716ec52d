from __future__ import annotations

import numpy as np
import pandas as pd

from lyceum.llm import quality


def test_trees_learn_and_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    p = quality.predict(model, x[2000:])
    assert ((p >= 0.5) == y[2000:]).mean() > 0.95

    def walk(row):  # one tree at a time
        total = model.base
        for t in range(len(model.value) // model.nodes):
            at = 0
            for _ in range(model.depth):
                node = t * model.nodes + at
                at = 2 * at + 1 + int(row[model.feature[node]] > model.threshold[node])
            total += model.value[t * model.nodes + at]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(p[:50], [walk(r) for r in x[2000:2050]])


def test_statistics_do_not_depend_on_the_batch(small_docs):
    texts = [None, "", "a", *small_docs.text.tolist()[:40]]
    whole = quality.statistics(texts)
    assert np.allclose(whole, np.vstack([quality.statistics([t]) for t in texts]))
    assert whole.shape[1] == len(quality.FEATURES) and np.isfinite(whole).all()
    word = whole[quality.statistics(["x"]).shape[0] + 1]
    assert word[quality.FEATURES.index("mean_word")] == 1


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score(docs, labels).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    held = got[got.held_out]
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.95


def test_odd_cases(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (3, 1), (6, 0), (99, 1)], "doc_id long, quality int")
    rows = quality.score(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id: r.y for r in quality.votes(labels).collect()} == {1: 1, 3: 1, 6: 0, 99: 1}
    none = labels.limit(0)
    assert {r.score for r in quality.score(odd_docs, none).collect()} == {0.5}
    assert quality.score(no_docs, labels).count() == 0
    assert quality.keep_good(odd_docs, none).columns == odd_docs.columns
    assert quality.keep_good(odd_docs, none).count() == odd_docs.count()
