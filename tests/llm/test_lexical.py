from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from lyceum.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def split(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs: list[tuple], items: list[tuple], top: int = 20):
    """Every document scored for every item."""
    docs = [(d, split(t)) for d, t in docs if d is not None]
    docs = [(d, Counter(t), len(t)) for d, t in docs if t]
    n, long = len(docs), sum(s for *_, s in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, size in docs:
            m = 100 - 25 + (25 * size * n) // long
            s = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in split(text) if c[t]
            )
            if s > 0:
                scored.append((-s, d))
        out += [(item, k, d, -s) for k, (s, d) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def result(spark, docs, items, **options):
    left = spark.createDataFrame([(d, t, "x", 3, 4) for d, t in docs], "doc_id long, text string, rank string, score int, place int")
    right = spark.createDataFrame([(i, t, "x", 5) for i, t in items], "item_id long, text string, doc_id string, place int")
    return sorted((tuple(r) for r in lexical.search(left.repartition(3), right, **options).collect()), key=str)


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(lexical, "CHUNK", 64)


def test_the_table_in_chunks_and_blocks(spark, sf_dir, small_docs, small_chunks):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = list(zip(small_docs.doc_id.tolist(), small_docs.text.tolist()))
    want = brute(docs, items)
    assert result(spark, docs, items) == want
    assert result(spark, docs, items, max_terms=100) == want


def test_blocks_are_skipped_and_nothing_is_lost():
    rng = np.random.default_rng(1)
    scores = np.zeros((2000, 40), np.int32)
    for k in range(2000):  # ten topics of documents that share their terms
        own = rng.choice(4, 3, replace=False) + 4 * (k % 10)
        scores[k, own] = rng.integers(1, 1_000_000, 3)
    lists = lexical.build(scores)
    total = len(lists.start) - 1
    for b in range(total):
        held = lists.docs[lists.start[b] : lists.start[b + 1]]
        assert (lists.summary[b] == scores[held].max(0)).all()
    term, weight = np.array([0, 1, 2, 17]), np.array([3, 5, 0, 900])
    best = lexical.Best(20)
    visited = lexical.visit(lists, scores, np.arange(2000), term, weight, best)
    exact = scores[:, term].astype(np.int64) @ weight
    order = np.lexsort((np.arange(2000), -exact))[:20]
    assert best.doc.tolist() == order.tolist() and best.score.tolist() == exact[order].tolist()
    assert visited < sum(lists.first[t + 1] - lists.first[t] for t in term)


def test_products_are_whole():
    table = np.full((2, 3), 1_000_000, np.int32)
    weight = np.array([1, 2, 1 << 40])
    assert lexical.products(table, weight).tolist() == [1_000_000 * int(weight.sum())] * 2


def test_odd_cases(spark):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    docs = [(1, "Alpha beta, gamma"), (2, "alpha ALPHA\nbeta"), (3, None), (4, ""), (5, " .,;"), (6, long), (None, "alpha"), (7, "Ñandú ñandú été"),
            (8, "alpha beta"), (8, "alpha beta"), (9, "alpha beta"), (9, "w1 w1")]
    items = [(1, "alpha beta beta"), (2, None), (3, "..."), (4, "Ñandú"), (5, long[:5000]), (1, "gamma"), (None, "été"), (6, "absent")]
    assert result(spark, docs, items) == brute(docs, items)
    ties = [(k, "same words here") for k in range(50)] + [(50, "other")]
    assert result(spark, ties, items + [(7, "same other")]) == brute(ties, items + [(7, "same other")])
    assert result(spark, docs, []) == [] and result(spark, [], items) == []


def test_terms_of_bytes():
    for text in ("A-b_c'd 1.5 É　日本語\x7f\x00z {x}", "ÀÈ ß ſ K"):
        assert [t.decode() for t in lexical.terms(text)] == split(text)
