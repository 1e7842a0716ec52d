from __future__ import annotations

from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from lyceum.llm import jaccard


def grams(text: str, n: int = 5) -> set:
    w = (text or "").lower().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def brute(docs: dict[int, str], threshold: float = 0.8):
    """Class, number of links by document, over distinct texts."""
    by_text = defaultdict(list)
    for d, t in docs.items():
        by_text[t or ""].append(d)
    rep = {d: min(ds) for ds in by_text.values() for d in ds}
    sets = {r: grams(docs[r]) for r in set(rep.values())}
    links, root = defaultdict(int), {r: r for r in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and both / len(sets[a] | sets[b]) >= threshold:
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (find(r), r, links[r]) for d, r in rep.items()}


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.99999), (0.5, 0.9), (0.9, 0.999)):
        bands, rows = jaccard.choose_bands(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= jaccard.MAX_HASHES


def test_against_all_pairs(spark, small_docs):
    rng = np.random.default_rng(2)
    docs = dict(zip(small_docs.doc_id.tolist(), small_docs.text.tolist()))
    for k in range(60):  # near copies on both sides of the threshold
        words = docs[int(rng.integers(0, 150))].split()
        for _ in range(int(rng.integers(0, max(2, len(words) // 30)))):
            words[int(rng.integers(0, len(words)))] = "changed"
        docs[1000 + k] = " ".join(words)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.text_id, r.n_links) for r in jaccard.near_classes(frame).collect()}
    want = brute(docs)
    assert got == want
    assert sum(n for _, _, n in want.values()) > 20


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 7)


def test_a_large_group_in_blocks(spark, small_blocks):
    base = [f"w{i}" for i in range(60)]
    docs = {k: " ".join([*base[: 30 + k % 5], f"own{k}", *base[30 + k % 5 :]]) for k in range(40)}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.text_id, r.n_links) for r in jaccard.near_classes(frame).collect()}
    assert got == brute(docs)
    assert {c for c, _, _ in got.values()} == {0}


def test_a_doc_id_with_two_texts(spark):
    """Each text keeps its links."""
    a, b = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80))
    rows = [(1, a), (1, b), (2, a + " z"), (3, b + " z")]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_odd_cases(odd_docs, no_docs):
    rows = {r.doc_id: r for r in jaccard.near_classes(odd_docs).collect()}
    assert rows[1].class_id == rows[2].class_id == rows[3].class_id == 1 and rows[1].n_copies == 2
    assert rows[4].class_id == rows[5].class_id == 4 and rows[4].n_links == 0
    assert rows[6].class_id == rows[7].class_id == 6 and rows[8].class_id == rows[9].class_id == 8
    assert jaccard.near_classes(odd_docs).count() == odd_docs.count() - 1
    assert jaccard.near_classes(no_docs).count() == 0
    left = jaccard.keep_first(odd_docs)
    assert left.columns == odd_docs.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 4, 6, 8, 10, 10, 11, 12, 13]
    assert jaccard.keep_first(no_docs).count() == 0
