from __future__ import annotations

import numpy as np

from lyceum.llm import decontaminate as d


def grams(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(docs, items, share=0.8):
    out = set()
    for i, t in items:
        q = grams(t)
        size = len(next(iter(q))) if q else 5
        for k, x in docs:
            w = (x or "").lower().split()
            have = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)}
            if q and len(q & have) >= share * len(q) - 1e-9:
                out.add((k, i, len(q), len(q & have)))
    return out


def cases():
    rng = np.random.default_rng(4)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(int(rng.integers(1, 60))))) for k in range(30)] + [(90, None), (91, ""), (92, "i3w0 i3w1")]
    docs = []
    for k in range(200):
        body = [f"d{x}" for x in rng.integers(0, 500, int(rng.integers(0, 3000 if k % 50 == 0 else 200)))]
        words = items[k % 30][1].split()
        for _ in range(k % 7):  # edits
            words[int(rng.integers(0, len(words)))] = "edit"
        cut = int(rng.integers(0, len(words)))
        at = int(rng.integers(0, len(body) + 1))
        parts = [words[:cut], words[cut:]] if k % 3 else [words]
        docs.append((k, " ".join([*body[:at], *parts[0], *(body[at:] if k % 3 else []), *(parts[1] if k % 3 else []), *body[at:]])))
    return docs, items


def test_against_brute_force(spark):
    docs, items = cases()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for limit in (d.ITEM_BYTES, 0):  # broadcast, and shuffled
        got = {(r.doc_id, r.item_id, r.n_grams, r.n_found) for r in d.find(frame, bench, item_bytes=limit).collect()}
        assert got == want
    assert len(want) > 40


def test_signature_bound():
    q = np.arange(1, 3000)
    k, least = d.signature_size(q, 0.8)
    lack = q - np.ceil(0.8 * q - 1e-9).astype(int)
    assert (k <= q).all() and (least >= 1).all() and (least <= np.maximum(k - lack, 1)).all()


def test_odd_cases(spark, odd_docs, no_docs):
    bench = spark.createDataFrame(
        [(1, "one two three four five six seven eight", 7), (1, "one two three four five six seven eight", 7), (2, None, 7), (3, "short TEXT", 7), (None, "x", 7)],
        "item_id long, text string, doc_id int",
    )
    got = {(r.doc_id, r.item_id) for r in d.find(odd_docs, bench).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (6, 3), (7, 3)}
    left = d.drop_contaminated(odd_docs, bench)
    assert left.columns == odd_docs.columns and left.count() == odd_docs.count() - 5
    assert d.find(no_docs, bench).count() == 0 and d.find(odd_docs, bench.limit(0)).count() == 0


def test_rows_of_a_doc_id_are_judged_alike_at_every_size(spark):
    item = " ".join(f"t{i}" for i in range(12))
    words = item.split()
    docs = spark.createDataFrame([(1, " ".join(words[:8])), (1, " ".join(words[4:])), (2, "x " + item), (2, "other")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    found = [sorted(tuple(r) for r in d.find(docs, items, item_bytes=size).collect()) for size in (d.ITEM_BYTES, 0)]
    assert found[0] == found[1] == [(2, 7, 8, 8, 1.0)]
