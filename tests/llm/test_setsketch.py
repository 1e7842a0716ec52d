from __future__ import annotations

from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from lyceum.llm import setsketch

UPPER = {c: c + 32 for c in range(65, 91)}


def shingles(text, n: int = 5) -> frozenset:
    w = (text or "").translate(UPPER)
    for blank in "\t\n\x0b\x0c\r":
        w = w.replace(blank, " ")
    w = [x for x in w.split(" ") if x]
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(docs: list[tuple]):
    """Rows of the result by comparing all pairs of distinct sets."""
    docs = [(d, shingles(t)) for d, t in docs if d is not None]
    sets = sorted({s for _, s in docs if s}, key=sorted)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    inverted = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            inverted[g].append(k)
    for a, b in {p for ks in inverted.values() for p in combinations(ks, 2)}:
        both = len(sets[a] & sets[b])
        if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            root[find(a)] = find(b)
    place = {s: k for k, s in enumerate(sets)}
    least = {}
    for d, s in docs:
        if s:
            r = find(place[s])
            least[r] = min(least.get(r, d), d)
    own = [(d, len(s), least[find(place[s])] if s else d) for d, s in docs]
    return sorted((d, n, c, d == c) for d, n, c in own)


def result(spark, docs):
    frame = spark.createDataFrame([(d, t, "x", b"y", 1) for d, t in docs], "doc_id long, text string, sid string, regs binary, comp int")
    return sorted(tuple(r) for r in setsketch.near_duplicates(frame).collect())


def varied(words: list[str], rng, changes: int) -> str:
    words = list(words)
    for _ in range(changes):
        words[int(rng.integers(0, len(words)))] = f"new{rng.integers(0, 999)}"
    return " ".join(words)


def test_the_table_with_near_copies(spark, small_docs):
    rng = np.random.default_rng(2)
    docs = list(zip(small_docs.doc_id.tolist(), small_docs.text.tolist()))
    for k in range(120):  # on both sides of the threshold
        words = docs[int(rng.integers(0, 150))][1].split()
        docs.append((5000 + k, varied(words, rng, int(rng.integers(0, max(2, len(words) // 40))))))
    want = brute(docs)
    assert result(spark, docs) == want
    assert sum(not kept for *_, kept in want) > 60


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(setsketch, "BLOCK", 6)


def test_large_groups_in_blocks(spark, small_blocks):
    """A group beyond a block: a tight one, a chain, and texts that are likely, but not linked."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(400)]
    docs = [(k, varied(base, rng, k % 6)) for k in range(40)]
    docs += [(100 + k, varied(base, rng, 9 + k % 5)) for k in range(30)]
    chain = [f"c{i}" for i in range(300)]
    for k in range(30):
        docs.append((200 + k, " ".join(chain)))
        chain[10 * k] = f"turn{k}"
        chain[10 * k + 5] = f"turn{k}"
    assert result(spark, docs) == brute(docs)


def test_odd_cases(spark, odd_docs, no_docs):
    got = sorted(tuple(r) for r in setsketch.near_duplicates(odd_docs).collect())
    assert got == brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert setsketch.near_duplicates(no_docs).count() == 0


def test_a_doc_id_with_two_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80))
    docs = [(1, a), (1, b), (2, a + " z"), (3, b + " z"), (4, "Ñ É one two three"), (5, "ñ é one two three"), (6, "ONE two"), (7, "one two"), (8, "one\vtwo")]
    assert result(spark, docs) == brute(docs)


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(5)
    shared, left, right = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (600, 200, 100))

    def regs(h):
        return setsketch.registers(np.zeros(len(h), np.int64), h, 1, 2048)

    a, b = regs(np.concatenate([shared, left])), regs(np.concatenate([shared, right]))
    union = regs(np.concatenate([shared, left, right]))
    assert (setsketch.merge(a, b) == union).all()
    sizes = np.array([800.0]), np.array([700.0])
    more, less = (a > b).sum(1), (a < b).sum(1)
    got = setsketch.estimate(*sizes, more, less, 2048 - more - less)[0]
    assert abs(got - 600 / 900) < 0.04


def test_bands_and_margin():
    bands, rows = setsketch.choose_bands()
    assert (1 - 0.85**rows) ** bands <= setsketch.MISS and bands * rows <= setsketch.REGISTERS
    rng, n = np.random.default_rng(6), 256
    size = np.full(200_000, 1000)
    same = rng.binomial(n, 0.85, len(size))  # pairs at the threshold: none may go
    more = rng.binomial(n - same, 0.5)
    less = n - same - more
    best = setsketch.estimate(size.astype(float), size.astype(float), more, less, same)
    half = np.full(len(size), 0.5)
    loss = setsketch.likelihood(best, half, half, more, less, same) - setsketch.likelihood(np.full(len(size), 0.85), half, half, more, less, same)
    assert loss[best < 0.85].max() < setsketch.MARGIN
