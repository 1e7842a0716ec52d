from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest

from lyceum.llm import language_model as lm


def words(text):
    return [*(text or "").encode().lower().split(), b""]


def base(docs):
    """Brute force of everything but the model's own score."""
    train = Counter(w for d, t in docs if d is not None and zlib.crc32(str(d).encode()) % 7 != 2 for w in words(t))
    n, v = sum(train.values()), len(train)
    return n, [
        (d, len(words(t)), sum(train[w] > 0 for w in words(t)), sum(np.log10((train[w] + 1) / (n + v + 1)) for w in words(t))) for d, t in docs
    ]


@pytest.mark.parametrize("known", [lm.KNOWN, 40])
def test_base_score_against_brute_force(spark, small_docs, known):
    docs = list(zip(small_docs.doc_id.tolist(), small_docs.text.tolist()))
    rows = lm.score(spark.createDataFrame(docs, "doc_id long, text string"), rounds=1, known=known).collect()
    n, want = base(docs)
    got = {r.doc_id: r for r in rows}
    assert {r.train_tokens for r in rows} == {n} and len(rows) == len(docs)
    for d, size, seen, score in want:
        assert (got[d].n_tokens, got[d].n_known) == (size, seen) and got[d].base_score == pytest.approx(score, rel=1e-9)
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 7 == 2) and np.isfinite(got[d].score)


def some_model(seed=0):
    vocab = lm.Vocabulary([b"", *(f"w{i}".encode() for i in range(40))], np.arange(41, 0, -1), 1000, 60)
    model = lm.initial(vocab)
    rng = np.random.default_rng(seed)
    for p in (model.to_class, model.to_word, model.embed, model.recur):
        p += rng.normal(0, 0.3, p.shape).astype(np.float32)
    return vocab, model


def test_probabilities_add_up():
    _, model = some_model()
    h = np.random.default_rng(1).normal(size=(1, lm.HIDDEN)).astype(np.float32)
    every = np.arange(lm.SLOTS)
    logs, _ = lm.log_probability(model, np.repeat(h, lm.SLOTS, 0), every)
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)


def test_state_is_carried_over_windows_and_batches():
    _, model = some_model()
    rng = np.random.default_rng(2)
    seqs = [rng.integers(0, 42, n).astype(np.int32) for n in (1, 5, 64, 65, 200, 3)]
    whole = [lm.score_texts(model, [s], window=1000)[0] for s in seqs]
    assert np.allclose(lm.score_texts(model, seqs, batch=3, window=16), whole, rtol=1e-4)


def test_gradients():
    _, model = some_model()
    model = lm.Model(*(p.astype(np.float64) for p in model))
    seq = np.random.default_rng(3).integers(0, 42, 12).astype(np.int32)
    taken = []

    class Probe(lm.Trainer):
        def _adam(self, grads, count):
            taken.append([g.copy() for g in grads])

    probe = Probe(model)
    lm.WINDOW, before = 12, lm.WINDOW
    try:
        probe.learn([seq])
    finally:
        lm.WINDOW = before
    rng = np.random.default_rng(4)
    for p, g in zip(model, taken[0]):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        for place in (at, tuple(int(rng.integers(0, s)) for s in p.shape)):
            old, eps = p[place], 1e-3
            p[place] = old + eps
            up = lm.score_texts(model, [seq])[0]
            p[place] = old - eps
            down = lm.score_texts(model, [seq])[0]
            p[place] = old
            assert -(up - down) / (2 * eps) == pytest.approx(g[place], rel=0.05, abs=0.02)


def test_better_than_counts_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = lm.score(docs, one_in=1).filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert held["sum(score)"] > held["sum(base_score)"]


def test_odd_cases(odd_docs, no_docs):
    rows = lm.score(odd_docs, one_in=1).collect()
    n, want = base([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known) for r in rows) == sorted((d or -1, s, k) for d, s, k, _ in want)
    assert all(np.isfinite(r.score) for r in rows) and {r.train_tokens for r in rows} == {n}
    assert lm.score(no_docs).count() == 0
    lone = odd_docs.filter("doc_id is null")
    only = lm.score(lone).collect()
    assert [(r.n_known, r.train_tokens, r.base_score) for r in only] == [(0, 0, 0.0)]


def test_every_training_text_is_learnt_from_whole(spark, small_docs, monkeypatch):
    """The averages weigh tasks by the tokens that they learnt from: with the defaults these are all tokens of all training texts."""
    docs = list(zip(small_docs.doc_id.tolist(), small_docs.text.tolist()))
    frame = lm.training(spark.createDataFrame(docs, "doc_id long, text string"))
    staged = []
    monkeypatch.setattr(lm, "stage", lambda df, name, stage=lm.stage: staged.append((name, stage(df, name))) or staged[-1][1])
    lm.train(frame, lm.vocabulary(lm.count_words(frame)))
    learnt = sum(df.filter("part = 0").agg({"n": "sum"}).first()[0] or 0 for name, df in staged if name == "lm-copies")
    assert learnt == base(docs)[0]


def test_better_than_counts_with_the_defaults(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = lm.score(docs).filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert held["sum(score)"] > held["sum(base_score)"]


def test_lanes_learn_what_texts_learn_alone():
    """Gradients of texts that share lanes are the sums of those of each text by itself."""
    _, model = some_model()
    model = lm.Model(*(p.astype(np.float64) for p in model))
    rng = np.random.default_rng(6)
    seqs = [np.append(rng.integers(2, 42, n), lm.END_SLOT).astype(np.int32) for n in (3, 0, 5, 2, 4)]

    class Probe(lm.Trainer):
        def _adam(self, grads, count):
            taken.append((count, [g.copy() for g in grads]))

    def learnt(groups):
        taken.clear()
        for group in groups:
            Probe(model).learn(group)
        return sum(c for c, _ in taken), [sum(g) for g in zip(*(g for _, g in taken))]

    taken, before = [], (lm.WINDOW, lm.FIRST_LANES)
    lm.WINDOW, lm.FIRST_LANES = 40, 2
    try:
        together, alone = learnt([seqs]), learnt([[s] for s in seqs])
    finally:
        lm.WINDOW, lm.FIRST_LANES = before
    assert together[0] == alone[0] == sum(map(len, seqs))
    assert all(np.allclose(a, b) for a, b in zip(together[1], alone[1]))


def test_one_softmax_over_the_words_of_all_classes(monkeypatch):
    """Each class had a softmax of its own, mostly over few tokens."""
    _, model = some_model()
    h = np.random.default_rng(7).normal(size=(lm.SLOTS, lm.HIDDEN)).astype(np.float32)
    calls, every = [], np.arange(lm.SLOTS)
    monkeypatch.setattr(lm, "_softmax", lambda x, softmax=lm._softmax: calls.append(x.shape) or softmax(x))
    logs, _ = lm.log_probability(model, h, every)
    assert len(calls) == 2
    monkeypatch.setattr(lm, "BLOCK", 100)
    assert np.allclose(lm.log_scores(model, h, every), logs, rtol=1e-5)
