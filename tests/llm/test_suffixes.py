from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from lyceum.llm import suffixes


def brute(docs: list[tuple[int, str | None]], length: int = 100) -> dict:
    seen, out = set(), {}
    for d, text in sorted(docs):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if (s := raw[i : i + length]) in seen:
                gone[i : i + length] = True
            seen.add(s)
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(raw) else 0
        left = bytes(np.frombuffer(raw, np.uint8)[~gone]) if len(raw) else b""
        out[d] = (len(raw), int(gone.sum()), runs, hashlib.sha256(left).hexdigest())
    return out


def made(seed: int, n: int = 70) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 400))) for _ in range(10)]
    docs: list[tuple[int, str | None]] = [(n, None), (n + 1, ""), (n + 2, "a" * 700), (n + 3, "xyz " * 150), (n + 4, "b" * 99), (n + 5, "b" * 100)]
    for i in range(n):
        text = ""
        for _ in range(rng.randint(0, 4)):
            part = list(rng.choice(base))
            if part and rng.random() < 0.5:
                part[rng.randrange(len(part))] = "Q"
            text += "".join(part[rng.randint(0, len(part)) // 3 :])
        docs.append((i, text))
    return docs


@pytest.mark.parametrize("bucket", [suffixes.BUCKET, 1])
def test_against_brute_force(spark, monkeypatch, bucket):
    docs = made(bucket % 7)
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 20_000)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    ranges = suffixes.repeated(frame, bucket=bucket)
    monkeypatch.setattr(suffixes, "repeated", lambda *_: ranges)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digests(frame).collect()}
    assert got == brute(docs)


def test_given_documents(spark, small_docs):
    docs = list(zip(small_docs.doc_id.tolist(), small_docs.text.tolist()))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digests(frame).collect()}
    assert got == brute(docs)


def test_difference_cover_has_a_shift_for_every_pair():
    shifts = suffixes.cover_shifts()
    assert (shifts >= 0).all()
    cover = set(suffixes.COVER)
    for a in range(suffixes.PERIOD):
        for b in range(suffixes.PERIOD):
            assert {(a + shifts[a, b]) % suffixes.PERIOD, (b + shifts[a, b]) % suffixes.PERIOD} <= cover


def test_rows_of_one_doc_id_with_other_texts_are_documents_of_their_own(spark):
    rng = random.Random(8)
    shared, own, third = ("".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(3))
    rows = [(1, shared), (2, shared), (2, own), (3, own), (3, third), (3, third), (4, own + third)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed, r.n_bytes) for r in suffixes.digests(frame).collect())
    assert got == [(1, 0, 300), (2, 0, 300), (2, 300, 300), (3, 0, 300), (3, 0, 300), (3, 300, 300), (4, 600, 600)]


def test_one_string_in_two_texts_of_a_doc_id_stays_once(spark):
    rng = random.Random(9)
    shared, x, y = ("".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(3))
    frame = spark.createDataFrame([(5, shared + "X" + x), (5, shared + "Y" + y)], "doc_id long, text string")
    assert sorted(r.n_removed for r in suffixes.digests(frame).collect()) == [0, 200]


def test_odd_cases(odd_docs, no_docs):
    rows = suffixes.digests(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[2].n_removed == by[2].n_bytes > 0 and by[1].n_removed == 0 and by[9].n_removed == by[9].n_bytes
    assert by[None].n_removed == 0 and by[4].n_bytes == 0 and by[11].n_removed == 4_999
    assert suffixes.digests(no_docs).count() == 0
