from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from lyceum.llm import pieces

tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def model():
    return pieces.load(tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))


def awkward() -> list[str]:
    rng = random.Random(1)
    texts = ["", "   ", " a", "a  b   c    d" * 5, " " * 5000, "▁▁x▁ y", "<s> </s> <0x41>", "日本語🎉🎉", "a\tb\n\n\nc\r\n", "aaaa" * 700, "\x00\x01", "hahaha" * 900, "0" * 40 + "  " * 9]
    return texts + ["".join(rng.choice("abthe in  ▁\n.,0é日xyzron") for _ in range(rng.randint(0, 60))) for _ in range(400)]


def test_same_ids_and_texts_as_the_library(model, library):
    tool, back = pieces.Encoder(pieces.merge_tables(model)), pieces.Decoder(model)
    texts = awkward()
    for text, packed, ids in zip(texts, tool.encode(texts), library.encode(texts, add_bos=True, add_eos=True)):
        assert np.frombuffer(packed, "<u4").tolist() == ids, text[:40]
        assert back.decode(packed) == library.decode(ids), text[:40]


def test_bytes_that_are_no_text(model, library):
    for ids in ([1, 200, 131, 2], [300, 228, 400], [], [1], [2, 29871, 29871, 300]):
        packed = np.array(ids, "<u4").tobytes()
        assert pieces.Decoder(model).decode(packed) == library.decode(ids)


def test_merge_order_where_a_merge_makes_a_better_pair():
    # "ab" ranks behind "aba": after the first "ab" the new pair comes before the second "ab".
    names = ["<unk>", "<s>", "</s>", "a", "b", "▁", "aba", "ba", "ab"]
    made = pieces.Model(names, [2, 3, 3, 1, 1, 1, 1, 1, 1], [0, 0, 0, 0, 0, 0, -1.0, -9.0, -5.0], 1, 2, 0, False, False, " ? ")
    ids = np.frombuffer(pieces.Encoder(pieces.merge_tables(made)).encode(["abab"])[0], "<u4")
    assert [names[i] for i in ids] == ["<s>", "aba", "b", "</s>"]


def test_unknown_characters_in_a_row_are_one_unknown():
    made = pieces.Model(["<unk>", "<s>", "</s>", "a"], [2, 3, 3, 1], [0.0] * 4, -1, -1, 0, False, False, " ? ")
    assert np.frombuffer(pieces.Encoder(pieces.merge_tables(made)).encode(["xxaxx"])[0], "<u4").tolist() == [0, 3, 0]


def test_query_rows(spark, odd_docs, no_docs, model, library):
    rows = pieces.digests(odd_docs, model).collect()
    texts = [r.text or "" for r in odd_docs.select("text").collect()]
    want = sorted(hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest() for i in library.encode(texts, add_bos=True, add_eos=True))
    assert sorted(r.ids_sha256 for r in rows) == want
    assert {r.n_tokens for r in rows if r.doc_id in (4, 5)} == {2}
    assert pieces.digests(no_docs, model).count() == 0
    kept = pieces.encode(odd_docs, model)
    assert set(kept.columns) == set(odd_docs.columns) - {"text"} | {"ids"}
