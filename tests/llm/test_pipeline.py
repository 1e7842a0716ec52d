from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from lyceum.llm import lines, quality
from lyceum.llm.tables import documents
from tests.llm.test_decontaminate import grams
from tests.llm.test_jaccard import brute as near

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("public_tokenizers")


def without_boilerplate(docs: pd.DataFrame) -> dict[int, str]:
    sites, first = defaultdict(set), {}
    for d, t, s in sorted(zip(docs.doc_id, docs.text, docs.source)):
        for i, line in enumerate(t.split("\n")):
            if key := line.strip(" "):
                sites[key].add(s)
                first.setdefault(key, (d, i))
    out = {}
    for d, t in zip(docs.doc_id, docs.text):
        keep = [x for i, x in enumerate(t.split("\n")) if not (k := x.strip(" ")) or len(sites[k]) < lines.MIN_SITES or first[k] == (d, i)]
        out[d] = "\n".join(keep)
    return out


def test_stages_against_brute_force(spark, sf_dir):
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf_dir).collect()}
    scores = quality.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).toPandas()
    good = set(scores[scores.predicted == 1].doc_id)
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    texts = without_boilerplate(docs[docs.doc_id.isin(good)])
    classes = near(texts)
    kept = {d: t for d, t in texts.items() if classes[d][0] == d}
    items = [q for t in pd.read_parquet(f"{sf_dir}/benchmark.parquet").text if (q := grams(t))]
    clean = {d: t for d, t in kept.items() if not any(len(grams(t) & q) >= 0.8 * len(q) - 1e-9 for q in items)}
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))
    want = {d: hashlib.sha256(np.array(library.encode(t, add_bos=True, add_eos=True), "<u4").tobytes()).hexdigest() for d, t in clean.items()}
    assert got == want and len(kept) > len(clean) > 50


def test_stages_return_documents(spark, odd_docs, sf_dir):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for frame in (docs, docs.limit(0), odd_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, frame, sf_dir).schema.names == frame.schema.names
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()
