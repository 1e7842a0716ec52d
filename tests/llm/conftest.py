from __future__ import annotations

import pandas as pd
import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with every awkward case: nulls, empty and long texts, repeated rows, extra columns with clashing names."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(20_000))
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
    rows = [
        (1, base, "a"), (2, base, "b"), (3, base + " extra", "c"), (4, None, "a"), (5, "", None), (6, "short text", "b"),
        (7, "short text", "c"), (8, long, "a"), (9, long, "b"), (10, "   \n \n", "a"), (10, "   \n \n", "a"), (None, base, "a"),
        (11, "x" * 5000, "d"), (12, "Shared line\nown line twelve", "e"), (13, "é ü 日本語 🎉 ▁ end", None),
    ]
    clash = [(d, t, s, "en", 0, "k", "g", 1, "h", 2.0, 1) for d, t, s in rows]
    names = ["doc_id", "text", "source", "lang", "n_chars", "key", "grp", "block", "h", "score", "n"]
    kinds = "doc_id long, text string, source string, lang string, n_chars long, key string, grp string, block int, h string, score double, n int"
    assert len(names) == len(clash[0])
    return spark.createDataFrame(clash, kinds)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def small_docs(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet")
