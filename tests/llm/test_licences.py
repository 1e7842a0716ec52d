from __future__ import annotations

import re
import textwrap

import numpy as np
import pytest
from pyspark.ml.feature import HashingTF

from lyceum.llm import licences

#: Beginnings of notices as they stand in source files.
NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


@pytest.fixture(scope="module")
def scanned(spark):
    ordinary = [(k, f"the cat {k} sat on the mat\nand looked at {k * 7} birds in the old garden", None) for k in range(300)]
    planted = [
        (1000 + i, f"first line\n{text}\nlast line", family) for i, (family, text) in enumerate(licences.TEMPLATES)
    ] + [(2000, "Please renew your fishing licence at the harbour office before Monday.", None), (2001, None, None), (2002, "", None)]
    rows = ordinary + planted + [planted[0]]
    frame = spark.createDataFrame([(d, t, f, "x", 1) for d, t, f in rows], "doc_id long, text string, t string, family string, p int")
    return planted, licences.scan(frame).toPandas()


def test_every_template_is_found_and_confirmed(scanned):
    planted, got = scanned
    for d, _, family in planted[: len(licences.TEMPLATES)]:
        own = got[got.doc_id == d]
        assert len(own) == (2 if d == 1000 else 1) and (own.paragraph == 1).all()
        assert (own.family == family).all() and own.confirmed.all()


def test_other_mentions_are_unknown(scanned):
    _, got = scanned
    other = got[got.doc_id == 2000]
    assert other.family.tolist() == ["unknown"] and not other.confirmed.any()
    assert not got.doc_id.lt(1000).any() and not got.doc_id.isin([2001, 2002]).any()


def test_signal_words_cover_the_templates():
    for _, text in licences.TEMPLATES:
        assert any(s in text.lower() for s in licences.SIGNALS), text


def test_empty_table_and_native_plan(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out = licences.scan(docs)
    assert out.count() == 0
    plan = out._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def wrapped():
    """Notices at several widths, bare and in comments, between other lines."""
    for family, text in NOTICES.items():
        for width in (30, 40, 70, 76, 80):
            for mark in ("", " * ", "# ", "// ", "-- "):
                body = "\n".join(mark + line for line in textwrap.wrap(text, width))
                yield family, f"int main() {{\n\n{mark}Some words before.\n{body}\n\nimport nothing\n"


@pytest.fixture(scope="module")
def wrapped_scan(spark):
    texts = list(wrapped())
    ordinary = [(5000 + k, f"the cat {k} sat on the mat and\nlooked at {k * 7} birds. It\nwas warm") for k in range(200)]
    rows = [(k, t) for k, (_, t) in enumerate(texts)] + ordinary + [
        (None, "SPDX-License-Identifier: MIT"),
        (9000, "a\nReleased under the MIT License.\nb of the licence\nc\nd " + "word " * 50_000),
        (9001, "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: MIT"),
        (9001, "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: MIT"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return texts, rows, docs, licences.scan(docs).toPandas()


def test_wrapped_notices_are_confirmed(wrapped_scan):
    texts, _, _, got = wrapped_scan
    for k, (family, text) in enumerate(texts):
        own = got[(got.doc_id == k) & got.confirmed]
        assert own.family.tolist() == [family], (family, text, got[got.doc_id == k])
    assert not got.doc_id.between(5000, 8999).any()


def plain_tokens(text):
    words = re.sub(r"[^\w.+©-]+|_", " ", text.lower()).split(" ")
    return [w for w in (re.sub(r"^[.+-]+|[.+-]+$", "", w) for w in words) if w]


def plain_pairs(text):
    words = plain_tokens(text)
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def share(text):
    return max(len(plain_pairs(t) & plain_pairs(text)) / len(plain_pairs(t)) for _, t in licences.TEMPLATES)


def signal(text):
    return any(s in text.lower() for s in licences.SIGNALS)


def plain_paragraphs(text):
    run, first = [], 0
    for i, line in enumerate(text.split("\n") + [""]):
        run.append((i, line))
        stop = re.search(r"""[.!?]["')\s]*$""", line)
        if not re.search(r"[^\W_]", line) or (stop and not re.search(r"\b[^\W\d_]$", line[: stop.start()])):
            whole = [(i, x) for i, x in run if signal(x) and share(x) >= licences.MATCH]
            rest = [(i, x) for i, x in run if (i, x) not in whole]
            yield from whole
            if rest:
                yield rest[0][0], "\n".join(x for _, x in rest)
            run = []


def test_against_a_plain_scan(spark, wrapped_scan):
    """Paragraphs, similarity, and families from the fitted weights, one paragraph at a time."""
    _, rows, docs, got = wrapped_scan
    model, families, limit = licences.train(docs)
    weights, bias, hashing = model.coefficientMatrix.toArray(), np.array(model.interceptVector), HashingTF(numFeatures=licences.BUCKETS)
    want = []
    for d, text in rows:
        for i, t in plain_paragraphs(text):
            if not signal(t):
                continue
            t = t.rstrip("\n")
            at = sorted({hashing.indexOf(g) for g in {*plain_tokens(t), *plain_pairs(t)}})
            logits = weights[:, at].sum(1) + bias
            p = np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
            k = int(p[1:].argmax()) + 1
            family = families[k] if p[k] >= limit and p[k] >= p[0] else licences.UNKNOWN
            own = [len(plain_pairs(x) & plain_pairs(t)) / len(plain_pairs(x)) for f, x in licences.TEMPLATES if f == family]
            want.append((-1 if d is None else d, i, family, round(max(own, default=0.0), 9)))
    found = [(-1 if r.doc_id != r.doc_id else int(r.doc_id), r.paragraph, r.family, round(r.similarity, 9)) for r in got.itertuples()]
    assert sorted(found) == sorted(want)


def test_every_ordinary_paragraph_is_counted(spark):
    """More paragraphs than an earlier sample of 4,000 took; the second half has the template words before it."""
    docs = spark.range(700).selectExpr("concat_ws('\\n\\n', transform(sequence(1, 10), k -> concat('the terms ', id * 10 + k, ' of rain'))) AS text")
    of, known = HashingTF(numFeatures=licences.BUCKETS), ["the terms", "of the", "the license", "license the"]
    counted = licences._ordinary(docs, {of.indexOf(g): g for g in known}).toPandas()
    assert counted.n.sum() == 7000 and set(counted.part) == {0, 1}
    for part, grams in counted[["part", "g"]].itertuples(index=False):
        assert set(grams) >= ({"the terms"} if part == 0 else set(known))


def test_words_at_odd_marks(spark):
    texts = ["", " ", ".", "..a", "a..", "a.-b", "a. -b", "- a .b. +", "v2.0, (c) 3.0+;x", "a\n\n.b\r", "é-ß ©. 5", "\U0001d4d0 .\U0001f600. z"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = docs.select("text", licences.tokens(docs.text).alias("w"), licences.pairs(licences.tokens(docs.text)).alias("p")).collect()
    for text, words, own in got:
        assert words == plain_tokens(text) and set(own) == plain_pairs(text), text


def test_a_text_is_split_and_lowered_once(spark):
    """The lines of a text were split again for every run of lines, and a text was lowered again for every signal word."""
    docs = spark.createDataFrame([("a\nb",)], "text string")
    plan = docs.select(licences._runs(docs.text).alias("r"), licences._signals(docs.text).alias("s"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == plan.count("lower(") == 1
