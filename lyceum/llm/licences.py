"""Licence scan: a trained paragraph classifier, confirmed by templates, with DataFrame functions only.

A paragraph is a run of lines up to a line that ends a sentence or one without letters and digits; a line that holds a whole notice by
itself is a paragraph of its own, and the other lines of its run are one.  So notices that are wrapped over lines or stand in
comments are read whole.  Paragraphs that hold a signal word are scored by a multinomial logistic regression on
sparse counts of word 1- and 2-grams (hashed).  It learns from the templates, sentences about licences that license nothing,
and the ordinary paragraphs of the whole corpus, of which one half by hash is learnt from and the other calibrates.  Weights are learnt for the
buckets of the fixed sentences; all others are 0.  Ordinary paragraphs with the same of these buckets are one row with their number, so what
is learnt from grows with the different rows.  A paragraph is given the best family if the
family's probability is above a limit, and is ``unknown`` otherwise; the limit is calibrated so that at most ``false_rate``
of the second half of the ordinary paragraphs, with template words mixed in, would pass.  A family is confirmed when a template of it has at least
``MATCH`` of its word pairs in the paragraph.

A paragraph without any signal word is no licence paragraph: no template is without one, so none could be confirmed.

Cases: null and empty texts have no paragraphs; every licence paragraph of a document gives a row, repeated ones too, and so
do repeated rows; a null doc_id is kept; long texts are scanned whole; a corpus without ordinary paragraphs still has the
fixed negatives; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyceum.llm.tables import BROADCAST_BYTES
from lyceum.sources.staging import stage

UNKNOWN = "unknown"
#: All ordinary paragraphs together weigh as much as this many rows, or their number if that is less.
ORDINARY_WEIGHT = 2_000
FALSE_RATE = 0.01
MATCH = 0.8
BUCKETS = 1 << 13
#: Template words that are mixed into ordinary paragraphs for the limit, rows of a partition to learn from, and steps of the limit.
MIXED = "the terms of the license"
FIT_ROWS, LIMIT_STEPS = 50_000, 1_000_000
#: Lines after which a paragraph ends: without letters and digits, or with a full stop at the end that does not follow a single letter.
EMPTY, STOP = r"^[^\p{L}\p{N}]*$", r"""[.!?](?<!\b\p{L}[.!?])["')\s]*$"""
#: What stands between words: other characters with the marks at either side, or marks at the ends of a text.
GAP = r"[.+-]*+[^\p{L}\p{N}.+©-][^\p{L}\p{N}©]*+|^[.+-]++|[.+-]++\z"
#: Stems of which every licence notice holds one.
SIGNALS = ["licen", "copyright", "permission", "redistribut", "warrant", "public domain", "(c)", "©", "spdx", "all rights reserved"]
#: Notices of licence families.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("gpl-2.0", "Licensed under the GNU General Public License, version 2."),
    ("gpl-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 3."),
    ("agpl-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("bsd", "Released under the BSD 3-Clause License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("cc0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright. All rights reserved."),
]
#: Sentences with signal words that license nothing.
NEGATIVES = [
    "The driver must show a valid driving license at the counter.",
    "The council renewed the fishing licence for another year.",
    "She asked for permission to leave early.",
    "Copyright law is taught in the second year.",
    "The warranty of the washing machine ended in March.",
    "The software license costs ten dollars a month.",
    "A licence may be requested at the town office.",
    "The firm bought a licensed copy of the program.",
    "Wealth is redistributed by taxes.",
    "The old songs are in the public domain.",
    "No permission was given to enter the building.",
    "The police searched the house without a warrant.",
    "Please read the license before you install it.",
    "He lost his medical license after the trial.",
    "Licensed teachers earn more than others.",
    "The terms of the license were changed without notice.",
]


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once: a filter and a lambda's body compute an expression wherever it stands in them."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-case words, marks at their ends dropped; version numbers stay whole."""
    words = F.trim(F.regexp_replace(F.lower(text), GAP, " "))
    return F.when(words == "", F.array().cast("array<string>")).otherwise(F.split(words, " "))


def _neighbours(words: Column) -> Column:
    """Each word but the last with the one after it; ``words`` is a column or a value computed once."""
    return F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, i: F.concat(a, F.lit(" "), F.get(words, i + 1)))


def pairs(words: Column) -> Column:
    return _once(words, lambda own: F.array_distinct(_neighbours(own)))


def _grams(df: DataFrame) -> DataFrame:
    """``t`` as counted 1- and 2-grams: ``features``, and its distinct pairs ``p``."""
    return _hashed(df.withColumn("w", tokens(F.col("t"))).withColumn("p", pairs(F.col("w"))).withColumn("g", F.concat("w", "p")))


def _hashed(df: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=BUCKETS, inputCol="g", outputCol="features", binary=True).transform(df)


def _buckets() -> Column:
    return F.unwrap_udt("features").getField("indices")


def _signals(text: Column) -> Column:
    return _once(F.lower(text), lambda low: reduce(or_, (low.contains(s) for s in SIGNALS)))


def _runs(text: Column) -> Column:
    """Runs of lines: structs of ``line``, the number of the first one, and ``lines``."""

    def cut(lines: Column) -> Column:
        breaks = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(EMPTY) | x.rlike(STOP), i)), lambda i: i.isNotNull())
        return _once(breaks, lambda at: F.zip_with(
            F.concat(F.array(F.lit(0)), F.transform(at, lambda i: i + 1)), F.concat(at, F.array(F.size(lines) - 1)),
            lambda a, b: F.struct(a.alias("line"), F.slice(lines, a + 1, b - a + 1).alias("lines"))))

    return _once(F.split(text, "\n"), cut)


def _marked(templates: list[tuple[str, list[str]]]) -> Column:
    """The lines of a run: ``paragraph`` (its number), ``t``, and whether it is a notice by itself."""
    known = F.array(*(F.array(*map(F.lit, t)) for _, t in templates))

    def whole(own: Column) -> Column:
        return F.exists(known, lambda t: F.size(F.array_intersect(own, t)) / F.size(t) >= MATCH)

    paired = F.transform("lines", lambda x: F.struct(x.alias("t"), F.when(_signals(x), pairs(tokens(x))).alias("p")))
    return F.transform(paired, lambda m, i: F.struct((F.col("line") + i).alias("paragraph"), m.t.alias("t"), F.coalesce(whole(m.p), F.lit(False)).alias("whole")))


def _paragraphs() -> Column:
    """``paragraph`` (its first line's number) and ``t``: lines that are notices by themselves, and what is left of the run."""
    alone = F.transform(F.filter("marked", lambda m: m.whole), lambda m: F.struct(m.paragraph.alias("paragraph"), m.t.alias("t")))
    rest = F.struct(F.get("other", F.lit(0)).paragraph.alias("paragraph"), F.array_join("other.t", "\n").alias("t"))
    return F.concat(alone, F.array(rest))


def _share(own: Column, template: list[str]) -> Column:
    """Share of a template's word pairs that a paragraph has."""
    return F.size(F.array_intersect(own, F.array(*map(F.lit, template)))) / len(template)


def _ordinary(docs: DataFrame, known: dict[int, str]) -> DataFrame:
    """``part, g, n``: every ordinary paragraph, as grams of its ``known`` buckets, counted; those of part 1 have ``MIXED`` before them."""
    runs = docs.select(F.explode(_runs(F.col("text"))).alias("r")).select(F.array_join("r.lines", "\n").alias("t"))
    chosen = runs.filter(_once(F.col("t"), lambda t: (F.trim(t) != "") & ~_signals(t)))
    halves = chosen.select("t", F.pmod(F.xxhash64("t"), F.lit(2)).alias("part"))
    mixed = halves.withColumn("t", F.when(F.col("part") == 1, F.concat(F.lit(MIXED + " "), "t")).otherwise(F.col("t")))
    gram_of = F.array(*(F.lit(known.get(i)) for i in range(BUCKETS)))
    grams = mixed.withColumn("w", tokens(F.col("t"))).select("part", F.concat("w", _neighbours(F.col("w"))).alias("g"))
    kept = _hashed(grams).select("part", F.filter(_buckets(), lambda i: F.get(gram_of, i).isNotNull()).alias("at"))
    counted = kept.groupBy("part", "at").agg(F.count(F.lit(1)).alias("n"))
    return stage(counted.select("part", F.transform("at", lambda i: F.get(gram_of, i)).alias("g"), "n"), "ordinary-paragraphs")


def train(docs: DataFrame, false_rate: float = FALSE_RATE) -> tuple[PipelineModel, list[str], float]:
    """Classifier, its class names and the calibrated limit."""
    spark = docs.sparkSession
    families = [UNKNOWN, *sorted({f for f, _ in TEMPLATES})]
    number = {f: float(i) for i, f in enumerate(families)}
    # A notice is seen alone and with a stranger's words around it.
    positive = [(text, number[f]) for f, text in TEMPLATES] + [(f"Notice: {text} See the file for details.", number[f]) for f, text in TEMPLATES]
    fixed = _grams(spark.createDataFrame(positive + [(t, 0.0) for t in NEGATIVES], "t string, label double"))
    # One gram for each bucket of the fixed sentences: it hashes to that bucket again.
    alone = _hashed(fixed.select(F.explode("g").alias("gram")).distinct().withColumn("g", F.array("gram")))
    known = {r.i: r.gram for r in alone.groupBy(F.get(_buckets(), F.lit(0)).alias("i")).agg(F.min("gram").alias("gram")).collect()}
    ordinary = _ordinary(docs, known)
    learnt = ordinary.filter("part = 0")
    rows, total = learnt.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    share = min(1.0, ORDINARY_WEIGHT / total) if total else 1.0
    weight = F.when(F.col("label") == 0.0, F.lit(1.0)).otherwise(F.lit(20.0))
    usual = _hashed(learnt).select("features", F.lit(0.0).alias("label"), (F.col("n") * F.lit(share)).alias("weight"))
    learner = LogisticRegression(maxIter=60, regParam=1e-3, family="multinomial", weightCol="weight")
    model = learner.fit(fixed.select("features", "label", weight.alias("weight")).union(usual).coalesce(1 + rows // FIT_ROWS))
    mixed = _hashed(ordinary.filter("part = 1")).select("features", "n").union(fixed.filter("label = 0").select("features", F.lit(1).alias("n")))
    best = F.array_max(F.slice(vector_to_array("probability"), 2, len(families)))
    steps = model.transform(mixed).groupBy((F.ceil(best * LIMIT_STEPS) / LIMIT_STEPS).alias("best")).agg(F.sum("n").alias("n"))
    limit = steps.agg(F.percentile("best", F.lit(1 - false_rate), F.col("n"))).first()[0]
    return model, families, max(limit or 0.0, 0.5)


def _similarity(spark) -> list[tuple[str, list[str]]]:
    rows = spark.createDataFrame(TEMPLATES, "f string, t string").select("f", pairs(tokens(F.col("t"))).alias("p")).collect()
    return [(r.f, r.p) for r in rows]


def scan(docs: DataFrame, false_rate: float = FALSE_RATE) -> DataFrame:
    """``doc_id, paragraph`` (number of its first line, from 0), ``family``, ``confirmed``, ``similarity`` and ``text`` of each licence paragraph."""
    chosen = docs.select("doc_id", "text")
    templates = _similarity(docs.sparkSession)
    found = stage(
        chosen.filter(_signals(F.col("text")))
        .select("doc_id", F.inline(_runs(F.col("text"))))
        .filter(_signals(F.array_join("lines", "\n")))
        .select("doc_id", _marked(templates).alias("marked"))
        .withColumn("other", F.filter("marked", lambda m: ~m.whole))
        .select("doc_id", F.inline(_paragraphs()))
        .filter(_signals(F.col("t"))),
        "licence-paragraphs",
    )
    model, families, limit = train(chosen, false_rate)
    # Equal paragraphs are scored once: a notice that a third of all documents share costs one row.
    distinct = stage(found.select("t").distinct(), "licence-texts")
    p = vector_to_array("probability")
    best = F.array_max(F.slice(p, 2, len(families)))
    name = F.element_at(F.array(*map(F.lit, families)), F.array_position(p, best).cast("int"))
    share = [(f, _share(F.col("p"), t)) for f, t in templates]
    own = F.greatest(F.lit(0.0), F.lit(0.0), *(F.when(F.col("family") == f, s) for f, s in share))
    scored = (
        model.transform(_grams(distinct))
        .withColumn("family", F.when((best >= limit) & (best >= F.get(p, F.lit(0))), name).otherwise(UNKNOWN))
        .withColumn("similarity", own)
        .select(F.col("t").alias("text"), "family", (F.col("similarity") >= MATCH).alias("confirmed"), "similarity")
    )
    ready = stage(scored, "licence-scores")
    size = ready.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    return found.join(F.broadcast(ready) if size <= BROADCAST_BYTES else ready, found.t == ready.text).select("doc_id", "paragraph", "family", "confirmed", "similarity", "text")
