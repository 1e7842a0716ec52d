"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed once from whole texts on the executors and staged as narrow numeric rows; no text is shuffled.
The trees are fitted in numpy on at most ``sample`` labelled rows and flattened into arrays; scoring walks all trees of a
batch with array operations.

Cases: a null text counts as empty and gets a score like any other; rows without a label are scored only; a null label is
no label; several labels of a document vote (a tie counts as 1); no labelled rows at all give the score 0.5 everywhere;
repeated rows are scored row by row; a null doc_id is scored and never learnt from; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyceum.llm.tables import small_batches
from lyceum.llm.words import grams, text_slices, words
from lyceum.sources.staging import stage

#: Rows that a model is fitted on, at most: those with the smallest hashes.
SAMPLE = 20_000
MARKS = "|#$%&*!?.,;:'\"(){}[]<>@/\\=_-+~"
FEATURES = [
    "log_bytes", "log_words", "mean_word", "sd_word", "longest_word", "words_per_line", "distinct_words", "top_word",
    "repeated_words", "distinct_pairs", "distinct_lines", "upper", "digit", "space", "high_bytes", "capital_words", "marked_words",
    *(f"mark_{ord(c)}" for c in MARKS),
]


def _share(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    return x / np.maximum(n, 1)


def _distinct(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each document and the count of its most frequent one."""
    if not len(doc):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    fresh = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])]))
    top = np.zeros(n)
    np.maximum.at(top, d[fresh], np.diff(np.append(fresh, len(d))))
    return np.bincount(d[fresh], minlength=n).astype(float), top


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of ``FEATURES`` for each text, from all of it."""
    n = len(texts)
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    size = np.fromiter(map(len, raw), np.int64, n)
    begin = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    w = words(texts)
    count = np.diff(w.first).astype(float)
    length = (w.end - w.start).astype(float)
    total = np.bincount(w.doc, length, n)
    square = np.bincount(w.doc, length * length, n)
    longest = np.zeros(n)
    np.maximum.at(longest, w.doc, length)

    def per_doc(hit: np.ndarray) -> np.ndarray:
        return np.add.reduceat(hit, begin, dtype=np.int64).astype(float) if n else np.zeros(0)

    upper = (data >= 65) & (data <= 90)
    line_of = [t.split("\n") if t else [] for t in texts]
    lines = np.array([sum(1 for x in ls if x) for ls in line_of], float)
    distinct_lines = np.array([len({x for x in ls if x}) for ls in line_of], float)
    distinct, top = _distinct(w.doc, w.hash, n)
    pairs = grams(w, 2, whole_short=False)
    distinct_pairs, _ = _distinct(pairs.doc, pairs.hash, n)
    again = np.concatenate([[False], (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])]) if len(w.hash) else np.zeros(0, bool)
    tail = w.data[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    marked = ~(((tail >= 97) & (tail <= 122)) | (tail >= 128) | ((tail >= 48) & (tail <= 57)) | (tail == 46) | (tail == 44))
    starts_upper = upper & np.concatenate([[True], np.isin(data[:-1], [9, 10, 13, 32])])
    mean = _share(total, count)
    bytes_ = size.astype(float)
    columns = [
        np.log1p(bytes_), np.log1p(count), mean, np.sqrt(np.maximum(_share(square, count) - mean**2, 0)), longest,
        _share(count, lines), _share(distinct, count), _share(top, count), _share(np.bincount(w.doc[again], minlength=n), count),
        _share(distinct_pairs, np.maximum(count - 1, 0)), _share(distinct_lines, lines), _share(per_doc(upper), bytes_),
        _share(per_doc((data >= 48) & (data <= 57)), bytes_), _share(per_doc(data == 32), bytes_), _share(per_doc(data >= 128), bytes_),
        _share(per_doc(starts_upper), count), _share(np.bincount(w.doc[marked], minlength=n), count),
    ]
    # One histogram of bytes per document instead of a pass for each mark.
    marks = np.frombuffer(MARKS.encode(), np.uint8)
    code = np.full(256, -1)
    code[marks] = np.arange(len(marks))
    at = np.flatnonzero(code[data] >= 0)
    owner = np.searchsorted(begin, at, "right") - 1
    table = np.bincount(owner * len(marks) + code[data[at]], minlength=n * len(marks)).reshape(n, len(marks))
    return np.column_stack([*columns, table / np.maximum(bytes_, 1)[:, None]])


class Trees(NamedTuple):
    """Trees as flat arrays: node i of tree t stands at ``t * nodes + i``, its children at ``2 i + 1`` and ``2 i + 2``."""

    base: float
    depth: int
    nodes: int
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0) -> Trees:
    """Boosting with the logistic loss on feature histograms; a node splits by the largest gain in the loss."""
    nodes = 2 ** (depth + 1) - 1
    inner = 2**depth - 1
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share))) if len(y) else 0.0
    feature = np.zeros(trees * nodes, np.int32)
    threshold = np.full(trees * nodes, np.inf)
    value = np.zeros(trees * nodes)
    if len(y) == 0 or y.min() == y.max():
        return Trees(base, depth, nodes, feature, threshold, value)
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    slot = binned + np.arange(d) * bins
    raw = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-12)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            index = ((at - first)[:, None] * (d * bins) + slot).ravel()
            g, h = (
                np.bincount(index, np.repeat(v, d), width * d * bins).reshape(width, d, bins).cumsum(2) for v in (grad, hess)
            )
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + l2) + (gt - g) ** 2 / (ht - h + l2) - gt**2 / (ht + l2)
            gain[(h < 1.0) | (ht - h < 1.0)] = 0
            flat = gain.reshape(width, -1)
            best = flat.argmax(1)
            for k in np.flatnonzero(flat[np.arange(width), best] > 1e-9):
                j, b = divmod(int(best[k]), bins)
                if b < len(cuts[j]):
                    feature[t * nodes + first + k] = j
                    threshold[t * nodes + first + k] = cuts[j][b]
            node = t * nodes + at
            at = 2 * at + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = at - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
        value[t * nodes + inner : (t + 1) * nodes] = -rate * g / (h + l2)
        raw += value[t * nodes + at]
    return Trees(base, depth, nodes, feature, threshold, value)


def predict(model: Trees, x: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each row: all trees are walked level by level at once."""
    trees = len(model.value) // model.nodes
    root = np.arange(trees) * model.nodes
    at = np.zeros((len(x), trees), np.int64)
    row = np.arange(len(x))[:, None]
    for _ in range(model.depth):
        node = root + at
        at = 2 * at + 1 + (x[row, model.feature[node]] > model.threshold[node])
    return 1 / (1 + np.exp(-(model.base + model.value[root + at].sum(1))))


def features(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the array ``x`` of its statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                x = statistics(texts)
                offsets = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "x"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, x array<double>")


def votes(labels: DataFrame, label: str = "quality") -> DataFrame:
    """One label for each labelled document."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    return known.groupBy("doc_id").agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("y"))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(x: DataFrame, labels: DataFrame, sample: int = SAMPLE, **settings) -> Trees:
    """Trees from labelled rows of ``features`` outside the held-out third, ``sample`` rows at most."""
    rows = (
        x.filter(~held_out()).join(votes(labels), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    ).select("x", "y").toArrow()
    table = np.asarray(rows["x"].combine_chunks().flatten(), float).reshape(len(rows), len(FEATURES))
    return fit(table, np.asarray(rows["y"], float), **settings)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    x = stage(features(docs), "quality-features")
    sent = docs.sparkSession.sparkContext.broadcast(tuple(train(x, labels, sample)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Trees(*sent.value)
        for batch in batches:
            table = np.asarray(batch.column("x").flatten(), float).reshape(batch.num_rows, len(FEATURES))
            p = predict(model, table) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    scored = x.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Rows of ``docs`` that the classifier accepts.  Scores are found again by position in the task, so no text moves."""
    x = stage(features(docs), "quality-features")
    sent = docs.sparkSession.sparkContext.broadcast(tuple(train(x, labels, sample)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Trees(*sent.value)
        for batch in batches:
            for part, texts in text_slices(batch):
                yield part.filter(pa.array(predict(model, statistics(texts)) >= 0.5))

    return small_batches(docs).mapInArrow(run, docs.schema)
