"""Ranked lexical search with posting lists in blocks of similar documents.

1. Items are taken in blocks of bounded vocabulary.  One pass over the documents counts documents, terms, and the documents that hold
   each term of the items.
2. A second pass indexes documents where they are read, some thousand at a time.  Each term has a posting list.  A list is
   clustered: some of its documents, spread evenly, are pivots, and each document joins the pivot to which its vector of term
   scores (in a random projection) is nearest.  A block's summary is the largest score of each term over its documents.
3. An item visits the blocks of its terms.  The product of its weights with a summary is at least the score of every document in the
   block, so a block below the item's twentieth best score so far holds none of its results and is skipped; the documents of all other
   blocks are scored exactly.  The best of one chunk of documents are the bar for the next.
4. A task returns each item's best documents; their ranks are merged by a window that cuts early.

Documents are not shuffled.  Weights and scores are whole numbers, so results do not depend on the order of work.

Cases: null texts have no terms; documents and items without terms are not in the result; rows without a doc_id are left
out of all counts; rows that repeat a doc_id or an item_id are documents or items of their own; equal scores go by ascending doc_id; other
columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lyceum.llm.tables import small_batches
from lyceum.llm.words import text_slices
from lyceum.sources.staging import stage

TOP = 20
#: Terms and bytes of a block of items; a single item may have more.
ITEM_TERMS, ITEM_BYTES = 4_096, 8 << 20
#: Documents of a chunk, and the cells of its table of scores.
CHUNK, CELLS = 2_048, 8 << 20
#: Documents of a posting block, on average.
BLOCK = 32
#: Dimensions of the projection in which documents are compared.
SKETCH = 16
#: Largest sum of products that doubles hold to the unit.
_EXACT = 1 << 53
# Bytes that stand between terms, and A-Z in lower case.
_TABLE = bytes(
    0x20 if b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b
    for b in range(256)
)


def terms(text: str | None) -> list[bytes]:
    """Terms of a text in their order."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Items(NamedTuple):
    ids: list[int | None]
    vocabulary: dict[bytes, int]
    term: list[np.ndarray]  # of each item, its terms' numbers
    times: list[np.ndarray]  # and how often each stands in it


def item_blocks(items: DataFrame, max_terms: int = ITEM_TERMS, max_bytes: int = ITEM_BYTES) -> Iterator[Items]:
    """Items with terms, in blocks; the driver holds one block and one partition of the table at a time."""
    now, size = Items([], {}, [], []), 0
    for row in items.select("item_id", "text").toLocalIterator():
        own = Counter(terms(row.text))
        if not own:
            continue
        more = sum(w not in now.vocabulary for w in own)
        if now.ids and (len(now.vocabulary) + more > max_terms or size + len(row.text) > max_bytes):
            yield now
            now, size = Items([], {}, [], []), 0
        now.ids.append(row.item_id)
        now.term.append(np.array([now.vocabulary.setdefault(w, len(now.vocabulary)) for w in own], np.int64))
        now.times.append(np.array(list(own.values()), np.int64))
        size += len(row.text)
    if now.ids:
        yield now


class Counts(NamedTuple):
    documents: int  # N
    terms: int  # L
    frequency: np.ndarray  # documents that hold each term of the items


def count(docs: DataFrame, vocabulary: dict[bytes, int]) -> Counts:
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        n = np.zeros(len(known) + 2, np.int64)
        for batch in batches:
            for _, texts in text_slices(batch):
                for text in texts:
                    if words := terms(text):
                        n[-2] += 1
                        n[-1] += len(words)
                        at = [known[w] for w in set(words) if w in known]
                        n[at] += 1
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], ["place", "n"])

    sums = np.zeros(len(vocabulary) + 2, np.int64)
    for row in docs.select("text").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        sums[row.place] = row.n  # one row for each term of the block of items
    return Counts(int(sums[-2]), int(sums[-1]), sums[:-2])


def weights(counts: Counts) -> np.ndarray:
    top = 2 * counts.documents + 2
    return np.array([math.floor(1000 * math.log(top / (2 * int(df) + 1))) for df in counts.frequency], np.int64)


def term_scores(tf: np.ndarray, n: np.ndarray, counts: Counts) -> np.ndarray:
    """A term's score in a document before its weight: at most a million."""
    long = 100 - 25 + (25 * n * counts.documents) // max(counts.terms, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * long)


class Lists(NamedTuple):
    """Posting lists in blocks."""

    docs: np.ndarray  # documents of all blocks, block by block
    start: np.ndarray  # of each block in ``docs``, and the end
    first: np.ndarray  # first block of each term, and the end
    summary: np.ndarray  # block x term: the largest score over the block's documents


def build(scores: np.ndarray, block: int = BLOCK) -> Lists:
    """Index of a table of scores, document x term."""
    n, width = scores.shape
    rng = np.random.default_rng(20241101)
    sketch = scores.astype(np.float32) @ rng.standard_normal((width, SKETCH)).astype(np.float32)
    sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
    term, doc = np.nonzero(scores.T)
    cut = np.searchsorted(term, np.arange(width + 1))
    starts, first = [], [0]
    for t in range(width):
        a, b = cut[t], cut[t + 1]
        pivots = -(-(b - a) // block)
        if pivots > 1:
            own = doc[a:b]
            centre = sketch[own[np.linspace(0, b - a - 1, pivots).astype(np.int64)]]
            near = (sketch[own] @ centre.T).argmax(1)
            order = np.argsort(near, kind="stable")
            doc[a:b] = own[order]
            near = near[order]
            begin = a + np.flatnonzero(np.concatenate([[True], near[1:] != near[:-1]]))
        else:
            begin = np.arange(a, a + pivots)
        starts.append(begin)
        first.append(first[-1] + len(begin))
    start = np.concatenate([*starts, [len(doc)]]).astype(np.int64)
    summary = np.empty((len(start) - 1, width), scores.dtype)
    for b in range(len(summary)):
        scores[doc[start[b] : start[b + 1]]].max(0, out=summary[b])
    return Lists(doc, start, np.array(first), summary)


def products(table: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Exact products of rows (each number at most a million) with an item's weights."""
    if int(weight.sum()) * 1_000_000 < _EXACT:
        return (table.astype(np.float64) @ weight.astype(np.float64)).astype(np.int64)
    return table.astype(np.int64) @ weight


class Best:
    """The best documents of one item so far: highest score, then smallest doc_id."""

    def __init__(self, top: int):
        self.top = top
        self.score, self.doc = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def bar(self) -> int:
        """A document needs this score to be among the best."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        good = score >= self.bar()
        score, doc = np.concatenate([self.score, score[good]]), np.concatenate([self.doc, doc[good]])
        order = np.lexsort((doc, -score))[: self.top]
        self.score, self.doc = score[order], doc[order]


def visit(lists: Lists, scores: np.ndarray, doc_ids: np.ndarray, term: np.ndarray, weight: np.ndarray, best: Best) -> int:
    """Adds the chunk's documents to an item's best ones; the number of blocks that were not skipped."""
    blocks = np.concatenate([np.arange(lists.first[t], lists.first[t + 1]) for t in term])
    if not len(blocks):
        return 0
    bounds = products(lists.summary[np.ix_(blocks, term)], weight)
    order = np.argsort(-bounds, kind="stable")
    blocks, bounds = blocks[order], bounds[order]
    seen = np.zeros(len(doc_ids), bool)
    done, step = 0, 4  # the most promising blocks first: they raise the bar for the others
    while done < len(blocks):
        fit = int(np.searchsorted(-bounds, -best.bar(), "right"))  # an equal bound may hold an equal score
        some = blocks[done : min(done + step, fit)]
        if not len(some):
            break
        sizes = lists.start[some + 1] - lists.start[some]
        places = np.repeat(lists.start[some] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        docs = np.unique(lists.docs[places])
        docs = docs[~seen[docs]]
        seen[docs] = True
        best.add(products(scores[np.ix_(docs, term)], weight), doc_ids[docs])
        done += len(some)
        step *= 4
    return done


def _search_block(docs: DataFrame, items: Items, counts: Counts, top: int, number: int) -> DataFrame:
    weight = weights(counts)
    wanted = [(term, times * weight[term]) for term, times in zip(items.term, items.times)]
    sent = docs.sparkSession.sparkContext.broadcast((items.vocabulary, wanted))
    width = len(items.vocabulary)
    chunk = max(64, min(CHUNK, CELLS // max(width, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, wanted = sent.value
        best = [Best(top) for _ in wanted]
        ids: list[int] = []
        place: list[np.ndarray] = []
        tf: list[np.ndarray] = []
        sizes: list[int] = []

        def flush() -> None:
            row = np.repeat(np.arange(len(ids)), [len(p) for p in place])
            scores = np.zeros((len(ids), width), np.int32)
            value = term_scores(np.concatenate(tf), np.repeat(np.array(sizes, np.int64), [len(p) for p in place]), counts)
            scores[row, np.concatenate(place)] = value
            lists, doc_ids = build(scores), np.array(ids, np.int64)
            for own, (term, weight) in zip(best, wanted):
                visit(lists, scores, doc_ids, term, weight, own)
            for kept in (ids, place, tf, sizes):
                kept.clear()

        for batch in batches:
            for part, texts in text_slices(batch):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), texts):
                    words = terms(text)
                    own = Counter(filter(known.__contains__, words))
                    if own:
                        ids.append(doc_id)
                        place.append(np.array([known[w] for w in own], np.int64))
                        tf.append(np.array(list(own.values()), np.int64))
                        sizes.append(len(words))
                        if len(ids) == chunk:
                            flush()
        if ids:
            flush()
        found = [len(b.doc) for b in best]
        if sum(found):
            item = pa.array(np.repeat(np.arange(len(best), dtype=np.int32), found))
            docs_, score = (pa.array(np.concatenate([getattr(b, k) for b in best])) for k in ("doc", "score"))
            yield pa.RecordBatch.from_arrays([item, docs_, score], ["place", "doc_id", "score"])

    found = docs.mapInArrow(run, "place int, doc_id long, score long").filter("score > 0")
    names = docs.sparkSession.createDataFrame(list(enumerate(items.ids)), "place int, item_id long")
    order = Window.partitionBy("place").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return stage(ranked.join(F.broadcast(names), "place").select("item_id", "rank", "doc_id", "score"), f"ranked-{number}")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, max_terms: int = ITEM_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each item with a score above 0."""
    spark: SparkSession = docs.sparkSession
    docs = small_batches(docs.filter("doc_id is not null").select("doc_id", "text"))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for k, block in enumerate(item_blocks(items, max_terms)):
        out = out.union(_search_block(docs, block, count(docs, block.vocabulary), top, k))
    return out
