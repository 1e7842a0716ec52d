"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Test items are partitioned by the number of their distinct n-grams (powers of two).  An item's signature is its bottom-k
MinHash: the ``k`` grams with the smallest hashes, ``k`` set for its partition.  A document that contains a share ``c`` or
more of an item's ``q`` grams lacks ``floor((1 - c) q)`` of them at most, so at least ``k - floor((1 - c) q)`` of the
signature occur in it however long the document is: no item at the threshold is missed.  Candidates are verified on
the full set of the item's grams.

Items are few beside documents.  While their grams fit ``ITEM_BYTES`` they are broadcast and documents are not shuffled.
Beyond that, document grams meet the signatures, and then the full items, in shuffled joins.

Cases: null texts count as empty; an item of 1 to n - 1 words has one gram of all its words, found wherever these words
stand in a row; an item without words is in no document; rows that repeat an item_id are one item with the grams of all its rows; rows
that repeat a doc_id are judged each on its own, and the largest number found counts; rows without an id are left out; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyceum.llm.tables import sized, small_batches
from lyceum.llm.words import grams, text_slices, words
from lyceum.sources.staging import stage

WORDS = 5
CONTAINMENT = 0.8
#: Signature grams beyond those that a contained item may lack.
SPARE = 8
#: Broadcast items while their grams have at most this many bytes.
ITEM_BYTES = 32 << 20


def _shingles(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text index and hash of the distinct grams: n words, or all words of a shorter text."""
    g = grams(words(texts), n)
    pairs = np.unique(np.rec.fromarrays([g.doc, g.hash], names="d,h")) if len(g.hash) else np.rec.fromarrays([g.doc, g.hash], names="d,h")
    return pairs.d, pairs.h


def item_grams(items: DataFrame, n: int = WORDS) -> DataFrame:
    """``item_id, h`` for each distinct gram of each item, and ``n`` words of that gram; staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                ids, w = part.column("item_id").to_numpy(False), words(texts)
                d, h = _shingles(texts, n)
                size = np.minimum(np.diff(w.first), n)[d].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids[d]), pa.array(h.view(np.int64)), pa.array(size)], ["item_id", "h", "n"])

    chosen = items.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return stage(chosen.mapInArrow(run, "item_id long, h long, n int").distinct(), "item-grams")


def signature_size(q: np.ndarray, containment: float) -> tuple[np.ndarray, np.ndarray]:
    """Of items with ``q`` grams: signature grams ``k`` by size partition, and how many of them a match has at least."""
    largest = 2 ** np.ceil(np.log2(q + 1)).astype(np.int64) - 1  # of the partition
    lack = lambda m: m - np.ceil(containment * m - 1e-9).astype(np.int64)
    k = np.minimum(q, lack(largest) + SPARE)
    return k, np.maximum(k - lack(q), 1)


class Items:
    """Items as flat arrays: grams sorted by hash, each with its item and whether it belongs to the signature."""

    def __init__(self, item: np.ndarray, h: np.ndarray, n: np.ndarray, containment: float):
        self.ids, item = np.unique(item, return_inverse=True)
        self.sizes = sorted(set(n.tolist()))
        self.q = np.bincount(item, minlength=len(self.ids))
        k, self.least = signature_size(self.q, containment)
        self.need = np.ceil(containment * self.q - 1e-9).astype(np.int64)
        order = np.lexsort((h, item))
        item, h = item[order], h[order].view(np.uint64)
        place = np.arange(len(h)) - np.searchsorted(item, item)
        chosen = place < k[item]
        self.signature = self._sorted(h[chosen], item[chosen])
        self.full = self._sorted(h, item)

    @staticmethod
    def _sorted(h: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(h, kind="stable")
        return h[order], item[order]

    def _count(self, table: tuple[np.ndarray, np.ndarray], doc: np.ndarray, h: np.ndarray, among: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """``doc * items + item`` keys of distinct document grams found in ``table``, and their numbers."""
        lo, hi = np.searchsorted(table[0], h, "left"), np.searchsorted(table[0], h, "right")
        times = hi - lo
        start = np.repeat(lo - np.concatenate([[0], np.cumsum(times)[:-1]]), times)
        item = table[1][start + np.arange(times.sum())]
        key = np.repeat(doc, times) * len(self.ids) + item
        if among is not None:
            key = key[np.isin(key, among)]
        return np.unique(key, return_counts=True)

    def contained(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text index, item index and number of the item's grams in the text, for each pair at the threshold."""
        w = words(texts)
        doc, h = [], []
        for size in self.sizes:
            g = grams(w, size, whole_short=False)
            known = self.full[0][np.minimum(np.searchsorted(self.full[0], g.hash), len(self.full[0]) - 1)] == g.hash
            doc.append(g.doc[known])
            h.append(g.hash[known])
        doc, h = np.concatenate(doc), np.concatenate(h)
        if not len(h):
            return doc, doc, doc
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])
        doc, h = doc[fresh], h[fresh]
        key, hits = self._count(self.signature, doc, h, None)
        key = key[hits >= self.least[key % len(self.ids)]]
        key, hits = self._count(self.full, doc, h, key)
        good = hits >= self.need[key % len(self.ids)]
        return key[good] // len(self.ids), key[good] % len(self.ids), hits[good]


def _columns(grams_: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = grams_.select("item_id", "h", "n").toArrow()
    return tuple(np.asarray(table[c]) for c in ("item_id", "h", "n"))




def find(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, n: int = WORDS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``doc_id, item_id, n_grams, n_found, containment`` of each document that contains an item."""
    known = item_grams(items, n)
    chosen = small_batches(docs.filter("doc_id is not null").select("doc_id", "text"))
    if known.count() * 20 > item_bytes:
        return _find_shuffled(chosen, known, containment, n)
    sent = docs.sparkSession.sparkContext.broadcast(_columns(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Items(*sent.value, containment)
        for batch in batches:
            for part, texts in text_slices(batch) if len(table.ids) else ():
                ids = part.column("doc_id").to_numpy(False)
                doc, item, found = table.contained(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[doc]), pa.array(table.ids[item]), pa.array(table.q[item]), pa.array(found)],
                    ["doc_id", "item_id", "n_grams", "n_found"],
                )

    pairs = chosen.mapInArrow(run, "doc_id long, item_id long, n_grams long, n_found long")
    best = pairs.groupBy("doc_id", "item_id").agg(F.max("n_grams").alias("n_grams"), F.max("n_found").alias("n_found"))
    return best.withColumn("containment", F.col("n_found") / F.col("n_grams"))


def _find_shuffled(docs: DataFrame, known: DataFrame, containment: float, n: int) -> DataFrame:
    """The same with item grams that are too many to broadcast: two shuffled joins on gram hashes."""
    sizes = [r.n for r in known.select("n").distinct().collect()]  # n values at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                ids, texts_, w = part.column("doc_id").to_numpy(False), part.column("x").to_numpy(False), words(texts)
                for size in sizes:
                    g = grams(w, size, whole_short=False)
                    columns = [pa.array(ids[g.doc]), pa.array(texts_[g.doc]), pa.array(g.hash.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "x", "h"])

    # An item's k smallest hashes: the number per item is bounded by its own length.
    item = known.groupBy("item_id").agg(F.count("*").alias("q"))
    largest = F.pow(F.lit(2), F.ceil(F.log2(F.col("q") + 1))) - 1
    lack = lambda m: m - F.ceil(F.lit(containment) * m - 1e-9)
    item = item.withColumn("k", F.least("q", lack(largest).cast("long") + SPARE)).withColumn("lack", lack(F.col("q")))
    by = known.groupBy("item_id").agg(F.sort_array(F.collect_list("h")).alias("hs"))
    signature = by.join(item, "item_id").select("item_id", "k", "lack", F.explode(F.slice("hs", F.lit(1), F.col("k").cast("int"))).alias("h"))
    row = ["doc_id", "x"]  # x tells the texts of a repeated doc_id apart
    doc_grams = docs.withColumn("x", F.xxhash64("text")).mapInArrow(run, "doc_id long, x long, h long")
    hits = doc_grams.join(signature, "h").groupBy(*row, "item_id").agg(F.count_distinct("h").alias("s"), F.first("k").alias("k"), F.first("lack").alias("lack"))
    candidates = stage(hits.filter("s >= greatest(k - lack, 1)").select(*row, "item_id"), "candidate-items")
    found = doc_grams.join(candidates.select(*row).distinct(), row).join(known, "h")
    per_row = found.join(candidates, [*row, "item_id"]).groupBy(*row, "item_id").agg(F.count_distinct("h").alias("n_found"))
    counted = per_row.groupBy("doc_id", "item_id").agg(F.max("n_found").alias("n_found"))
    return (
        counted.join(item.select("item_id", F.col("q").alias("n_grams")), "item_id")
        .filter(F.col("n_found") >= F.ceil(F.lit(containment) * F.col("n_grams") - 1e-9))
        .select("doc_id", "item_id", "n_grams", "n_found", (F.col("n_found") / F.col("n_grams")).alias("containment"))
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, n: int = WORDS) -> DataFrame:
    """``docs`` without documents that contain an item.  Rows without a doc_id stay."""
    gone = stage(find(docs, items, containment, n).select(F.col("doc_id").alias("__d")).distinct(), "contaminated")
    return docs.join(sized(gone, 16), docs["doc_id"] == gone["__d"], "left_anti")
