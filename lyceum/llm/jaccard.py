"""N-gram Jaccard join and near-duplicate classes by MinHash banding.

1. Texts that are equal form one class with the smallest doc_id as its representative; only representatives are compared.
2. Each text gets a MinHash signature; bands and rows are chosen for a target recall at the threshold.  Representatives
   are shuffled on band hashes; a bucket gives one edge from each member to its smallest member, never all its pairs.
3. Connected components of these edges are groups of candidates.  Each group's texts come together once.  A large group
   is dealt into blocks and every pair of blocks is a task of its own, so a group of any size has bounded tasks.
4. In a task all candidate pairs are verified on full n-gram sets.  Only a link count per text and edges that span its
   linked texts leave the task, not the pairs.

Cases: null counts as empty; texts of 1 to n - 1 words have one gram of all their words; texts without words are linked to
equal texts only; rows that repeat a doc_id each get a row (the same class if their texts are equal); rows without a
doc_id are left out; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyceum.llm.tables import components, release, sized, small_batches
from lyceum.llm.words import grams, slices, text_slices, words
from lyceum.sources.staging import stage

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.99999
MAX_HASHES = 256
#: Texts of a block, and their bytes: a task compares two blocks at most.
BLOCK = 1_000
BLOCK_BYTES = 8 << 20


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """``(bands, rows)``: the most rows, hence fewest false candidates, that keep ``recall`` at ``threshold``."""
    best = (max_hashes, 1)
    for rows in range(1, 33):
        hit = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log1p(-hit)) if hit < 1 else 1
        if bands * rows <= max_hashes:
            best = (bands, rows)
    return best


def signatures(w_doc: np.ndarray, hashes: np.ndarray, n: int, count: int) -> np.ndarray:
    """``n`` x ``count`` minima of the 32-bit hashes under odd multipliers."""
    multipliers = np.random.default_rng(20240903).integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = np.random.default_rng(20240904).integers(0, 1 << 32, count, dtype=np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    cut = np.searchsorted(w_doc, np.arange(n + 1))
    out = np.zeros((n, count), np.uint32)
    for k in range(n):
        own = x[cut[k] : cut[k + 1]]
        low = None
        for lo in range(0, len(own), 512):  # a block of hashes stays in the processor's cache
            h = own[lo : lo + 512, None] ^ shifts
            h *= multipliers
            h ^= h >> np.uint32(15)
            least = h.min(0)
            low = least if low is None else np.minimum(low, least)
        if low is not None:
            out[k] = low
    return out


def _band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    weights = np.random.default_rng(20240905).integers(1, 1 << 63, rows, dtype=np.uint64) | np.uint64(1)
    grouped = sig[:, : bands * rows].reshape(len(sig), bands, rows).astype(np.uint64) + np.uint64(1)
    mixed = (grouped * (grouped ^ weights) * weights).sum(2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    return (mixed * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def sign(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """``doc_id``, digest of the text, and its band hashes (none for a text without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows_, part in text_slices(batch):
                g = grams(words(part), n)
                has = np.zeros(len(part), bool)
                has[g.doc] = True
                made = _band_hashes(signatures(g.doc, g.hash, len(part), bands * rows), bands, rows)
                offsets = np.concatenate([[0], np.cumsum(has * bands)]).astype(np.int32)
                keys = [hashlib.blake2b((t or "").encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in part]
                yield pa.RecordBatch.from_arrays(
                    [
                        rows_.column("doc_id"),
                        pa.array(keys, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(made[has].ravel())),
                    ],
                    ["doc_id", "key", "bands"],
                )

    return small_batches(docs.filter("doc_id is not null").select("doc_id", "text")).mapInArrow(run, "doc_id long, key binary, bands array<long>")


def linked(sets: list[np.ndarray], side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``i < j`` of gram sets (sorted, without repeats) at ``threshold`` or more.  ``side``: 0 or 1 for two blocks, of
    which only pairs across count, or all 2 for one block."""
    m = len(sets)
    size = np.fromiter(map(len, sets), np.int64, m)
    owner = np.repeat(np.arange(m), size)
    gram, column = np.unique(np.concatenate(sets) if m else np.zeros(0, np.uint64), return_inverse=True)
    shared = np.bincount(column, minlength=len(gram)) > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((m, m), np.float32)
    width = 2048
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [lo, lo + width])
        rows = np.unique(owner[a:b])
        block = np.zeros((len(rows), width), np.float32)
        block[np.searchsorted(rows, owner[a:b]), column[a:b] - lo] = 1
        common[np.ix_(rows, rows)] += block @ block.T
    i, j = np.nonzero(np.triu(common, 1))
    both = common[i, j].astype(np.int64)
    good = both >= threshold * (size[i] + size[j] - both) - 1e-9
    good &= (side[i] == 2) | (side[i] != side[j])
    return i[good], j[good]


def _roots(m: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index linked to each of ``m``, directly or through others."""
    root = np.arange(m)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _verify(pdf: pd.DataFrame, n: int, threshold: float) -> pd.DataFrame:
    pdf = pdf.sort_values("key", ignore_index=True)
    texts = pdf["text"].tolist()
    sets: list[np.ndarray] = []
    for lo, hi in slices(texts):
        g = grams(words(texts[lo:hi]), n)
        cut = np.searchsorted(g.doc, np.arange(hi - lo + 1))
        sets.extend(np.unique(g.hash[cut[k] : cut[k + 1]]) for k in range(hi - lo))
    own, other = pdf["x"].iloc[0], pdf["y"].iloc[0]
    side = np.full(len(pdf), 2) if own == other else (pdf["block"] == other).to_numpy().astype(np.int64)
    i, j = linked(sets, side, threshold)
    links = np.bincount(i, minlength=len(pdf)) + np.bincount(j, minlength=len(pdf))
    ids = pdf["key"].to_numpy()
    hit = links > 0
    return pd.DataFrame({"a": ids[hit], "b": ids[_roots(len(pdf), i, j)][hit], "links": links[hit]})


def near_classes(
    docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES
) -> DataFrame:
    """One row per document: ``doc_id``, ``class_id`` (smallest doc_id reached over links), ``text_id`` (smallest doc_id
    with the same text), ``n_copies`` (documents with that text) and ``n_links`` (other texts at the threshold or more)."""
    spark = docs.sparkSession
    bands, rows = choose_bands(threshold, recall, max_hashes)
    signed = stage(sign(docs, n, bands, rows), "signatures")
    texts = stage(
        signed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.first("bands").alias("bands")),
        "distinct-texts",
    )
    exploded = texts.select("key", F.explode("bands").alias("band"))
    buckets = exploded.groupBy("band").agg(F.min("key").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    edges = exploded.join(buckets, "band").filter("key <> b").select(F.col("key").alias("a"), "b").distinct()
    roots = components(edges, "candidates").select(F.col("node").alias("key"), F.xxhash64("root").alias("grp"))
    groups = stage(roots.join(texts.select("key", "rep"), "key"), "candidate-groups")
    release(spark)

    chosen = docs.filter("doc_id is not null").select("doc_id", "text")
    with_text = chosen.join(sized(groups, 80), chosen["doc_id"] == groups["rep"]).select("text", "grp", F.col("key").alias("rep_key"))
    # A repeated doc_id may carry other texts; every text has the key that was signed.
    digest = _digest_filter(with_text)
    sizes = digest.groupBy("grp").agg(F.count("*").alias("m"), F.sum(F.octet_length("text")).alias("bytes"))
    split = sizes.select(
        "grp", F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES), F.lit(1)).cast("int").alias("nb")
    )
    dealt = digest.join(split, "grp").withColumn("block", F.pmod(F.xxhash64("key"), F.col("nb")).cast("int"))
    spread = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    units = spread.select("key", "text", "grp", "block", F.least("block", "o").alias("x"), F.greatest("block", "o").alias("y"))
    found = stage(
        # Dealt anew: the join's partitioning by group would keep all blocks of a large group in one task.
        units.repartition("grp", "x", "y").groupBy("grp", "x", "y").applyInPandas(lambda pdf: _verify(pdf, n, threshold), "a binary, b binary, links long"),
        "verified-links",
    )
    release(spark)
    root = components(found.select("a", "b"), "near-classes")
    counted = found.groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("n_links"))
    placed = texts.select("key", "rep", "n_copies").join(root.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = placed.groupBy("root").agg(F.min("rep").alias("class_id"))
    per_text = (
        placed.join(least, "root")
        .join(counted, "key", "left")
        .select("key", "rep", "n_copies", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    return signed.select("doc_id", "key").join(per_text, "key").select(
        "doc_id", "class_id", F.col("rep").alias("text_id"), "n_copies", "n_links"
    )


def _digest_filter(df: DataFrame) -> DataFrame:
    """``key, text, grp`` of each candidate text, once; staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                same = [
                    hashlib.blake2b((t or "").encode("utf-8", "surrogatepass"), digest_size=16).digest() == k
                    for t, k in zip(texts, part.column("rep_key").to_pylist())
                ]
                yield part.filter(pa.array(same, pa.bool_())).rename_columns(["text", "grp", "key"])

    kept = small_batches(df).mapInArrow(run, "text string, grp long, key binary")
    return stage(kept, "candidate-texts").dropDuplicates(["key"])


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class: the smallest doc_id.  Rows without a doc_id stay."""
    gone = stage(near_classes(docs).filter("doc_id <> class_id").select(F.col("doc_id").alias("__d")), "near-duplicates")
    return docs.join(sized(gone, 16), docs["doc_id"] == gone["__d"], "left_anti")
