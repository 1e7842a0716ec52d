"""Near duplicates by SetSketch registers: banded, estimated jointly by likelihood, then verified on full sets.

A register of a set is ``floor(1 - log_b x)`` of the smallest of its elements' exponential values ``x``, truncated to two bytes: minima on an
exponentially spaced scale.  Registers of a union are the larger ones of its parts, and with ``b`` near 1 two sets agree in a
register about as often as they have elements in common (Ertl 2021).

1. Documents with the same set are one node.  Each set's registers are cut in bands; a band's registers are hashed.
2. Every set of a bucket is compared with the bucket's smallest one, and those that this leaves apart with each other.  The likelihood of the
   pair's larger, smaller and equal registers, given both sizes, decides: a pair goes if even the threshold explains
   them worse than the best estimate by ``MARGIN``.
3. Components of likely pairs are groups, in which links are verified on full sets in the same way.
4. A bucket or group beyond a block is cut into blocks, each with the smallest set in it; sets that are not joined to it there meet the sets of
   all other blocks.  So a group of near copies costs little more than its size, and no pair is skipped.

The result is the components of verified links.  No list of pairs is ever written: blocks return edges that span what is linked.

Cases: null counts as empty; a text with fewer words than ``n`` has one shingle of all its words; a text without words is linked with nothing,
its copies included; rows that repeat a doc_id are documents of their own, of which the id is kept if it is the smallest of its
component; rows without a doc_id are left out; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyceum.llm.tables import components, release, sized, small_batches
from lyceum.llm.words import grams, text_slices, words
from lyceum.sources.staging import stage

WORDS = 5
#: Links have 100 * common >= SHARE * united.
SHARE = 85
#: Chance that a pair at the threshold shares no band.
MISS = 1e-6
REGISTERS = 256
#: Base and rate of the registers, and the largest value.
BASE, RATE, LARGEST = 1.001, 20.0, 65_535
#: Log-likelihood by which the threshold may be worse than the best estimate: a true link falls below with a chance of about 1e-8.
MARGIN = 16.0
#: Sets of a block and the bytes of their shingle hashes: a task holds two blocks at a time.
BLOCK, BLOCK_BYTES = 1_000, 8 << 20
#: Bytes of small buckets that are worked on together.
UNIT_BYTES = 1 << 20
#: Pairs whose registers are compared at a time.
PAIRS = 8_192


def choose_bands(share: int = SHARE, miss: float = MISS, registers: int = REGISTERS) -> tuple[int, int]:
    """``(bands, rows)``: the longest bands that a pair at the threshold misses with a chance of ``miss`` at most."""
    best = (registers, 1)
    for rows in range(1, 33):
        hit = (share / 100) ** rows
        bands = math.ceil(math.log(miss) / math.log1p(-hit)) if hit < 1 else 1
        if bands * rows <= registers:
            best = (bands, rows)
    return best


def registers(doc: np.ndarray, hashes: np.ndarray, n: int, count: int) -> np.ndarray:
    """``n`` x ``count`` registers of the sets ``hashes`` (by ``doc``, in order); 0 for an empty set."""
    multiply = np.random.default_rng(20241102).integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shift = np.random.default_rng(20241103).integers(0, 1 << 32, count, dtype=np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    cut = np.searchsorted(doc, np.arange(n + 1))
    least = np.full((n, count), 0xFFFFFFFF, np.uint32)
    for k in range(n):
        own, low = x[cut[k] : cut[k + 1]], least[k]
        for lo in range(0, len(own), 512):  # a block of hashes stays in the processor's cache
            h = own[lo : lo + 512, None] ^ shift
            h *= multiply
            h ^= h >> np.uint32(15)
            np.minimum(low, h.min(0), out=low)
    # The least of uniform numbers gives the least of exponential ones.
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    out = np.clip(np.floor(1 - np.log(x) / math.log(BASE)), 0, LARGEST).astype(np.uint16)
    out[cut[1:] == cut[:-1]] = 0
    return out


def merge(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(left, right)


def _bands(regs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    weight = np.random.default_rng(20241104).integers(1, 1 << 63, (2, rows), dtype=np.uint64) | np.uint64(1)
    x = regs[:, : bands * rows].reshape(len(regs), bands, rows).astype(np.uint64) + np.uint64(1)
    h = ((x * weight[0]) ^ ((x * weight[1]) >> np.uint64(31))) * weight[1]
    h = h.sum(2, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return (h * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def likelihood(j: np.ndarray, u: np.ndarray, v: np.ndarray, more: np.ndarray, less: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Log-likelihood of a Jaccard similarity; ``u`` and ``v`` are the shares of both sizes."""
    step = (BASE - 1) / BASE

    def beyond(x: np.ndarray) -> np.ndarray:  # chance that one register is larger
        return -np.log1p(-np.clip(x, 0, 1) * step) / math.log(BASE)

    up, down = beyond(u - v * j), beyond(v - u * j)
    tiny = 1e-12
    return more * np.log(np.maximum(up, tiny)) + less * np.log(np.maximum(down, tiny)) + same * np.log(np.maximum(1 - up - down, tiny))


def estimate(size_a: np.ndarray, size_b: np.ndarray, more: np.ndarray, less: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Jaccard similarity of greatest likelihood, by golden sections: the likelihood has one top."""
    total = size_a + size_b
    u, v = size_a / total, size_b / total
    low, high = np.zeros(len(u)), np.minimum(u, v) / np.maximum(u, v)
    golden = (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - golden * (high - low), low + golden * (high - low)
        left = likelihood(a, u, v, more, less, same) > likelihood(b, u, v, more, less, same)
        low, high = np.where(left, low, a), np.where(left, b, high)
    return (low + high) / 2


def likely(size_a: np.ndarray, size_b: np.ndarray, regs_a: np.ndarray, regs_b: np.ndarray, share: int = SHARE, margin: float = MARGIN) -> np.ndarray:
    """Pairs that may be linked, by their sizes and registers."""
    out = 100 * np.minimum(size_a, size_b) >= share * np.maximum(size_a, size_b)
    at = np.flatnonzero(out)
    if not len(at):
        return out
    a, b = regs_a[at], regs_b[at]
    more, less = (a > b).sum(1), (a < b).sum(1)
    na, nb, same = size_a[at].astype(np.float64), size_b[at].astype(np.float64), a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    at_bar = likelihood(np.full(len(u), share / 100), u, v, more, less, same)
    # The likelihood has one top: where it still rises at the threshold, the best estimate lies above.
    good = likelihood(np.full(len(u), share / 100 + 1e-4), u, v, more, less, same) >= at_bar
    rest = np.flatnonzero(~good)
    if len(rest):
        u, v, more, less, same = (x[rest] for x in (u, v, more, less, same))
        best = estimate(na[rest], nb[rest], more, less, same)
        good[rest] = at_bar[rest] >= likelihood(best, u, v, more, less, same) - margin
    out[at] = good
    return out


def _sets(part: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    g = grams(words(part, ascii_only=True), n)
    cut = np.searchsorted(g.doc, np.arange(len(part) + 1))
    return [np.unique(g.hash[cut[k] : cut[k + 1]]) for k in range(len(part))]


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketch(docs: DataFrame, n: int, bands: int, rows: int, count: int = REGISTERS) -> DataFrame:
    """``doc_id, n_shingles, sid`` (a digest of the set), and for a set with elements ``regs`` and band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows_, part in text_slices(batch):
                sets = _sets(part, n)
                size = np.fromiter(map(len, sets), np.int64, len(sets))
                regs = registers(np.repeat(np.arange(len(sets)), size), np.concatenate(sets), len(sets), count)
                hashed = _bands(regs, bands, rows)
                offsets = np.concatenate([[0], np.cumsum((size > 0) * bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows_.column("doc_id"),
                        pa.array(size),
                        pa.array([_digest(s) for s in sets], pa.binary()),
                        pa.array([r.tobytes() if k else None for r, k in zip(regs, size)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashed[size > 0].ravel())),
                    ],
                    ["doc_id", "n_shingles", "sid", "regs", "bands"],
                )

    kind = "doc_id long, n_shingles long, sid binary, regs binary, bands array<long>"
    return small_batches(docs.filter("doc_id is not null").select("doc_id", "text")).mapInArrow(run, kind)


def _matrix(column: pa.ChunkedArray | pa.Array, count: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), count)


def _spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest one that the pairs ``i, j`` join it to."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _likely_in_unit(pdf: pd.DataFrame, first: np.ndarray, share: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Likely pairs of rows of one bucket (``first`` is the bucket's first row): each row with the first, then those that this leaves
    apart, a diagonal at a time."""
    size, side = pdf["n_shingles"].to_numpy(), pdf["side"].to_numpy()
    regs = np.frombuffer(b"".join(pdf["regs"]), np.uint16).reshape(len(pdf), count)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def judge() -> None:
        i, j = (np.concatenate(x) for x in zip(*waiting))
        waiting.clear()
        for lo in range(0, len(i), PAIRS):
            p, q = i[lo : lo + PAIRS], j[lo : lo + PAIRS]
            good = likely(size[p], size[q], regs[p], regs[q], share)
            found.append((p[good], q[good]))

    label, row = np.arange(len(pdf)), np.arange(len(pdf))
    apart = side[row] != 2  # of two blocks only pairs across count
    if not apart.all():
        at = row[(row != first) & ~apart]
        waiting.append((first[at], at))
        judge()
        joined = np.concatenate([q for _, q in found])
        label[joined] = first[joined]
    open_ = np.bincount(first, label != first, len(pdf))[first] > 1  # buckets with two rows or more apart from the first
    row = row[open_ | apart]
    for d in range(1, len(row)):
        i, j = row[:-d], row[d:]
        same = first[i] == first[j]
        if not same.any():
            break
        fit = same & (label[i] != label[j]) & np.where(side[i] == 2, i != first[i], side[i] != side[j])
        fit &= 100 * np.minimum(size[i], size[j]) >= share * np.maximum(size[i], size[j])
        if fit.any():
            waiting.append((i[fit], j[fit]))
            if sum(len(x) for x, _ in waiting) >= PAIRS:
                judge()
    if waiting:
        judge()
    i, j = (np.concatenate(x) for x in zip(*found))
    return i, j


def _linked_in_unit(pdf: pd.DataFrame, first: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links between rows of one bucket: each set in turn meets all later ones that are not yet joined to it."""
    sets = [np.frombuffer(s, np.uint64) for s in pdf["shingles"]]
    size, side, comp = np.fromiter(map(len, sets), np.int64, len(sets)), pdf["side"].to_numpy(), np.arange(len(sets))
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(size)])
    end = np.searchsorted(first, first, "right")  # of each row's bucket
    here = np.zeros(len(values), bool)
    found_i, found_j = [], []
    for i in range(len(sets) - 1):
        later = np.arange(i + 1, end[i])
        later = later[comp[later] != comp[i]]
        if side[i] != 2:
            later = later[side[later] != side[i]]
        later = later[100 * np.minimum(size[later], size[i]) >= share * np.maximum(size[later], size[i])]
        if not len(later):
            continue
        own = code[start[i] : start[i + 1]]
        here[own] = True
        n = size[later]
        begin = np.concatenate([[0], np.cumsum(n)[:-1]])
        places = np.repeat(start[later] - begin, n) + np.arange(n.sum())
        common = np.add.reduceat(here[code[places]].astype(np.int64), begin)
        here[own] = False
        for j in later[100 * common >= share * (n + size[i] - common)]:
            if comp[j] != comp[i]:
                bucket = comp[first[i] : end[i]]
                bucket[bucket == comp[j]] = comp[i]
                found_i.append(i)
                found_j.append(j)
    return np.array(found_i, np.int64), np.array(found_j, np.int64)


def _parts(sets: str, size: str):
    return F.greatest(F.ceil(F.col(sets) / BLOCK), F.ceil(F.col(size) / BLOCK_BYTES), F.lit(1)).cast("int")


def _in_units(rows: DataFrame, keys: list[str], test: Callable, share: int) -> DataFrame:
    """``bucket, a, b``: edges that span what ``test`` links in each unit; and rows with a null ``b`` for sets of a bucket in several blocks that
    are not joined to the bucket's centre."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bucket", "sid", "side"], ignore_index=True)
        bucket, sid = pdf["bucket"].to_numpy(), pdf["sid"].to_numpy()
        first = np.searchsorted(bucket, bucket)
        root = _spanning(len(pdf), *test(pdf, first, share))
        at = np.flatnonzero(root != np.arange(len(pdf)))
        left = np.flatnonzero((pdf["nb"].to_numpy() > 1) & (pdf["side"].to_numpy() == 2) & (root != root[first]))
        both = np.concatenate([at, left])
        return pd.DataFrame({"bucket": bucket[both], "a": sid[both], "b": [*sid[root[at]], *[None] * len(left)]})

    # Dealt anew: a join's partitioning by bucket would keep all blocks of a large one in one task.
    return rows.repartition(*keys).groupBy(*keys).applyInPandas(run, "bucket long, a binary, b binary")


def _connect(members: DataFrame, total_bytes: int, payload: DataFrame, test: Callable, share: int, label: str) -> DataFrame:
    """Edges ``a, b`` that span what ``test`` links inside the buckets of ``members`` (``bucket, sid, weight``).

    A bucket of up to a block is worked on whole, many of them in one unit.  A larger one is cut into blocks, and its smallest set
    stands in each.  Sets that are joined to it in their block are joined to each other; only the others, few in a group of
    near copies, have yet to meet the sets of all other blocks.
    """
    shape = members.groupBy("bucket").agg(F.count("*").alias("m"), F.sum("weight").alias("w"), F.min("sid").alias("centre")).filter("m > 1")
    placed = members.join(shape.select("bucket", "centre", _parts("m", "w").alias("nb")), "bucket")
    own = F.pmod(F.xxhash64("sid"), F.col("nb")).cast("int")
    blocks = F.when(F.col("sid") == F.col("centre"), F.sequence(F.lit(0), F.col("nb") - 1)).otherwise(F.array(own))
    units = max(1, -(-total_bytes // UNIT_BYTES))
    unit = F.when(F.col("nb") == 1, F.pmod(F.xxhash64("bucket"), F.lit(units))).otherwise(F.col("bucket"))
    rows = placed.select("bucket", "sid", "nb", F.explode(blocks).alias("x"), unit.alias("u"), F.lit(2).alias("side"))
    found = stage(_in_units(rows.join(payload, "sid"), ["u", "x"], test, share), label)
    edges = found.filter("b is not null").select("a", "b")
    left = found.filter("b is null").select("bucket", F.col("a").alias("sid"))  # each set once: it is in one block
    if left.isEmpty():
        return edges
    weighed = left.join(members, ["bucket", "sid"])
    shape2 = weighed.groupBy("bucket").agg(F.count("*").alias("m"), F.sum("weight").alias("w")).select("bucket", _parts("m", "w").alias("lb"))
    whole = placed.join(shape2, "bucket").select("bucket", "sid", "nb", "lb", own.alias("k"))
    others = whole.select("bucket", "sid", "nb", F.explode(F.sequence(F.lit(0), F.col("lb") - 1)).alias("x"), "k", F.lit(1).alias("side"))
    spread = whole.join(left, ["bucket", "sid"]).withColumn("x", F.pmod(F.xxhash64("sid", F.lit(1)), F.col("lb")).cast("int"))
    these = spread.select("bucket", "sid", "nb", "x", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("k"), F.lit(0).alias("side"))
    pairs = these.union(others).join(payload, "sid")
    more = stage(_in_units(pairs, ["bucket", "x", "k"], test, share), f"{label}-across")
    return edges.union(more.filter("b is not null").select("a", "b"))


def _candidates(sets: DataFrame, share: int, count: int, bands: int) -> DataFrame:
    """``sid, grp``: components of likely pairs; a set that is likely linked with nothing is not in it."""
    members = sets.select("sid", F.explode("bands").alias("bucket"), F.lit(2 * count).alias("weight"))
    payload = sets.select("sid", "n_shingles", "regs")
    # An eighth of all bands share a bucket, by rule of thumb; the number of units decides nothing else.
    edges = _connect(members, sets.count() * bands * 2 * count // 8, payload, lambda p, f, s: _likely_in_unit(p, f, s, count), share, "likely")
    return stage(components(edges, "likely-groups").select(F.col("node").alias("sid"), F.xxhash64("root").alias("grp")), "likely-groups")


def _candidate_sets(docs: DataFrame, sets: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """``sid, grp, weight, shingles``: the full sets of all candidates."""
    chosen = stage(groups.join(sets.select("sid", "rep"), "sid"), "candidates")
    texts = docs.filter("doc_id is not null").select("doc_id", "text")
    read = texts.join(sized(chosen.select("rep").distinct(), 16), texts["doc_id"] == F.col("rep"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in text_slices(batch):
                made = _sets(part, n)
                columns = [pa.array([_digest(s) for s in made], pa.binary()), pa.array([s.tobytes() for s in made], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["sid", "shingles"])

    made = small_batches(read).mapInArrow(run, "sid binary, shingles binary")
    one = made.join(sized(chosen.select("sid", "grp"), 64), "sid").groupBy("sid").agg(F.first("grp").alias("grp"), F.first("shingles").alias("shingles"))
    return stage(one.select("sid", F.col("grp").alias("bucket"), F.octet_length("shingles").alias("weight"), "shingles"), "candidate-sets")


def near_duplicates(docs: DataFrame, n: int = WORDS, share: int = SHARE, miss: float = MISS, count: int = REGISTERS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each document: components of links, and their smallest doc_id."""
    bands, rows = choose_bands(share, miss, count)
    signed = stage(sketch(docs, n, bands, rows, count), "sketches")
    sets = stage(
        signed.filter("n_shingles > 0").groupBy("sid").agg(
            F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"), F.first("bands").alias("bands")
        ),
        "distinct-sets",
    )
    full = _candidate_sets(docs, sets, _candidates(sets, share, count, bands), n)
    release(docs.sparkSession)
    size = full.agg(F.sum("weight")).first()[0] or 0
    links = _connect(full.drop("shingles"), size, full.select("sid", "shingles"), _linked_in_unit, share, "verified")
    roots = components(links, "near-components").select(F.col("node").alias("sid"), F.col("root").alias("comp"))
    release(docs.sparkSession)
    placed = sets.select("sid", "rep").join(roots, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    least = placed.groupBy("comp").agg(F.min("rep").alias("least"))
    named = placed.join(least, "comp").select("sid", "least")
    own = F.coalesce("least", "doc_id")
    return signed.select("doc_id", "n_shingles", "sid").join(named, "sid", "left").select(
        "doc_id", "n_shingles", own.alias("component_id"), (F.col("doc_id") == own).alias("kept")
    )
