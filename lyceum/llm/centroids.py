"""Centroid clustering of vectors in whole numbers, on bit planes.

A component ``x`` becomes ``floor(1024 x)`` less the least such number of the table, so all numbers are zero or more.  Bit ``p`` of the
64 components of a vector is one 64-bit word, its plane ``p``.  A dot product is the sum over pairs of planes of
``2^(p+q) popcount(plane_p AND plane_q)``; squared distances follow from it exactly, and sums of vectors are counts of the
bits of each plane.  The planes are written once; a round reads them, and each task returns one sum per cluster and
component.  Only the centroids (``k`` rows) are on the driver.

Cases: rows without a vec_id, with another number of components, or with a null or non-finite one are left out, and
so are numbers of 2^52 or more in size, which doubles do not hold to the unit; rows that repeat a vec_id are vectors of their own (as first
centroids in the order of their components); fewer vectors than ``k`` give as many centroids; equal distances go to the
smaller number; a distance or inertia beyond a long is its largest value; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lyceum.sources.staging import stage

COMPONENTS = 64
SCALE = 1024
CENTROIDS = 8
ROUNDS = 10
SEED = "3:"
#: Vectors that are worked on at a time: their planes stay in the processor's cache.
CHUNK = 4096
#: With at most so many planes a squared distance fits 64 bits.
NARROW = 28
LONGEST = (1 << 63) - 1
_EXACT = float(1 << 52)


def whole_numbers(embeddings: DataFrame, scale: int = SCALE, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, v``: the vectors that take part, in whole numbers."""
    scaled = F.transform("embedding", lambda x: x.cast("double") * F.lit(float(scale)))
    fine = F.forall("s", lambda x: x.isNotNull() & (F.abs(x) < F.lit(_EXACT)))  # NaN is the largest double
    rows = embeddings.filter("vec_id is not null").filter(F.size("embedding") == components).select("vec_id", scaled.alias("s"))
    return rows.filter(fine).select("vec_id", F.transform("s", lambda x: F.floor(x)).alias("v"))


def pack(numbers: np.ndarray, planes: int) -> np.ndarray:
    """``planes`` x ``n`` words of ``n`` x 64 numbers of zero or more."""
    out = np.empty((planes, len(numbers)), np.uint64)
    for p in range(planes):
        bits = ((numbers >> p) & 1).astype(np.uint8)
        out[p] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _weighted(left: np.ndarray, right) -> np.ndarray:
    """Sum of ``2^(p+q) popcount(left_p AND right_q)``: exact, as 64-bit numbers or, for many planes, as Python's."""
    planes, n = left.shape
    kind = np.int64 if planes <= NARROW else object
    total = np.zeros(n, kind)
    both, count = np.empty(n, np.uint64), np.empty(n, np.uint8)
    for s in range(2 * planes - 1):
        counts = np.zeros(n, np.uint16)
        for p in range(max(0, s - planes + 1), min(planes, s + 1)):
            np.bitwise_and(left[p], right[s - p], out=both)
            np.bitwise_count(both, out=count)
            counts += count
        total += counts.astype(kind) * (1 << s)
    return total


def nearest(planes: np.ndarray, norms: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each vector, and its squared distance."""
    width = len(planes)
    packed = pack(np.array(centroids, np.int64), width)
    best = np.zeros(planes.shape[1], np.int32)
    least = None
    for c, centroid in enumerate(centroids):
        own = sum(x * x for x in centroid)
        far = norms + own - 2 * _weighted(planes, packed[:, c])
        if least is None:
            least = far
        else:
            closer = (far < least).astype(bool)
            best[closer] = c
            least = np.where(closer, far, least)
    return best, least


class Sums:
    """Counts of set bits by plane, cluster and component: sums of vectors without rounding or overflow."""

    def __init__(self, planes: int, clusters: int):
        self.bits = np.zeros((planes, clusters, COMPONENTS), np.int64)
        self.rows = np.zeros(clusters, np.int64)

    def add(self, planes: np.ndarray, cluster: np.ndarray) -> None:
        k = len(self.rows)
        self.rows += np.bincount(cluster, minlength=k)
        chosen = (np.arange(k)[:, None] == cluster).astype(np.float32)
        for p, words in enumerate(planes):
            bits = np.unpackbits(words.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            self.bits[p] += (chosen @ bits.astype(np.float32)).astype(np.int64)  # below 2^24, exact

    def totals(self) -> list[list[int]]:
        return [[sum(int(b) << p for p, b in enumerate(self.bits[:, c, j])) for j in range(COMPONENTS)] for c in range(len(self.rows))]


def _chunks(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for lo in range(0, batch.num_rows, CHUNK):
        part = batch.slice(lo, CHUNK)
        raw = np.frombuffer(b"".join(part.column("planes").to_pylist()), "<u8").reshape(part.num_rows, width)
        planes = np.ascontiguousarray(raw.T)
        yield part, planes, _weighted(planes, planes)


def packed(vectors: DataFrame, low: int, width: int) -> DataFrame:
    """``vec_id, planes``: the bit planes of each vector, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, COMPONENTS) - low
            words = np.ascontiguousarray(pack(numbers, width).T).astype("<u8")
            rows = pa.array([w.tobytes() for w in words], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), rows], ["vec_id", "planes"])

    return vectors.mapInArrow(run, "vec_id long, planes binary")


def _round(planes: DataFrame, width: int, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids after every vector has gone to its nearest one."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(width, k)
        for batch in batches:
            for _, words, norms in _chunks(batch, width):
                sums.add(words, nearest(words, norms, centroids)[0])
        values = [[int(n), *own] for n, own in zip(sums.rows, sums.totals())]
        cluster, place = np.divmod(np.arange(k * (COMPONENTS + 1), dtype=np.int32), COMPONENTS + 1)
        total = pa.array([Decimal(x) for own in values for x in own], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(place), total], ["cluster", "place", "total"])

    sums = planes.select("planes").mapInArrow(run, "cluster int, place int, total decimal(38,0)")
    new = [[0] * (COMPONENTS + 1) for _ in range(k)]
    for row in sums.groupBy("cluster", "place").agg(F.sum("total").alias("total")).collect():  # k x 65 rows
        new[row.cluster][row.place] = int(row.total)
    return [[x // own[0] for x in own[1:]] if own[0] else old for own, old in zip(new, centroids)]


def cluster(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each vector that takes part."""
    spark = embeddings.sparkSession
    vectors = whole_numbers(embeddings)
    low, high = vectors.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    if low is None:
        kinds = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], kinds)
    width = max(1, (high - low).bit_length())
    order = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = vectors.orderBy(order, "v").limit(k).collect()  # k rows
    centroids = [[x - low for x in row.v] for row in first]
    planes = stage(packed(vectors, low, width), "bit-planes")
    for _ in range(rounds):
        before, centroids = centroids, _round(planes, width, centroids)
        if before == centroids:  # every later round gives the same
            break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words, norms in _chunks(batch, width):
                own, far = nearest(words, norms, centroids)
                far = pa.array([min(int(d), LONGEST) for d in far] if far.dtype == object else far, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(own), far], ["vec_id", "cluster", "distance"])

    assigned = stage(planes.mapInArrow(run, "vec_id long, cluster int, distance long"), "assigned")
    sums = dict(assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())  # k rows
    total = min(int(sum(sums.values())), LONGEST)
    digests = [hashlib.sha256(",".join(str(x + low) for x in c).encode()).hexdigest() for c in centroids]
    rows = [(c, min(int(s), LONGEST), total, digests[c]) for c, s in sums.items()]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
