"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A byte goes if it lies in a string of ``length`` bytes that also starts earlier (smaller doc_id, or earlier in the document).
Sorting every suffix of the corpus would move many times its size.  Only suffixes that can have an equal one are sorted:

1. *Buckets.*  Each suffix (a start with ``length`` bytes to follow) is put in the bucket of the least ``KEY``-byte substring of these bytes, by
   hash and then from the left.  Equal strings have equal buckets, wherever they stand, and a run of starts shares one
   anchor.  Anchors are a few in a hundred bytes; those whose bucket holds no other anchor are unique and are dropped without loss.
2. *Equal contexts.*  Anchors whose bytes are the same for all their starts are one context: the first of them stands for
   all, every other is repeated entirely.  This is an aggregation, so a group of copies of any size is combined early.
3. *Blocks.*  Distinct contexts of one bucket are sorted together, some buckets in a block.  A block first ranks its cover sample:
   the substrings at positions of a difference cover modulo ``PERIOD``.  Starts are then sorted by their first and last
   ``PERIOD`` bytes only; longer ties are resolved by the ranks of the two sample positions that lie at the same distance
   from both, which a difference cover has for every pair.  Memory is bounded by the block, not by the corpus.
4. *Large buckets.*  A bucket of more than ``BUCKET`` contexts goes by string: its starts are aggregated by the digest of
   their ``length`` bytes, again combined before the shuffle.

Cases: null counts as empty; texts shorter than ``length`` keep every byte; rows without a doc_id are returned whole and take no
part; rows that repeat a doc_id and its text are one document, whose equal places are the same place; rows that repeat a
doc_id with another text are documents of their own, ordered by the hash of their texts; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyceum.llm.tables import release, sized, small_batches
from lyceum.llm.words import mix, powers, prefix_sums, text_slices
from lyceum.sources.staging import stage

LENGTH = 100
KEY = 40
#: A perfect difference set; every difference modulo 31 is one of its pairs'.
PERIOD, COVER = 31, [1, 5, 11, 24, 25, 27]
BLOCK_BYTES = 2 << 20
BUCKET = 10_000
_BITS = 7


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and ``v``, which tells the texts of one doc_id apart."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("v"))


def anchors(texts: list[bytes], length: int = LENGTH, key: int = KEY) -> dict[str, np.ndarray]:
    """Anchors of all texts: ``doc`` index, place ``p``, first and last start ``s`` and ``e`` it stands for, bucket ``h`` and
    context ``x``."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(size) - size
    starts = np.maximum(size - length + 1, 0)
    empty = {n: np.zeros(0, np.int64) for n in ("doc", "p", "s", "e", "h", "x")}
    if not starts.sum():
        return empty
    sums = prefix_sums(data)
    _, down = powers(len(sums))
    grams = len(data) - key + 1
    hashed = mix((sums[key:] - sums[:grams]) * down[:grams])
    window = length - key + 1
    # The place in the low half makes the leftmost of equal substrings the least.
    order = (hashed >> np.uint64(32) << np.uint64(32)) | np.arange(grams, dtype=np.uint64)
    blocks = -(-grams // window)
    padded = np.full(blocks * window, np.iinfo(np.uint64).max)
    padded[:grams] = order
    square = padded.reshape(blocks, window)
    ahead = np.minimum.accumulate(square, 1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], 1)[:, ::-1].ravel()
    n = grams - window + 1
    least = np.minimum(behind[:n], ahead[window - 1 : window - 1 + n]) & np.uint64(0xFFFFFFFF)
    doc = np.repeat(np.arange(len(texts)), starts)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(starts) - starts, starts) + begin[doc]
    anchor = least[place].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.append(first[1:], len(doc)) - 1
    p, s, e, owner = anchor[first], place[first], place[last], doc[first]
    context = mix((sums[e + length] - sums[s]) * down[s] + ((p - s) * 128 + (e - s)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    off = begin[owner]
    return {"doc": owner, "p": p - off, "s": s - off, "e": e - off, "h": hashed[p].view(np.int64), "x": context.view(np.int64)}


def _anchor_rows(docs: DataFrame, only_bucket: bool, length: int, key: int) -> DataFrame:
    """Bucket ``h`` of each anchor, and unless only that is asked for its context ``x``, document ``d, v`` (doc_id and text
    hash) and place ``l``: one number with ``p`` in front, the starts before it and their count less one in ``_BITS`` bits each."""
    names = ["h"] if only_bucket else ["h", "x", "d", "v", "l"]
    if length - key >= 1 << _BITS:
        raise ValueError("a window must hold fewer starts than 2 ** _BITS")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                found = anchors([_raw(t) for t in texts], length, key)
                if not only_bucket:
                    found["d"] = part.column("doc_id").to_numpy(False)[found["doc"]]
                    found["v"] = part.column("v").to_numpy(False)[found["doc"]]
                found["l"] = (found["p"] << 2 * _BITS) | (found["p"] - found["s"] << _BITS) | (found["e"] - found["s"])
                yield pa.RecordBatch.from_arrays([pa.array(found[n].astype(np.int64)) for n in names], names)

    return docs.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _first_start(place: str) -> Column:
    mask = F.lit((1 << _BITS) - 1)
    return (F.shiftright(place, 2 * _BITS) - F.shiftright(place, _BITS).bitwiseAND(mask)).cast("int")


def _last_start(place: str) -> Column:
    return (_first_start(place) + F.col(place).bitwiseAND(F.lit((1 << _BITS) - 1))).cast("int")


def _words(data: np.ndarray) -> np.ndarray:
    """Eight bytes from every position, as one number."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(data), 8), (1, 1)).copy().view(np.uint64).ravel()


def _ranks(group: np.ndarray, word: np.ndarray, at: np.ndarray, offsets: list[int]) -> np.ndarray:
    """Rank of each position by its group and the words at ``offsets``; -1 where nothing else is equal so far."""
    rank = np.full(len(at), -1, np.int64)
    live, now = np.arange(len(at)), group.astype(np.int64)
    for k in offsets:
        if not len(live):
            break
        w = word[at[live] + k]
        order = np.lexsort((w, now))
        n, v = now[order], w[order]
        fresh = np.concatenate([[True], (n[1:] != n[:-1]) | (v[1:] != v[:-1])])
        own = np.cumsum(fresh) - 1
        shared = np.bincount(own) > 1
        keep = shared[own]
        live, now = live[order][keep], own[keep]
    rank[live] = now
    return rank


def _offsets(length: int) -> list[int]:
    """Word offsets that cover ``length`` bytes (eight at least)."""
    return [*range(0, length - 8, 8), length - 8]


def cover_shifts(period: int = PERIOD, cover: list[int] = COVER) -> np.ndarray:
    """``[a, b]``: the least shift that brings positions of residues ``a`` and ``b`` both onto the cover."""
    inside = np.isin(np.arange(period), cover)
    out = np.full((period, period), -1)
    a, b = np.indices((period, period))
    for k in range(period):
        hit = inside[(a + k) % period] & inside[(b + k) % period] & (out < 0)
        out[hit] = k
    return out


def equal_starts(bucket: np.ndarray, contexts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts with an equal one in their bucket: context index, offset in it, and a class number of the equal strings."""
    size = np.fromiter(map(len, contexts), np.int64, len(contexts))
    begin = np.cumsum(size) - size
    data = np.frombuffer(b"".join(contexts), np.uint8)
    word = _words(data)
    many = size - length + 1
    context = np.repeat(np.arange(len(contexts)), many)
    offset = np.arange(len(context)) - np.repeat(np.cumsum(many) - many, many)
    at = begin[context] + offset
    _, number = np.unique(bucket, return_inverse=True)

    # Cover sample: ranks of the inner bytes at the cover's positions.
    inner = length - PERIOD
    inside = np.isin(np.arange(len(data)) % PERIOD, COVER)
    owner = np.repeat(np.arange(len(contexts)), size)
    inside &= np.arange(len(data)) + inner <= (begin + size)[owner]
    sample = np.flatnonzero(inside)
    rank_at = np.full(len(data) + PERIOD, -1, np.int64)
    ranks = _ranks(number[owner[sample]], word, sample, _offsets(inner))
    rank_at[sample] = np.where(ranks >= 0, ranks, -2 - np.arange(len(sample)))  # a rank of its own where it is unique

    # Starts by their first and last bytes, then ties by the cover.
    edge = _offsets(PERIOD)
    tied = _ranks(number[context], word, at, [*edge, *(k + inner for k in edge)])
    open_ = np.flatnonzero(tied >= 0)
    order = open_[np.argsort(tied[open_], kind="stable")]
    shifts = cover_shifts()
    klass = np.full(len(at), -1, np.int64)
    found = 0
    while len(order):
        group = tied[order]
        head = np.concatenate([[True], group[1:] != group[:-1]])
        leader = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        k = shifts[at[leader] % PERIOD, at[order] % PERIOD]
        same = rank_at[at[leader] + k] == rank_at[at[order] + k]
        number_of = np.cumsum(head) - 1
        klass[order[same]] = number_of[same] + found
        found += int(number_of[-1]) + 1
        order = order[~same]
    hit = klass >= 0
    hit[hit] = np.bincount(klass[hit], minlength=found)[klass[hit]] > 1
    return context[hit], offset[hit], klass[hit]


def _resolve(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """Repeated byte ranges ``d, v, a, b`` (b exclusive) found in one block of contexts."""
    d, v, s = (pdf[n].to_numpy(np.int64) for n in "dvs")
    context, offset, klass = equal_starts(pdf["h"].to_numpy(), pdf["context"].to_list(), length)
    start = s[context] + offset
    order = np.lexsort((start, v[context], d[context], klass))
    klass, doc, text, start = klass[order], d[context][order], v[context][order], start[order]
    if not len(klass):
        return pd.DataFrame({"d": [], "v": [], "a": [], "b": []})
    other = (klass[1:] != klass[:-1]) | (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])
    place = np.concatenate([[0], np.cumsum(other | (start[1:] != start[:-1]))])
    lead = np.concatenate([[True], klass[1:] != klass[:-1]])
    least = place[np.maximum.accumulate(np.where(lead, np.arange(len(klass)), 0))]
    later = place != least
    return _runs(doc[later], text[later], start[later], length)


def _runs(doc: np.ndarray, text: np.ndarray, start: np.ndarray, length: int) -> pd.DataFrame:
    order = np.lexsort((start, text, doc))
    doc, text, start = doc[order], text[order], start[order]
    if not len(doc):
        return pd.DataFrame({"d": [], "v": [], "a": [], "b": []})
    other = (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])
    fresh = np.flatnonzero(np.concatenate([[True], other | (start[1:] > start[:-1] + 1)]))
    last = np.append(fresh[1:], len(doc)) - 1
    return pd.DataFrame({"d": doc[fresh], "v": text[fresh], "a": start[fresh], "b": start[last] + length})


def _contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``h, n, d, v, s, context`` with the bytes of each wanted ``h, n, d, v, s, e``; staged."""
    lists = stage(wanted.groupBy("d", "v").agg(F.collect_list(F.struct("h", "n", "s", "e")).alias("l")), "wanted-contexts")
    joined = docs.withColumnRenamed("doc_id", "d").join(lists, ["d", "v"]).select("d", "v", "text", "l")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch):
                out: dict[str, list] = {k: [] for k in ("h", "n", "d", "v", "s", "context")}
                columns = (rows.column(n).to_pylist() for n in ("d", "v", "l"))
                for doc, hashed, wanted_, text in zip(*columns, texts):
                    raw = _raw(text)
                    for w in wanted_:
                        part = raw[w["s"] : w["e"] + length]
                        if len(part) == w["e"] + length - w["s"]:
                            for values, value in zip(out.values(), (w["h"], w["n"], doc, hashed, w["s"], part)):
                                values.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))

    return stage(joined.mapInArrow(run, "h long, n long, d long, v long, s int, context binary"), "contexts")


def _large(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated ranges in large buckets: starts aggregated by the digest of their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2_000):
                part = batch.slice(lo, 2_000)
                digests, d, v, a = [], [], [], []
                for doc, text, s, c in zip(*(part.column(n).to_pylist() for n in ("d", "v", "s", "context"))):
                    many = len(c) - length + 1
                    digests.extend(hashlib.blake2b(c[k : k + length], digest_size=16).digest() for k in range(many))
                    d.extend([doc] * many)
                    v.extend([text] * many)
                    a.extend(range(s, s + many))
                values = [pa.array(digests, pa.binary()), pa.array(d, pa.int64()), pa.array(v, pa.int64()), pa.array(a, pa.int32())]
                yield pa.RecordBatch.from_arrays(values, ["g", "d", "v", "a"])

    starts = contexts.mapInArrow(run, "g binary, d long, v long, a int")
    first = starts.groupBy("g").agg(F.min(F.struct("d", "v", "a")).alias("f"), F.count("*").alias("n")).filter("n > 1")
    later = starts.join(first, "g").filter(F.struct("d", "v", "a") != F.col("f"))
    return later.select("d", "v", "a", (F.col("a") + length).alias("b"))


def repeated(docs: DataFrame, length: int = LENGTH, key: int = KEY, bucket: int = BUCKET) -> DataFrame:
    """``d, v`` of a document, and its repeated byte ranges as arrays ``a`` and ``b`` (b exclusive): maximal runs in order; staged."""
    spark = docs.sparkSession
    docs = small_batches(_keyed(docs.filter("doc_id is not null")))
    twice = stage(_anchor_rows(docs, True, length, key).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "shared-buckets")
    release(spark)
    places = stage(_anchor_rows(docs, False, length, key).join(twice, "h"), "shared-anchors")
    release(spark)
    context = stage(places.groupBy("h", "x").agg(F.min(F.struct("d", "v", "l")).alias("f"), F.count("*").alias("m")), "distinct-contexts")
    again = places.join(context.filter("m > 1").select("h", "x", "f"), ["h", "x"]).filter(F.struct("d", "v", "l") != F.col("f"))
    copies = stage(again.select("d", "v", _first_start("l").alias("a"), (_last_start("l") + length).alias("b")), "copied-ranges")
    crowded = context.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    chosen = context.join(crowded, "h").select("h", "n", "f.d", "f.v", "f.l")
    wanted = stage(chosen.select("h", "n", "d", "v", _first_start("l").alias("s"), _last_start("l").alias("e")), "crowded-contexts")
    release(spark)
    texts = _contexts(docs, wanted, length)
    small = texts.filter(F.col("n") <= bucket)
    total = small.agg(F.coalesce(F.sum(F.octet_length("context")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // (BLOCK_BYTES // 2)))
    sorted_ = small.select("h", "d", "v", "s", "context", F.pmod(F.xxhash64("h"), F.lit(blocks)).alias("block")).groupBy("block")
    resolved = sorted_.applyInPandas(lambda pdf: _resolve(pdf, length), "d long, v long, a int, b int")
    ranges = copies.union(resolved).union(_large(texts.filter(F.col("n") > bucket), length))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = [], []
            for ranges_ in batch.column("l"):
                pair = ranges_.values.flatten()
                a, b = np.asarray(pair[0], np.int64), np.asarray(pair[1], np.int64)
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                fresh = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
                starts.append(a[fresh])
                ends.append(b[np.append(fresh[1:], len(a)) - 1])
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (starts, ends)]
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("v"), *lists], ["d", "v", "a", "b"])

    listed = ranges.groupBy("d", "v").agg(F.collect_list(F.struct("a", "b")).alias("l"))
    return stage(listed.mapInArrow(merge, "d long, v long, a array<long>, b array<long>"), "repeated-ranges")


def _joined(docs: DataFrame, gone: DataFrame) -> DataFrame:
    spans = gone.agg(F.coalesce(F.sum(F.size("a")), F.lit(0))).first()[0]
    row = 56 + 16 * spans // max(1, gone.count())
    keyed = _keyed(docs).withColumnRenamed("doc_id", "d")
    return keyed.join(sized(gone, row), ["d", "v"], "left").select(F.col("d").alias("doc_id"), "text", "a", "b")


def keep(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id``, the bytes ``kept`` of each row, and the removed ranges ``a``, ``b`` (b exclusive)."""
    chosen = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                kept, first, end = [], [], []
                for text, a, b in zip(texts, part.column("a").to_pylist(), part.column("b").to_pylist()):
                    raw = _raw(text)
                    spans = [(x, min(y, len(raw))) for x, y in zip(a or [], b or []) if x < len(raw)]
                    cut = [0, *(v for span in spans for v in span), len(raw)]
                    kept.append(b"".join(raw[x:y] for x, y in zip(cut[::2], cut[1::2])))
                    first.append([x for x, _ in spans])
                    end.append([y for _, y in spans])
                lists = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(kept, pa.binary()), pa.array(first, lists), pa.array(end, lists)], ["doc_id", "kept", "a", "b"])

    return _joined(chosen, repeated(chosen, length)).mapInArrow(run, "doc_id long, kept binary, a array<long>, b array<long>")


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id``, bytes before, removed bytes and runs, and the digest of what is left, for every row."""
    left = keep(docs, length)
    removed = F.aggregate(F.zip_with("a", "b", lambda x, y: y - x), F.lit(0).cast("long"), lambda s, v: s + v)
    return left.select(
        "doc_id", (F.octet_length("kept") + removed).cast("long").alias("n_bytes"), removed.alias("n_removed"),
        F.size("a").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
