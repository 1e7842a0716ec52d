"""Words and word n-grams of a batch of texts as flat numpy arrays.

A word is a maximal run of characters other than ASCII white space, lower-cased.  Hashes are 64 bits wide:
a polynomial over the bytes (wrapping arithmetic, a random value per byte) and a final mix.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time, unless one text is longer.
SLICE = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240901).integers(1, 1 << 63, 256, dtype=np.uint64)
_POSITIONS = np.random.default_rng(20240902).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n - 1; kept by the worker."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 19)
        made = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=np.uint64))
        _powers[:] = made
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial of the bytes; ``range_hash`` reads any range from it."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=out[1:], dtype=np.uint64)
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes ``start`` to ``end`` for each pair, the same wherever the bytes stand."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _POSITIONS[0])


class Words(NamedTuple):
    data: np.ndarray  # bytes of all lower-cased texts, each followed by a line feed
    start: np.ndarray  # of each word
    end: np.ndarray
    doc: np.ndarray  # index of the word's text
    first: np.ndarray  # index of each text's first word, and the number of words at last
    hash: np.ndarray


def words(texts: list[str | None], ascii_only: bool = False) -> Words:
    """Words of the texts; with ``ascii_only`` no letters but A-Z are lower-cased."""
    if ascii_only:
        parts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    else:
        parts = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    ends = np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)))
    blank = SPACE[data]
    turn = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(data) and not blank[0]:
        turn = np.concatenate([[0], turn])
    start, end = turn[0::2], turn[1::2]
    first = np.concatenate([[0], np.searchsorted(start, ends)])
    doc = np.repeat(np.arange(len(parts)), np.diff(first))
    return Words(data, start, end, doc, first, range_hash(prefix_sums(data), start, end))


class Grams(NamedTuple):
    doc: np.ndarray
    word: np.ndarray  # index of the n-gram's first word
    hash: np.ndarray


def grams(w: Words, n: int, whole_short: bool = True) -> Grams:
    """Every n-gram within a text; a text of 1 to n - 1 words gives the one gram of all its words if asked."""
    count = np.diff(w.first)
    total = len(w.hash)
    at = np.arange(total)
    start = at[at + n <= w.first[1:][w.doc]] if total else at
    h = np.full(len(start), n, np.uint64)
    for k in range(n):
        h += w.hash[start + k] * _POSITIONS[k + 1]
    doc = w.doc[start]
    if whole_short and (short := np.flatnonzero((count > 0) & (count < n))).size:
        extra = count[short].astype(np.uint64)
        for k in range(n - 1):
            has = count[short] > k
            extra[has] += w.hash[w.first[short[has]] + k] * _POSITIONS[k + 1]
        start, h, doc = (
            np.concatenate(x) for x in ((start, w.first[short]), (h, extra), (doc, short))
        )
        order = np.argsort(doc, kind="stable")
        start, h, doc = start[order], h[order], doc[order]
    return Grams(doc, start, mix(h))


def text_slices(batch: pa.RecordBatch, name: str = "text", limit: int = SLICE) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of a batch of about ``limit`` bytes of text, and their texts: Python holds one part's strings at a time."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(name)), 0), np.int64) + 1)
    lo, before = 0, 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(sizes, before + limit, "right")))
        part = batch.slice(lo, hi - lo)
        yield part, part.column(name).to_pylist()
        lo, before = hi, int(sizes[hi - 1])


def slices(texts: list[str | None], limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters, so that working arrays stay small; a longer text stands alone."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= limit:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)
