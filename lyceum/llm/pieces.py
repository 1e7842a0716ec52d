"""SentencePiece encoding and decoding (BPE models) by vectorised merge rounds.

A text is cut where no merge can cross: before a run of space marks and around characters that stand in no piece.
The distinct segments of a batch are merged together.  All their symbols lie in one flat array; a round finds each
segment's best pair by a segmented minimum over pair ranks, merges every leftmost occurrence of it at once and compacts
the array, until no segment has a pair left.  Where a merge could make a pair of an equal or better rank, only the
segment's first occurrence is merged in a round, which keeps the order of the sequential algorithm.

Cases: null counts as empty; empty gives only the begin and end ids; repeated rows are encoded like any row; very long
texts are whole; other columns are left alone unless they have the name of a result column, which then replaces them.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lyceum.llm.tables import small_batches
from lyceum.llm.words import text_slices

MARK = "▁"
NONE = np.iinfo(np.int32).max
CACHE_SEGMENTS = 60_000
#: Segments longer than this (such as pages of blanks) take one merge at a time from a heap instead of rounds.
LONG_SEGMENT = 2_000
#: Of sentencepiece's model format: kinds of pieces.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Model(NamedTuple):
    """What encoding and decoding need of a model file; about 1 MB, sent with the tasks."""

    pieces: list[str]
    kinds: list[int]
    scores: list[float]
    bos: int
    eos: int
    unk: int
    dummy_prefix: bool
    byte_fallback: bool
    unk_surface: str


def load(path: str) -> Model:
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    norm, trained = proto.normalizer_spec, proto.trainer_spec
    kinds = [p.type for p in proto.pieces]
    if trained.model_type != 2:
        raise ValueError("not a BPE model")
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
        raise ValueError("only models with the identity normaliser and kept white space are supported")
    if trained.treat_whitespace_as_suffix or USER in kinds or UNUSED in kinds:
        raise ValueError("suffix white space, user-defined and unused pieces are not supported")
    pieces = [p.piece for p in proto.pieces]
    of = {p: i for i, p in enumerate(pieces)}
    return Model(
        pieces, kinds, [p.score for p in proto.pieces], of.get("<s>", -1), of.get("</s>", -1), kinds.index(UNKNOWN),
        norm.add_dummy_prefix, trained.byte_fallback, trained.unk_surface or " ⁇ ",
    )


def merge_tables(model: Model) -> dict:
    """Pair ranks and symbol tables of a model (a few MB of plain arrays), made once on the driver."""
    normal = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == NORMAL}
    base = len(model.pieces)  # a character without a piece of its own is the symbol base + code point
    scores = sorted({model.scores[i] for i in normal.values()}, reverse=True)
    rank_of = {s: r for r, s in enumerate(scores)}
    rank = {p: rank_of[model.scores[i]] for p, i in normal.items()}
    keys, made, ranks = [], [], []
    careful: set[int] = set()
    for piece, i in normal.items():
        for cut in range(1, len(piece)):
            parts = piece[:cut], piece[cut:]
            a, b = (normal.get(s, base + ord(s) if len(s) == 1 else None) for s in parts)
            if a is not None and b is not None:
                keys.append(a << 32 | b)
                made.append(i)
                ranks.append(rank[piece])
                careful.update(rank[part] for part in parts if len(part) > 1 and rank[part] >= rank[piece])
    if not keys:  # a model without merges: one pair that never occurs
        keys, made, ranks = [-1], [0], [NONE]
    order = np.argsort(np.array(keys, np.int64))
    is_careful = np.zeros(len(scores) + 1, bool)
    is_careful[list(careful)] = True
    chars = {ord(p): i for p, i in normal.items() if len(p) == 1}
    alone = re.escape("".join(c for c in map(chr, range(128)) if not any(c in p for p in normal)))
    segment = f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+"
    return {
        "model": tuple(model), "base": base, "keys": np.array(keys, np.int64)[order], "made": np.array(made, np.int64)[order],
        "ranks": np.array(ranks, np.int32)[order], "careful": is_careful, "chars": chars,
        "pattern": None if any(MARK in p.lstrip(MARK) for p in normal) else f"[{alone}]|{segment}" if alone else segment,
        "bytes": [model.pieces.index(f"<0x{x:02X}>") for x in range(256)] if model.byte_fallback else [],
    }


class Encoder:
    """Encodes with the tables of a model.  Encoded segments are kept beside the tables, for as long as a worker
    keeps those, so later batches and tasks use them too."""

    def __init__(self, tables: dict):
        self.model = Model(*tables["model"])
        self.base, self.keys, self.made, self.ranks, self.careful, self.bytes = (
            tables[k] for k in ("base", "keys", "made", "ranks", "careful", "bytes")
        )
        self.chars = np.arange(0x110000, dtype=np.int32) + self.base
        self.chars[list(tables["chars"])] = list(tables["chars"].values())
        self.cut = re.compile(tables["pattern"]).findall if tables["pattern"] else lambda t: [t]
        self.packed: dict[int, bytes] = tables.setdefault("packed", {i: i.to_bytes(4, "little") for i in range(self.base)})
        self.cache: dict[str, bytes] = tables.setdefault("cache", {})

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NONE if no piece) and the piece it makes."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE).astype(np.int32), self.made[at]

    def _rounds(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left of all segments, and the segment of each, in order."""
        sym = self.chars[np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        seg = np.repeat(np.arange(len(segments)), [len(s) for s in segments])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(sym), NONE, np.int32)
        made = np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            rank[:-1], made[:-1] = self._pairs(sym[:-1], sym[1:])
            rank[:-1][seg[:-1] != seg[1:]] = NONE
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            sizes = np.diff(np.append(starts, len(sym)))
            best = np.minimum.reduceat(rank, starts)
            if (over := best == NONE).any():
                out = np.repeat(over, sizes)
                done.append((sym[out], seg[out]))
                stay = ~out
                sym, seg, rank, made, best, sizes = sym[stay], seg[stay], rank[stay], made[stay], best[~over], sizes[~over]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            owner = seg[at]
            # Occurrences side by side overlap: of each run every second one is merged, from the left.
            fresh = np.concatenate([[True], (np.diff(at) != 1) | (owner[1:] != owner[:-1])])
            place = np.arange(len(at))
            odd = (place - np.maximum.accumulate(np.where(fresh, place, 0))) & 1
            take = odd == 0
            if (slow := self.careful[rank[at]]).any():
                take &= ~slow | np.concatenate([[True], owner[1:] != owner[:-1]])
            at = at[take]
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))  # where the merged symbols stand after compaction
            sym, seg, rank, made = sym[keep], seg[keep], rank[keep], made[keep]
            touched = np.zeros(len(sym) + 1, bool)
            touched[moved] = True
            touched[moved - 1] = True  # before the first symbol: the spare last place
            near = np.flatnonzero(touched[:-1])
            last = near == len(sym) - 1
            rank[near[last]] = NONE
            near = near[~last]
            rank[near], made[near] = self._pairs(sym[near], sym[near + 1])
            rank[near[seg[near] != seg[near + 1]]] = NONE
        if not done:
            return sym, seg
        sym, seg = np.concatenate([s for s, _ in done]), np.concatenate([g for _, g in done])
        order = np.argsort(seg, kind="stable")
        return sym[order], seg[order]

    def _heap(self, segment: str) -> list[int]:
        """The same merges one at a time: for one very long segment."""
        sym = self.chars[[ord(c) for c in segment]].astype(np.int64)
        ranks, made = self._pairs(sym[:-1], sym[1:])
        syms, n = sym.tolist(), len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(int(r), i, syms[i], syms[i + 1], int(m)) for i, (r, m) in enumerate(zip(ranks, made)) if r != NONE]
        heapq.heapify(heap)
        pair: dict[int, tuple[int, int]] = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist()))) if heap else {}
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i]
            if syms[i] != a or j >= n or syms[j] != b:
                continue
            syms[i], syms[j] = m, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n and (hit := pair.get(syms[x] << 32 | syms[after[x]])):
                    heapq.heappush(heap, (hit[0], x, syms[x], syms[after[x]], hit[1]))
        return [s for s in syms if s >= 0]

    def _ids(self, symbol: int) -> bytes:
        if symbol not in self.packed:
            raw = chr(symbol - self.base).encode("utf-8", "surrogatepass")
            ids = [self.bytes[x] for x in raw] if self.bytes else [self.model.unk]
            self.packed[symbol] = b"".join(i.to_bytes(4, "little") for i in ids)
        return self.packed[symbol]

    def _learn(self, segments: list[str]) -> None:
        short = [s for s in segments if len(s) <= LONG_SEGMENT]
        for s in segments:
            if len(s) > LONG_SEGMENT:
                self.cache[s] = b"".join(map(self._ids, self._heap(s)))
        if not short:
            return
        sym, seg = self._rounds(short)
        codes = list(map(self._ids, sym.tolist()))
        cuts = np.searchsorted(seg, np.arange(len(short) + 1)).tolist()
        for k, s in enumerate(short):
            self.cache[s] = b"".join(codes[cuts[k] : cuts[k + 1]])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, packed as little-endian unsigned 32-bit integers."""
        prefix = MARK if self.model.dummy_prefix else ""
        cut = [self.cut(prefix + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.cache) > CACHE_SEGMENTS:
            self.cache.clear()
        new = set().union(*cut).difference(self.cache)
        if new:
            self._learn(list(new))
        begin = self.packed[self.model.bos] if self.model.bos >= 0 else b""
        end = self.packed[self.model.eos] if self.model.eos >= 0 else b""
        out = [begin + b"".join(map(self.cache.__getitem__, c)) + end for c in cut]
        return out if self.bytes else [self._joined_unknowns(x) for x in out]

    def _joined_unknowns(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, "<u4")
        twice = np.concatenate([[False], (ids[1:] == self.model.unk) & (ids[:-1] == self.model.unk)]) if len(ids) else []
        return ids[~np.asarray(twice, bool)].tobytes()


codecs.register_error("piece_bytes", lambda e: ("�", e.start + 1))


class Decoder:
    def __init__(self, model: Model):
        self.model = model
        self.table: list[bytes] = []
        for piece, kind in zip(model.pieces, model.kinds):
            if kind == BYTE:
                self.table.append(bytes([int(piece[3:5], 16)]))
            elif kind == CONTROL:
                self.table.append(b"")
            else:
                self.table.append((model.unk_surface if kind == UNKNOWN else piece.replace(MARK, " ")).encode())
        self.spaced = np.array([k == NORMAL and p.startswith(MARK) for p, k in zip(model.pieces, model.kinds)])
        self.silent = np.array([k == CONTROL for k in model.kinds])

    def decode(self, packed: bytes | None) -> str:
        ids = np.frombuffer(packed or b"", "<u4")
        raw = b"".join(map(self.table.__getitem__, ids.tolist()))
        if self.model.dummy_prefix:
            head = next((i for i in ids if not self.silent[i]), None)
            if head is not None and self.spaced[head]:
                raw = raw[1:]
        return raw.decode("utf-8", "piece_bytes")


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    columns = {f: batch.column(f) for f in batch.schema.names if f != name}
    return pa.RecordBatch.from_pydict(columns | {name: values})


def encode(df: DataFrame, model: Model, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` without ``text``, with the packed ids (little-endian unsigned 32-bit integers) in ``ids``."""
    rest = df.drop(ids) if ids != text else df
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema if f.name != text)
    sent = df.sparkSession.sparkContext.broadcast(merge_tables(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Encoder(sent.value)
        for batch in batches:
            for part, texts in text_slices(batch, text, 1 << 20):
                yield _with(part.drop_columns([text]), ids, pa.array(tool.encode(texts), pa.binary()))

    return small_batches(rest).mapInArrow(run, f"{schema}, `{ids}` binary" if schema else f"`{ids}` binary")


def decode(df: DataFrame, model: Model, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of the packed ids."""
    rest = df.drop(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    sent = df.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Decoder(Model(*sent.value))
        for batch in batches:
            for part, packed in text_slices(batch, ids, 1 << 20):
                yield _with(part, text, pa.array(map(tool.decode, packed), pa.string()))

    return small_batches(rest).mapInArrow(run, f"{schema}, `{text}` string")


def digests(df: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, number of ids and digests of ids and of the text decoded from them, for each row of ``df``."""
    sent = df.sparkSession.sparkContext.broadcast(merge_tables(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(sent.value)
        back = Decoder(coder.model)
        for batch in batches:
            for part, texts in text_slices(batch, "text", 1 << 19):
                ids = coder.encode(texts)
                again = [back.decode(x) for x in ids]
                sha = [[hashlib.sha256(x).hexdigest() for x in xs] for xs in (ids, (t.encode() for t in again))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), *(pa.array(x, pa.string()) for x in sha)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    # Encoded and decoded in one worker: neither ids nor texts pass between processes only to be hashed.
    return small_batches(df.select("doc_id", "text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
