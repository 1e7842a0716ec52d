"""LM scoring with a gated recurrent model over words.

1. Every training token is counted: each task adds up its own words before the shuffle.
2. The ``SLOTS`` - 2 most frequent words, the end of a text and one slot for all other words form the output layer, a
   softmax over classes and one over each class's words.  Another word has the probability of its slot times its share of
   the counts behind the slot, with one count added to each and one for all unknown words; all probabilities add up to 1.
3. A gated recurrent unit is trained by backpropagation through time, cut off after a window while the state goes on.
   Tasks train copies of one initial model on their own training documents; copies are averaged in a tree of
   aggregations, weighted by tokens, and that is done ``ROUNDS`` times.  Every training document is learnt from once, whole,
   in one of the rounds.  The initial output biases are the counts, so an
   untrained model is a smoothed unigram model.
4. Every text is scored whole; its state goes from window to window.  Counts of the ``KNOWN`` most frequent words go with the
   tasks; other words, each of them rare, meet their counts in a shuffled join.

Cases: a null text counts as empty, and an empty text is one end token; rows without a doc_id are scored and not learnt
from; repeated rows are learnt from and scored row by row; without training documents every probability comes from
unknown words and a model without training; other columns are not read.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from itertools import compress
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lyceum.llm.tables import release, small_batches
from lyceum.llm.words import text_slices
from lyceum.sources.staging import stage

CLASSES = 32
PER_CLASS = 32
SLOTS = CLASSES * PER_CLASS
HIDDEN = 16
#: Words whose counts are sent with the tasks; the others are joined.
KNOWN = 50_000
ROUNDS = 2
WINDOW = 16
#: Texts that are learnt side by side: at first, at most, and the tokens after which one more is.
FIRST_LANES, LANES, LANE_TOKENS = 96, 512, 4_096
#: Windows that are joined when few texts are left.
WIDEST = 8
RATE = 0.02
#: Tokens that are scored at a time, unless one batch of texts has more.
SCORED_TOKENS = 1_500_000
#: Tokens whose logits are computed at a time when texts are scored.
BLOCK = 8_192
END = b""  # no word is empty
OTHER_SLOT, END_SLOT = 0, 1
FLUSH = 200_000


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case, and the end."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def training(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("doc_id").isNotNull() & ~held_out())


def count_words(docs: DataFrame) -> DataFrame:
    """``w, c``: each token of ``docs`` and how often it stands there; staged."""

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["w", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for _, texts in text_slices(batch):
                for text in texts:
                    counts.update(tokens(text))
                if len(counts) > FLUSH:
                    yield rows(counts)
                    counts = Counter()
        if counts:
            yield rows(counts)

    counted = docs.select("text").mapInArrow(run, "w binary, c long")
    return stage(counted.groupBy("w").agg(F.sum("c").alias("c")), "word-counts")


class Vocabulary(NamedTuple):
    words: list[bytes]  # the most frequent words first
    counts: np.ndarray
    total: int  # N
    distinct: int  # V

    def slots(self) -> dict[bytes, int]:
        chosen = [w for w in self.words[: SLOTS - 2] if w != END]
        return {END: END_SLOT} | {w: i + 2 for i, w in enumerate(chosen[: SLOTS - 2])}


def vocabulary(counts: DataFrame, known: int = KNOWN) -> Vocabulary:
    """Totals, and the ``known`` most frequent words: a bounded table."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.col("c").desc(), "w").limit(known).toArrow()
    return Vocabulary(top["w"].to_pylist(), np.asarray(top["c"], np.int64), int(total), int(distinct))


class Model(NamedTuple):
    """Weights.  ``slot // PER_CLASS`` is a word's class."""

    embed: np.ndarray  # slot -> input of the three gates
    recur: np.ndarray
    bias: np.ndarray
    to_class: np.ndarray
    class_bias: np.ndarray
    to_word: np.ndarray  # class x hidden x word
    word_bias: np.ndarray


def initial(vocab: Vocabulary, seed: int = 5) -> Model:
    rng = np.random.default_rng(seed)
    slot_counts = np.full(SLOTS, -1.0)
    count_of = dict(zip(vocab.words, vocab.counts.tolist()))
    for w, s in vocab.slots().items():
        slot_counts[s] = count_of.get(w, 0) + 1.0
    slot_counts[OTHER_SLOT] = vocab.total - np.maximum(slot_counts - 1, 0).sum() + 1.0
    with np.errstate(divide="ignore"):
        grid = np.where(slot_counts > 0, np.log(np.maximum(slot_counts, 1e-9)), -1e9).reshape(CLASSES, PER_CLASS)
    class_bias = np.where((grid > -1e8).any(1), np.log(np.maximum(np.where(grid > -1e8, np.exp(grid), 0).sum(1), 1e-9)), -1e9)
    f32 = np.float32
    return Model(
        rng.normal(0, 0.3, (SLOTS, 3 * HIDDEN)).astype(f32), rng.normal(0, 0.25, (HIDDEN, 3 * HIDDEN)).astype(f32),
        np.concatenate([np.full(HIDDEN, -1.0), np.zeros(2 * HIDDEN)]).astype(f32),
        np.zeros((HIDDEN, CLASSES), f32), class_bias.astype(f32), np.zeros((CLASSES, HIDDEN, PER_CLASS), f32), grid.astype(f32),
    )


def _inputs(model: Model) -> np.ndarray:
    """Gates down, slots across: what reading a slot gives to the three gates.  States and gates too have texts across, so that
    every operation runs over whole rows of texts."""
    return np.ascontiguousarray((model.embed + model.bias).T)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """``x`` is used up."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def _step(inputs: np.ndarray, recur: np.ndarray, slot: np.ndarray, h: np.ndarray) -> np.ndarray:
    """New state after reading ``slot``; ``recur`` has gates down."""
    n = HIDDEN
    given, own = np.take(inputs, slot, axis=1), recur @ h
    gates = _sigmoid(given[: 2 * n] + own[: 2 * n])
    fresh = np.tanh(given[2 * n :] + gates[n:] * own[2 * n :])
    fresh -= h
    fresh *= gates[:n]
    fresh += h
    return fresh


def _softmax(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities down each column, and the log of what each column of ``x``, which is shifted, was divided by."""
    x -= x.max(0)
    p = np.exp(x)
    total = p.sum(0)
    p *= 1 / total
    return p, np.log(total)


def log_probability(model: Model, h: np.ndarray, slot: np.ndarray, grads: list | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log-probability of each slot after state ``h``; with ``grads`` also adds weight gradients and returns that of ``h``.
    Words down, tokens across, so that every reduction runs over whole rows."""
    order, own_class, place, state, x = _word_logits(model, h, slot)
    token = np.arange(len(slot))
    d, total = _softmax(x)
    sums = (x[place, token] - total).astype(np.float64)
    back = np.empty_like(state)
    if grads is not None:
        d[place, token] -= 1
        for c, a, b in _class_ranges(own_class):
            grads[5][c] += state[:, a:b] @ d[:, a:b].T
            grads[6][c] += d[:, a:b].sum(1)
            np.matmul(model.to_word[c], d[:, a:b], out=back[:, a:b])
    x = model.to_class.T @ state
    x += model.class_bias[:, None]
    d, total = _softmax(x)
    sums += x[own_class, token] - total
    out = np.empty(len(slot))
    out[order] = sums
    if grads is None:
        return out, None
    d[own_class, token] -= 1
    grads[3] += state @ d.T
    grads[4] += d.sum(1)
    back += model.to_class @ d
    d_h = np.empty_like(back)
    d_h[:, order] = back
    return out, d_h.T


def _class_ranges(own_class: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Each class in sorted ``own_class``, and from where to where it stands there."""
    cut = np.searchsorted(own_class, np.arange(CLASSES + 1)).tolist()
    return ((c, a, b) for c, (a, b) in enumerate(zip(cut, cut[1:])) if a < b)


def _word_logits(model: Model, h: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, ...]:
    """An order of the tokens by class; in that order their classes, places in them, states, and the logits of all words of each one's class."""
    order = np.argsort(slot // PER_CLASS, kind="stable")
    own_class, place = np.divmod(slot[order], PER_CLASS)
    state = np.take(h.T, order, axis=1)
    x = np.take(model.word_bias.T, own_class, axis=1).astype(np.result_type(model.word_bias, state), copy=False)
    for c, a, b in _class_ranges(own_class):
        x[:, a:b] += model.to_word[c].T @ state[:, a:b]
    return order, own_class, place, state, x


def _log_sum(x: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials down each column; ``x`` is used up."""
    top = x.max(0)
    x -= top
    np.exp(x, out=x)
    return top + np.log(x.sum(0))


def log_scores(model: Model, h: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """``log_probability`` without gradients, for blocks of tokens whose logits stay in a core's cache."""
    blocks = [slice(lo, lo + BLOCK) for lo in range(0, len(slot), BLOCK)]
    return np.concatenate([_block_scores(model, h[b], slot[b]) for b in blocks]) if blocks else np.zeros(0)


def _block_scores(model: Model, h: np.ndarray, slot: np.ndarray) -> np.ndarray:
    order, own_class, place, state, x = _word_logits(model, h, slot)
    token = np.arange(len(slot))
    logs = x[place, token].astype(np.float64)
    logs -= _log_sum(x)
    x = model.to_class.T @ state
    x += model.class_bias[:, None]
    logs += x[own_class, token]
    logs -= _log_sum(x)
    out = np.empty(len(slot))
    out[order] = logs
    return out


def _windows(sequences: list[np.ndarray], batch: int, window: int) -> Iterator[tuple]:
    """Groups of texts of like length, longest first: ``(rows, slots, live)`` window by window.  ``slots`` is rows x (window + 1) with the
    token read before each one scored; ``live`` the number of tokens each row has in the window."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    for lo in range(0, len(order), batch):
        rows = np.array(order[lo : lo + batch])
        size = np.array([len(sequences[i]) for i in rows])
        wide = -(-size[0] // window) * window
        slots = np.full((len(rows), wide + 1), END_SLOT, np.int32)
        for k, i in enumerate(rows):
            slots[k, 1 : size[k] + 1] = sequences[i]
        for start in range(0, size[0], window):
            going = int((size > start).sum())
            yield start, rows[:going], slots[:going, start : start + window + 1], np.minimum(size[:going] - start, window)


def _tokens_across(steps: np.ndarray) -> np.ndarray:
    """Steps x values x texts as values x tokens."""
    return steps.transpose(1, 0, 2).reshape(steps.shape[1], -1)


def _steps_first(flat: np.ndarray, span: int) -> np.ndarray:
    """What ``_tokens_across`` was made from."""
    return np.ascontiguousarray(flat.reshape(len(flat), span, -1).transpose(1, 0, 2))


def _chosen(states: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """The states of the tokens ``inside``, one after another across."""
    flat = _tokens_across(states)
    return flat if inside.all() else np.take(flat, np.flatnonzero(inside), axis=1)


def score_texts(model: Model, sequences: list[np.ndarray], batch: int = 2048, window: int = 32) -> np.ndarray:
    """Natural log-probability of each whole sequence of slots."""
    out = np.zeros(len(sequences))
    inputs, recur = _inputs(model), np.ascontiguousarray(model.recur.T)
    h = np.zeros((HIDDEN, 0), np.float32)
    for start, rows, slots, live in _windows(sequences, batch, window):
        h = np.zeros((HIDDEN, len(rows)), np.float32) if start == 0 else h[:, : len(rows)]
        states = np.empty((int(live[0]), HIDDEN, len(rows)), np.float32)
        for t in range(int(live[0])):
            h = states[t] = _step(inputs, recur, slots[:, t], h)
        inside = np.arange(int(live[0]))[:, None] < live
        logs = log_scores(model, _chosen(states, inside).T, slots[:, 1 : int(live[0]) + 1].T[inside])
        out += np.bincount(np.broadcast_to(rows, inside.shape)[inside], logs, len(out))
    return out


class Trainer:
    """Adam steps over windows of lanes.  A lane reads whole texts one after another: the state is carried through a text and
    starts from zero with the next one; its gradient is cut at the window's start.  Lanes are added as tokens are learnt."""

    def __init__(self, model: Model):
        self.model = model
        self.first, self.second = ([np.zeros_like(p) for p in model] for _ in range(2))
        self.steps = self.tokens = 0
        self.waiting: deque[np.ndarray] = deque()
        self.lanes: list[tuple[np.ndarray, int]] = []  # the text that each lane reads, and how far
        self.h = np.zeros((HIDDEN, 0), np.float32)

    def learn(self, sequences: list[np.ndarray], last: bool = True) -> None:
        """Learns from every token of the texts; without ``last``, texts that are begun or wait go on with the next call."""
        self.waiting.extend(sorted(sequences, key=len, reverse=True))
        while len(self.waiting) > LANES or (last and (self.waiting or self.lanes)):
            self._advance()

    def _advance(self) -> None:
        """One window of every lane; a lane whose text ends in it begins a text that waits."""
        wanted = min(max(FIRST_LANES, self.tokens // LANE_TOKENS), LANES)
        fresh = [(self.waiting.popleft(), 0) for _ in range(min(wanted - len(self.lanes), len(self.waiting)))]
        h = np.concatenate([self.h, np.zeros((HIDDEN, len(fresh)), np.float32)], 1)
        count = h.shape[1]
        window = WINDOW * min(max(wanted // max(count, 1), 1), WIDEST)  # few lanes read further at a time
        slots = np.full((count, window + 1), END_SLOT, np.int32)
        starts = np.zeros((count, window), bool)
        live = np.zeros(count, np.int64)
        going, lanes = [], []
        for k, (text, at) in enumerate(self.lanes + fresh):
            slots[k, 0] = text[at - 1] if at else END_SLOT
            n = 0
            while n < window:
                if at == len(text):
                    if not self.waiting:
                        break
                    text, at = self.waiting.popleft(), 0
                if at == 0:
                    starts[k, n] = True
                took = text[at : at + window - n]
                slots[k, n + 1 : n + 1 + len(took)] = took
                n, at = n + len(took), at + len(took)
            live[k] = n
            if at == len(text) and self.waiting:
                text, at = self.waiting.popleft(), 0
            if at < len(text):
                going.append(k)
                lanes.append((text, at))
        self.lanes, self.h = lanes, self._window(h, slots, live, starts)[:, going]

    def _window(self, h: np.ndarray, slots: np.ndarray, live: np.ndarray, starts: np.ndarray) -> np.ndarray:
        model, n, span = self.model, HIDDEN, int(live.max())
        grads = [np.zeros_like(p) for p in model]
        read = slots[:, :span].T
        lanes = read.shape[1]
        inputs, recur = _inputs(model), np.ascontiguousarray(model.recur.T)
        kind = np.result_type(inputs, h)
        going = (~starts[:, :span].T).astype(kind)
        gates, own, before, states = (np.empty((span, k * n, lanes), kind) for k in (3, 1, 1, 1))
        moved = np.empty((3 * n, lanes), kind)
        for own_t, h_t, to, ids, goes, gate in zip(own, before, states, read, going, gates):
            h = np.multiply(h, goes, out=h_t)
            np.matmul(recur, h, out=moved)
            own_t[:] = moved[2 * n :]
            np.take(inputs, ids, axis=1, out=gate, mode="clip")
            both, new = gate[: 2 * n], gate[2 * n :]
            both += moved[: 2 * n]
            _sigmoid(both)
            new += np.multiply(gate[n : 2 * n], own_t, out=to)
            np.tanh(new, out=new)
            h = np.subtract(new, h, out=to)
            h *= gate[:n]
            h += h_t
        inside = np.arange(span)[:, None] < live
        _, back = log_probability(model, _chosen(states, inside).T, slots[:, 1 : span + 1].T[inside], grads)
        d_states = np.zeros((n, span * lanes), kind)
        d_states[:, np.flatnonzero(inside)] = back.T
        d_states = _steps_first(d_states, span)
        # What the gradient of a state is multiplied by on its way to the three gates, and to the state before it.
        update, reset, fresh = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
        to_fresh = update * (1 - fresh * fresh)
        factors = np.stack([(fresh - before) * update * (1 - update), to_fresh * own * reset * (1 - reset), to_fresh * reset], 1)
        kept = (1 - update) * going[:, None]
        dh = np.zeros_like(h)
        d_own = factors
        for d_t, own_t, keeps, goes in zip(d_states[::-1], d_own[::-1], kept[::-1], going[::-1]):
            dh = np.add(dh, d_t, out=d_t)
            own_t *= dh
            more = model.recur @ own_t.reshape(3 * n, lanes)
            more *= goes
            dh = dh * keeps
            dh += more
        flat = _tokens_across(d_own.reshape(span, 3 * n, lanes))
        grads[1] += _tokens_across(before) @ flat.T
        flat[2 * n :] = _tokens_across(d_states * to_fresh)
        grads[2] += flat.sum(1)
        order = np.argsort(read.ravel(), kind="stable")
        slot, begin = np.unique(read.ravel()[order], return_index=True)
        grads[0][slot] = np.add.reduceat(np.take(flat, order, axis=1), begin, axis=1).T
        self._adam(grads, int(inside.sum()))
        return h

    def _adam(self, grads: list[np.ndarray], count: int) -> None:
        self.steps += 1
        self.tokens += count
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads)) / count
        scale = float(1 / count * min(1.0, 1.0 / max(norm, 1e-9)))  # a numpy number would widen the weights
        # The last, longest texts go on in few lanes: a step over fewer tokens is shorter, so that they do not outweigh the others.
        share = min(1.0, count / (min(FIRST_LANES, LANES) * WINDOW))
        rate = float(RATE * share * np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps))
        for p, g, a, b in zip(self.model, grads, self.first, self.second):
            g *= scale
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            g *= g
            g *= 0.01
            b += g
            np.sqrt(b, out=g)
            g += 1e-6
            np.divide(a, g, out=g)
            g *= rate
            p -= g


def _slot_table(vocab_slots: dict[bytes, int]):
    return lambda words: np.fromiter((vocab_slots.get(w, OTHER_SLOT) for w in words), np.int32, len(words))


def _flat(model: Model) -> np.ndarray:
    return np.concatenate([p.ravel() for p in model]).astype(np.float32)


def _shaped(flat: np.ndarray, like: Model) -> Model:
    parts, at = [], 0
    for p in like:
        parts.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32))
        at += p.size
    return Model(*parts)


def train(docs: DataFrame, vocab: Vocabulary, one_in: int = 1, rounds: int = ROUNDS) -> Model:
    """Rounds of local training and averaging: one pass over ``docs``, of which each round takes its share by hash.  (With
    ``one_in`` above 1 only that share of them is learnt from.)  Only the average, some 300 kB, comes to the driver."""
    model = initial(vocab)
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(one_in * rounds))
    slots = vocab.slots()
    pieces = 16
    for k in range(rounds):
        chosen = docs.filter(drawn == k).select("text")
        sent = docs.sparkSession.sparkContext.broadcast((tuple(model), slots))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            weights, table = sent.value
            trainer = Trainer(Model(*(p.copy() for p in weights)))
            to_slots = _slot_table(table)
            for batch in batches:
                for _, texts in text_slices(batch):
                    trainer.learn([to_slots(tokens(text)) for text in texts], last=False)
            trainer.learn([])
            if trainer.tokens:
                parts = np.array_split(_flat(trainer.model), pieces)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(pieces, dtype=np.int32)), pa.array(np.full(pieces, trainer.tokens)), pa.array([p.tobytes() for p in parts], pa.binary())],
                    ["part", "n", "p"],
                )

        def mean(pdf: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros(len(pdf["p"].iloc[0]) // 4)
            for n, p in zip(pdf["n"], pdf["p"]):
                total += n * np.frombuffer(p, np.float32)
            n = int(pdf["n"].sum())
            return pd.DataFrame({"part": pdf["part"].iloc[:1], "n": [n], "p": [(total / n).astype(np.float32).tobytes()]})

        kind = "part int, n long, p binary"
        copies = stage(chosen.mapInArrow(run, kind).withColumn("branch", F.pmod(F.spark_partition_id(), F.lit(64))), "lm-copies")
        halfway = copies.groupBy("part", "branch").applyInPandas(lambda pdf: mean(pdf), kind)
        rows = halfway.groupBy("part").applyInPandas(mean, kind).orderBy("part").collect()
        if rows:
            model = _shaped(np.concatenate([np.frombuffer(r.p, np.float32) for r in rows]), model)
    return model


def score(docs: DataFrame, one_in: int = 1, rounds: int = ROUNDS, known: int = KNOWN) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row; scores are log10."""
    spark = docs.sparkSession
    docs = small_batches(docs.select("doc_id", "text"))
    counts = count_words(training(docs))
    vocab = vocabulary(counts, known)
    model = train(training(docs), vocab, one_in, rounds)
    slots = vocab.slots()
    in_slots = sum(c for w, c in zip(vocab.words, vocab.counts.tolist()) if w in slots)
    behind = vocab.total - in_slots + vocab.distinct - sum(w in slots for w in vocab.words) + 1
    sent = spark.sparkContext.broadcast((tuple(model), slots, vocab.words, vocab.counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, table, words, known_counts = sent.value
        own = Model(*weights)
        number = {w: i for i, w in enumerate(words)}
        slot_of = np.array([table.get(w, OTHER_SLOT) for w in words] + [OTHER_SLOT], np.int32)
        log_count = np.log10(np.append(known_counts, 0) + 1.0)  # the last for words that are not here
        log_other = np.where(slot_of == OTHER_SLOT, log_count, 0.0)
        names = ["doc_id", "n_tokens", "n_known", "base", "other", "n_other"]
        held: dict[str, list] = {k: [] for k in [*names, "rest", "w", "n"]}
        sequences: list[np.ndarray] = []

        def scored() -> pa.RecordBatch:
            pairs = pa.StructArray.from_arrays([pa.array(held["w"], pa.binary()), pa.array(held["n"], pa.int64())], ["w", "n"])
            rest = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *held["rest"]]), pa.int32()), pairs)
            columns = [pa.array(held["doc_id"], pa.int64()), *(pa.array(held[k]) for k in names[1:]), rest]
            columns.append(pa.array(score_texts(own, sequences) / np.log(10)))
            for values in held.values():
                values.clear()
            sequences.clear()
            return pa.RecordBatch.from_arrays(columns, [*names, "rest", "model"])

        # Texts of several batches are scored together: a step then moves more of them at once.
        for batch in batches:
            for part, texts in text_slices(batch, limit=2 << 20):
                held["doc_id"].extend(part.column("doc_id").to_pylist())
                for text in texts:
                    words_ = tokens(text)
                    at = np.fromiter((number.get(w, -1) for w in words_), np.int64, len(words_))
                    slot = slot_of[at]
                    if not len(words):
                        slot[-1] = END_SLOT
                    sequences.append(slot)
                    held["n_tokens"].append(len(at))
                    held["n_known"].append(int((at >= 0).sum()))
                    held["base"].append(float(log_count[at].sum()))
                    held["other"].append(float(log_other[at].sum()))
                    held["n_other"].append(int((slot == OTHER_SLOT).sum()))
                    rest = Counter(compress(words_, (at < 0).tolist()))
                    rest.pop(END, None)
                    held["rest"].append(len(rest))
                    held["w"].extend(rest)
                    held["n"].extend(rest.values())
                if sum(held["n_tokens"]) >= SCORED_TOKENS:
                    yield scored()
        if sequences:
            yield scored()

    kind = "doc_id long, n_tokens long, n_known long, base double, other double, n_other long, rest array<struct<w: binary, n: long>>, model double"
    partial = stage(docs.mapInArrow(run, kind).withColumn("rid", F.monotonically_increasing_id()), "lm-partial")
    release(spark)
    rest = partial.select("rid", F.inline("rest")).join(counts, "w").groupBy("rid")
    joined = rest.agg(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("n").alias("found"))
    more = F.coalesce("more", F.lit(0.0))
    return partial.drop("rest").join(joined, "rid", "left").select(
        "doc_id", held_out().alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.log10(F.lit(float(vocab.total + vocab.distinct + 1)))).alias("base_score"),
        (F.col("model") + F.col("other") + more - F.col("n_other") * F.log10(F.lit(float(behind)))).alias("score"),
    )
