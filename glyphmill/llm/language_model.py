"""Document log-likelihood under a gated recurrent language model, trained here in numpy.

Words are counted over the whole corpus.  The most frequent are the model's words; the
others share slots by hash, and of a slot's probability each word has the share of its own
count, so the probabilities of all words of the corpus and the end sum to one.  These counts stay a
table that grows with the corpus; a chunk of texts asks it once for each of its words.  Texts become
ids once, in a working table that the rounds and the scoring read.  The output
softmax is factored: a class of 64 words first, then the word in its class.

Every document trains the model on all of its windows in every round, by backpropagation
truncated to a window, with the state carried from window to window.  A document that ends leaves
its place in the batch to the next one, over all of a partition.  Partitions train side by side from common weights, and the
weights are averaged by words between rounds.  Scoring carries the state over all
windows of a document, so a text counts from its first word to its end.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch, Shared
from .blobs import runs, texts
from .words import U, Words, chunks, gather, mix, settle

CLASS = 64
CLASSES = 32
VOCABULARY = CLASS * CLASSES
SLOTS = 128
HIDDEN = 16
WINDOW = 16
ROUNDS = 2
BATCH = 128
BLOCK = 8192
TOGETHER = 128
LENGTH = 64
PIECE = 1 << 14
RANGE_BYTES = 8 << 20
BLOBS = ("words", "values", "n", "ids", "missing", "size", "own", "score")
CODED = ", ".join(["chunk long", "bucket long", *[f"{c} binary" for c in BLOBS]])
CODED_ARROW = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), *[(c, pa.binary()) for c in BLOBS]])


class Vocabulary:
    """Ids by rank of frequency; id of a slot for every other word; `slot_counts` are the occurrences of the words of each slot."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, slot_counts: np.ndarray, n_docs: int):
        size = VOCABULARY - SLOTS - 1
        words, counts = words[:size], counts[:size]
        kind = np.concatenate([np.zeros(len(words)), np.ones(SLOTS), [2]])
        total = np.concatenate([counts, slot_counts, [n_docs]]).astype(np.float64)
        order = np.argsort(-total, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        by = np.argsort(words)
        self.words, self.ids = words[by], place[: len(words)][by]
        self.slots, self.slot_counts = place[kind == 1], slot_counts
        self.end = int(place[-1])
        near = np.searchsorted(self.words, np.arange(1 << 16, dtype=U) << U(48))  # of a hash's first 16 bits, the first word
        self.near, self.crowded = np.minimum(near, max(len(words) - 1, 0)), np.diff(near, append=len(words)) > 1
        self.shared = np.zeros(VOCABULARY, bool)
        self.shared[self.slots] = True
        self.counts = np.zeros(VOCABULARY)
        self.counts[: len(order)] = total[order]

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Which words are the model's own."""
        if not len(self.words):
            return np.zeros(len(hashes), bool)
        return self.words[np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)] == hashes

    def shares(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log of each slot word's part of the occurrences in its slot."""
        return np.log(counts / self.slot_counts[slot_of(words)])

    def encode(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return self.slots[slot_of(hashes)]
        top = (hashes >> U(48)).astype(np.int64)
        at = self.near[top]
        crowd = np.flatnonzero(self.crowded[top])
        at[crowd] = np.minimum(np.searchsorted(self.words, hashes[crowd]), len(self.words) - 1)
        out, rest = self.ids[at], np.flatnonzero(self.words[at] != hashes)
        out[rest] = self.slots[slot_of(hashes[rest])]
        return out


def slot_of(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes) >> U(64 - 7)).astype(np.int64)


def _counts(bits: int):
    def run(batches):
        for batch in batches:
            for piece in chunks(batch, 1, 12 << 20):
                words, n = np.unique(Words(piece.column(1)).hashes, return_counts=True)
                cut = np.searchsorted(words >> U(64 - bits), np.arange((1 << bits) + 1, dtype=U))
                spans = [(b, x, y) for b, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if y > x]
                n = n.astype(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in spans], pa.int64()), pa.array([words[x:y].tobytes() for _, x, y in spans], pa.binary()), pa.array([n[x:y].tobytes() for _, x, y in spans], pa.binary())], names=["bucket", "words", "n"])

    return run


def _totals(table: pa.Table) -> pa.Table:
    """Of a range of word hashes: every word with its occurrences."""
    words, n = gather(table["words"].to_pylist(), U), gather(table["n"].to_pylist(), np.uint32).astype(np.int64)
    order = np.argsort(words)
    words, n = words[order], n[order]
    first, _ = runs(words)
    return pa.table({"word": words[first].astype(np.int64), "n": np.add.reduceat(n, first) if len(n) else n})


def vocabulary(own: DataFrame) -> tuple[Vocabulary, DataFrame, int]:
    """Counts every word of the corpus: the model's words and slots, the table (word, n) of all, and the bits that cut it into ranges.

    Only as many rows as the model has words and slots reach the driver.
    """
    spark = own.sparkSession
    total = own.agg(F.sum(F.octet_length("_text")), F.count("*")).first()
    bits = max(2, int((total[0] or 0) / RANGE_BYTES).bit_length())
    counted = own.select("_id", "_text").mapInArrow(_counts(bits), "bucket long, words binary, n binary").groupBy("bucket").applyInArrow(_totals, "word long, n long")
    counted = Scratch(spark).table(counted, "words")
    top = counted.orderBy(F.desc("n"), "word").limit(VOCABULARY - SLOTS - 1).collect()
    words, counts = np.array([r.word for r in top], np.int64).astype(U), np.array([r.n for r in top], np.float64)
    chosen = Shared(spark, np.sort(words))

    def others(batches):
        for batch in batches:
            w = batch.column(0).to_numpy().astype(U)
            at = np.minimum(np.searchsorted(chosen.value, w), max(len(chosen.value) - 1, 0))
            out = chosen.value[at] != w if len(chosen.value) else np.ones(len(w), bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLOTS)), pa.array(np.bincount(slot_of(w[out]), batch.column(1).to_numpy()[out], SLOTS).astype(np.int64))], names=["s", "n"])

    n = np.zeros(SLOTS)
    for r in counted.mapInArrow(others, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).collect():
        n[r.s] = r.n
    return Vocabulary(words, counts, n, total[1]), counted, bits


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Model:
    """E embeds the last word; W, V, b are the gates (update, reset, candidate); C chooses the class, D the word in it, their last row for the unit that is always one."""

    SHAPES = {"E": (VOCABULARY + 1, HIDDEN), "W": (HIDDEN, 3 * HIDDEN), "V": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,), "C": (HIDDEN + 1, CLASSES), "D": (CLASSES, HIDDEN + 1, CLASS)}

    def __init__(self, flat: np.ndarray):
        self.flat, self.gradient, at = flat, None, 0
        for name, shape in self.SHAPES.items():
            n = int(np.prod(shape))
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def size(cls) -> int:
        return sum(int(np.prod(s)) for s in cls.SHAPES.values())

    @classmethod
    def start(cls, vocabulary: Vocabulary, seed: int = 3) -> Model:
        """Small random weights over the unigram model."""
        model, rng = cls(np.zeros(cls.size(), np.float32)), np.random.default_rng(seed)
        for name in ("E", "W", "V"):
            w = getattr(model, name)
            w[...] = rng.normal(0, 0.3 if name == "E" else HIDDEN**-0.5, w.shape)
        model.C[:-1] = rng.normal(0, 0.05, (HIDDEN, CLASSES))
        model.D[:, :-1] = rng.normal(0, 0.05, (CLASSES, CLASS, HIDDEN)).transpose(0, 2, 1)
        n = (vocabulary.counts + 0.1).reshape(CLASSES, CLASS)
        model.C[-1] = np.log(n.sum(axis=1) / n.sum())
        model.D[:, -1] = np.log(n)
        return model

    def step(self, a: np.ndarray, h: np.ndarray):
        """One step in plain form, a row for each document."""
        u = h @ self.V
        zr = _sigmoid(a[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(a[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
        return n + z * (h - n), z, r, n, u

    def output(self, h: np.ndarray, y: np.ndarray):
        """Log-probability of each y after state h, and None."""
        order, out = by_class(y), np.empty(len(y), h.dtype)
        out[order] = self.words(np.concatenate([h, np.ones((len(h), 1), h.dtype)], axis=1)[order], y[order])[0]
        return out, None

    def words(self, h: np.ndarray, y: np.ndarray, gradient: "Model | None" = None):
        """For rows in order of class, each a state and a one: as `output`; with a gradient also d(-sum)/dh and a row of zeros, and the gradient's C and D are set.

        Each class is one slice of every array.  Rows of exponentials are never divided by their sums, the states are.
        """
        cls, train = y // CLASS, gradient is not None
        cut = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
        spans = [(k, slice(a, b)) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]

        def inside() -> np.ndarray:
            q = np.empty((len(y), CLASS), h.dtype)
            for k, own in spans:
                np.dot(h[own], self.D[k], out=q[own])
            return q

        out, p, p_total = _chosen(lambda: h @ self.C, cls, train)
        more, q, q_total = _chosen(inside, y - cls * CLASS, train)
        out += more
        if not train:
            return out, None
        p_part, q_part = (1 / p_total)[:, None], (1 / q_total)[:, None]
        np.matmul((h * p_part).T, p, out=gradient.C)
        scaled, part, dh = h * q_part, np.empty((len(y), HIDDEN), h.dtype), np.zeros((len(y) + 1, HIDDEN), h.dtype)
        gradient.D[np.diff(cut) == 0] = 0
        for k, own in spans:
            own_q = q[own]
            np.dot(scaled[own].T, own_q, out=gradient.D[k])
            np.dot(own_q, self.D[k, :-1].T, out=part[own])
        part *= q_part
        np.matmul(p, self.C[:-1].T, out=dh[:-1])
        dh[:-1] *= p_part
        dh[:-1] += part
        return out, dh

    def forward(self, x: np.ndarray, live: np.ndarray, h: np.ndarray, train: bool = True):
        """A window (time, document) of steps from states h (unit, document).

        Arrays are (time, unit, document), so that each gate is one block of memory: the candidates' recurrent parts, both
        gates as 1 + exp(-x), and the candidates' inputs; candidates; the part kept of the states less candidates; and before
        each word and after the last the state, a one, and the embedding read next.  Without training the first three are
        one step's memory, taken again by the next.
        """
        kind, two, many, kept = self.flat.dtype, 2 * HIDDEN, x.shape[1], len(x) if train else 1
        line = np.empty((len(x) + 1, 2 * HIDDEN + 1, many), kind)
        line[0, :HIDDEN], line[:, HIDDEN] = h, 1
        line[:-1, HIDDEN + 1 :] = np.take(self.E, x, axis=0).transpose(0, 2, 1)
        gates, into = np.zeros((4 * HIDDEN, 2 * HIDDEN + 1), kind), np.concatenate([self.b[None], self.W]).T
        gates[:HIDDEN, :HIDDEN] = self.V[:, two:].T
        gates[HIDDEN : 3 * HIDDEN, :HIDDEN], gates[HIDDEN : 3 * HIDDEN, HIDDEN:] = -self.V[:, :two].T, -into[:two]
        gates[3 * HIDDEN :, HIDDEN:] = into[two:]
        a, n, parts, old = *(np.empty((kept, k * HIDDEN, many), kind) for k in (4, 1, 1)), line[0, :HIDDEN]
        every = [(a_t, a_t[:HIDDEN], a_t[HIDDEN : 3 * HIDDEN], a_t[HIDDEN:two], a_t[two : 3 * HIDDEN], a_t[3 * HIDDEN :], n_t, part) for a_t, n_t, part in zip(a, n, parts)]
        with np.errstate(over="ignore"):  # what is divided by infinity is rightly zero
            for read, new, (a_t, u, both, z, r, c, n_t, part), on, whole in zip(line, line[1:, :HIDDEN], every if train else repeat(every[0]), live, live.all(axis=1).tolist()):
                np.matmul(gates, read, out=a_t)
                np.exp(both, out=both)
                both += 1
                np.divide(u, r, out=n_t)
                n_t += c
                np.tanh(n_t, out=n_t)
                np.subtract(old, n_t, out=part)
                part /= z
                np.add(part, n_t, out=new)
                if not whole:
                    np.copyto(new, old, where=~on)
                old = new
        return a, n, parts, line

    def window(self, x: np.ndarray, y: np.ndarray, live: np.ndarray, h: np.ndarray):
        """One window (time, document) of training: loss, gradient, last state; backpropagation ends at its start.

        The gradient's memory is the model's own and taken again by the next window.
        """
        if self.gradient is None:
            self.gradient = Model(np.empty_like(self.flat))
        gradient, two, three, many = self.gradient, 2 * HIDDEN, 3 * HIDDEN, x.shape[1]
        a, n, part, line = self.forward(x, live, h.T)
        at, y = np.flatnonzero(live), y.ravel()
        at = at[by_class(y[at])]
        got, dh = self.words(np.take(rows(line), at, axis=0), y[at], gradient)
        place = np.full(live.size, len(at))
        place[at] = np.arange(len(at))
        d_states = np.ascontiguousarray(np.take(dh, place, axis=0).reshape(*live.shape, HIDDEN).transpose(0, 2, 1))
        # by what d is multiplied for d(candidate's recurrent part), d(update), d(reset) and the state before
        u, by_z, by_r, z = (a[:, k : k + HIDDEN] for k in range(0, 4 * HIDDEN, HIDDEN))
        np.reciprocal(by_z, out=z)
        r, rest, by_n = np.reciprocal(by_r), 1 - z, n * n
        np.subtract(1, by_n, out=by_n)
        by_n *= rest
        np.multiply(part, rest, out=by_z)
        np.subtract(1, r, out=by_r)
        by_r *= u
        np.multiply(by_n, r, out=u)
        by_r *= u
        if len(at) < live.size:
            on = live[:, None]
            a[:, :three] *= on
            by_n *= on
            np.copyto(z, 1, where=~on)
        V, back = np.concatenate([self.V[:, two:], self.V[:, :two], np.eye(HIDDEN, dtype=a.dtype)], axis=1), None
        for d, du, by_gate in zip(d_states[::-1], a[::-1], a.reshape(len(x), 4, HIDDEN, many)[::-1]):
            if back is not None:
                d += back
            by_gate *= d
            back = V @ du
        np.multiply(d_states, by_n, out=z)  # of the candidate's whole input, after that of its recurrent part
        da = a.transpose(0, 2, 1)
        g = (line[:-1] @ da).sum(axis=0)
        gradient.V[:, :two], gradient.V[:, two:] = g[:HIDDEN, HIDDEN:three], g[:HIDDEN, :HIDDEN]
        gradient.b[...], gradient.W[...] = g[HIDDEN, HIDDEN:], g[HIDDEN + 1 :, HIDDEN:]
        gradient.E.fill(0)
        _add_rows(gradient.E, x, da[:, :, HIDDEN:] @ self.W.T)
        return -float(got.sum()), len(at), gradient, line[-1, :HIDDEN].T


def by_class(y: np.ndarray) -> np.ndarray:
    return np.argsort((y // CLASS).astype(np.uint8), kind="stable")


def rows(line: np.ndarray) -> np.ndarray:
    """The states after each word, and a one, as a row for each time and document."""
    return line[1:, : HIDDEN + 1].transpose(0, 2, 1).reshape(-1, HIDDEN + 1)


def _chosen(make, chosen: np.ndarray, train: bool):
    """Of rows of logits: log-probability of the chosen column of each; d(-log)/d(logits) times the sums of exponentials, for training only; these sums."""

    def exponentials():
        got = flat[at]
        np.exp(logits, out=logits)
        return got, logits @ np.ones(logits.shape[1], logits.dtype)

    logits = make()
    flat, at = logits.reshape(-1), np.arange(0, logits.size, logits.shape[1]) + chosen
    with np.errstate(over="ignore", under="ignore"):
        got, total = exponentials()
    if len(total) and not 1e-30 < total.min() <= total.max() < 1e30:  # beyond the range of exponentials
        logits[...] = make()
        logits -= logits.max(axis=1, keepdims=True)
        got, total = exponentials()
    if train:
        flat[at] -= total
    got -= np.log(total)
    return got, logits, total


def _add_rows(table: np.ndarray, ids: np.ndarray, values: np.ndarray) -> None:
    """Adds each row of values to the table's row of its id; numbers go in pairs, as complex ones."""
    kind = np.complex64 if table.dtype == np.float32 else np.complex128
    np.add.at(table.reshape(-1).view(kind), (ids.reshape(-1, 1) * (HIDDEN // 2) + np.arange(HIDDEN // 2)).ravel(), values.reshape(-1).view(kind))


class Adam:
    def __init__(self, size: int, rate: float):
        self.rate, self.n, self.most = rate, 0, 1
        self.m, self.v, self.held = np.zeros(size, np.float32), np.zeros(size, np.float32), np.empty(PIECE, np.float32)

    def step(self, model: Model, gradient: np.ndarray, words: int) -> None:
        """One step down the gradient of so many words' loss, in pieces that stay in a core's cache; the gradient's memory is used up.

        Its length goes by the words, as the last windows of the longest texts have few and would else undo what the full ones taught.
        """
        self.n += 1
        self.most = max(self.most, words)
        scale = 0.1 / max(words, float(np.linalg.norm(gradient)))  # the mean's norm is at most 1
        c = math.sqrt(1 - 0.99**self.n)
        for k in range(0, len(gradient), PIECE):
            g, m, v, w = (x[k : k + PIECE] for x in (gradient, self.m, self.v, model.flat))
            held = self.held[: len(g)]
            g *= scale
            m *= 0.9
            m += g
            g *= g
            v *= 0.99
            v += g
            np.sqrt(v, out=held)
            held += 1e-6 * c
            np.divide(m, held, out=held)
            held *= self.rate * words / self.most * c / (1 - 0.9**self.n)
            w -= held


def windows(parts, end: int, together: int, length: int = WINDOW):
    """All windows of so many words of all texts of parts (ids, first): (texts, places kept, words before, words, live), arrays (time, place).

    A text that ends leaves its place to one that waits, the longest of a part first, so windows are full until the texts
    run out.  The texts of the places kept go on, in their order; those after them start.  Texts are numbered over all parts.
    """
    parts, more, none, step = iter(parts), True, np.zeros(0, np.int64), np.arange(length)[:, None]
    ids, left, at, last, text = none, none, none, none, none
    n, first, number, seen = none, none, none, 0  # of the texts that wait
    while True:
        kept = np.flatnonzero(left >= 0)
        left, at, last, text = left[kept], at[kept], last[kept], text[kept]
        while more and len(left) + len(n) < together:
            part = next(parts, None)
            more = part is not None
            if more:  # what is left of the texts under way goes before it
                held = [ids[a : a + k] for a, k in zip([*at.tolist(), *first.tolist()], [*left.tolist(), *n.tolist()])]
                start = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int64)
                size = np.diff(part[1])
                order = np.argsort(-size, kind="stable")
                ids = np.concatenate([*held, part[0], [end]])
                at, first = start[: len(at)], np.concatenate([start[len(at) : -1], start[-1] + part[1][:-1][order]])
                n, number, seen = np.concatenate([n, size[order]]), np.concatenate([number, seen + order]), seen + len(size)
        new = together - len(left)
        left, at, text = np.concatenate([left, n[:new]]), np.concatenate([at, first[:new]]), np.concatenate([text, number[:new]])
        if not len(left):
            return
        last = np.concatenate([last, np.full(len(left) - len(last), VOCABULARY)])
        n, first, number = n[new:], first[new:], number[new:]
        room = left - step
        y = np.where(room > 0, ids[np.minimum(at + step, len(ids) - 1)], end)
        yield text, kept, np.concatenate([last[None], y[:-1]]), y, room >= 0
        left, at, last = left - length, at + length, y[-1]


def carried(h: np.ndarray, kept: np.ndarray, places: int) -> np.ndarray:
    """States (place, unit) for the next window: those kept, and zeros for texts that start."""
    out = np.zeros((places, HIDDEN), np.float32)
    out[: len(kept)] = h[kept]
    return out


def train_parts(model: Model, adam: Adam, parts, end: int) -> int:
    """Trains on every window of each text and gives the number of words seen, ends included."""
    h, seen = np.zeros((0, HIDDEN), np.float32), 0
    for _, kept, x, y, live in windows(parts, end, BATCH):
        _, words, gradient, h = model.window(x, y, live, carried(h, kept, x.shape[1]))
        adam.step(model, gradient.flat, words)
        seen += words
    return seen


def train_texts(model: Model, adam: Adam, ids: np.ndarray, first: np.ndarray, end: int) -> int:
    return train_parts(model, adam, [(ids, first)], end)


def _coder(shared, bits: int):
    """For each chunk: its documents with the ids of their words and their words of no own id (bucket -1), and these words by ranges."""

    def run(batches):
        settle()
        voc, at = shared.value, TaskContext.get().partitionId() << 24
        for batch in batches:
            for piece in chunks(batch, 1, 12 << 20):
                w = Words(piece.column(1))
                own = voc.encode(w.hashes)
                rest = np.flatnonzero(voc.shared[own])
                words, which = np.unique(w.hashes[rest], return_inverse=True)
                doc = np.repeat(np.arange(piece.num_rows), np.diff(w.first))[rest]
                pair, n = np.unique(doc * max(len(words), 1) + which, return_counts=True)
                doc, which = pair // max(len(words), 1), pair % max(len(words), 1)
                ids = piece.column(0)
                rows = [{"chunk": at, "bucket": -1, "words": doc.astype(np.uint32).tobytes(), "values": which.astype(np.uint32).tobytes(), "n": n.astype(np.uint32).tobytes(), "ids": ids.fill_null(0).to_numpy().tobytes(), "missing": ids.is_null().to_numpy(zero_copy_only=False).tobytes(), "size": np.diff(w.first).tobytes(), "own": own.astype(np.uint16).tobytes()}]
                cut = np.searchsorted(words >> U(64 - bits), np.arange((1 << bits) + 1, dtype=U))
                rows += [{"chunk": at, "bucket": b, "words": words[x:y].tobytes()} for b, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if y > x]
                yield pa.RecordBatch.from_pylist(rows, CODED_ARROW)
                at += 1

    return run


def encoded(own: DataFrame, voc: Vocabulary, bits: int) -> DataFrame:
    """The texts as ids, read by every round and by the scoring, so that texts are cut in words and looked up once."""
    spark = own.sparkSession
    return Scratch(spark).table(own.select("_id", "_text").mapInArrow(_coder(Shared(spark, voc), bits), CODED), "coded", records=10_000)


def _ids(batch: pa.RecordBatch):
    """(ids, first) of each chunk."""
    for own, size in zip(batch["own"], batch["size"]):
        yield np.frombuffer(own.as_buffer(), np.uint16).astype(np.int64), np.concatenate([[0], np.cumsum(np.frombuffer(size.as_buffer(), np.int64))])


def _trainer(shared, round_: int, salts: int):
    def run(batches):
        settle()
        salt = TaskContext.get().partitionId() % salts
        flat, end = shared.value
        model = Model(flat.copy())
        seen = train_parts(model, Adam(len(flat), 0.01 / (1 + round_)), (part for batch in batches for part in _ids(batch)), end)
        if seen:
            blocks = range(0, len(flat), BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), pa.array([seen] * len(blocks), pa.int64()), pa.array([model.flat[b : b + BLOCK].tobytes() for b in blocks], pa.binary()), pa.array([salt] * len(blocks), pa.int64())], names=["block", "n", "w", "salt"])

    return run


def _average(table: pa.Table) -> pa.Table:
    n = np.array(table["n"], np.float64)
    w = sum(np.frombuffer(b, np.float32).astype(np.float64) * k for b, k in zip(table["w"].to_pylist(), n / n.sum()))
    return pa.table({"block": [table["block"][0].as_py()], "n": [int(n.sum())], "w": pa.array([w.astype(np.float32).tobytes()], pa.binary())})


def train(own: DataFrame, voc: Vocabulary, rounds: int = ROUNDS, coded: DataFrame | None = None) -> Model:
    """Partitions' weights are averaged in two steps, so that no task gets more than the square root of their number."""
    flat, kind = Model.start(voc).flat, "block long, n long, w binary"
    coded = (encoded(own, voc, 2) if coded is None else coded).filter("bucket = -1").select("own", "size")
    salts = max(1, math.isqrt(coded.rdd.getNumPartitions()))
    for round_ in range(rounds):
        shared = Shared(own.sparkSession, (flat, voc.end))
        trained = coded.mapInArrow(_trainer(shared, round_, salts), f"{kind}, salt long")
        blocks = trained.groupBy("block", "salt").applyInArrow(_average, kind).groupBy("block").applyInArrow(_average, kind).collect()
        flat = flat.copy()
        for r in blocks:
            flat[r.block : r.block + BLOCK] = np.frombuffer(r.w, np.float32)
    return Model(flat)


def log_likelihoods(model: Model, voc: Vocabulary, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log-probability of the ids of each whole text and its end, the state carried to the end."""
    h, out = np.zeros((0, HIDDEN), np.float32), np.zeros(len(first) - 1)
    for text, kept, x, y, live in windows([(ids, first)], voc.end, TOGETHER, LENGTH):
        line, y = model.forward(x, live, carried(h, kept, len(text)).T, train=False)[-1], y.ravel()
        h, at = line[-1, :HIDDEN].T, np.flatnonzero(live)
        at = at[by_class(y[at])]
        got = model.words(np.take(rows(line), at, axis=0), y[at])[0]
        out[text] += np.bincount(at % len(text), got, len(text))
    return out


def _scorer(shared):
    """For each chunk: the log-likelihoods of its documents' ids (bucket -2)."""

    def run(batches):
        settle()
        flat, voc = shared.value
        model = Model(flat)
        for batch in batches:
            for chunk, (ids, first) in zip(batch["chunk"].to_pylist(), _ids(batch)):
                yield pa.RecordBatch.from_pylist([{"chunk": chunk, "bucket": -2, "score": log_likelihoods(model, voc, ids, first).tobytes()}], CODED_ARROW)

    return run


def _answers(shared):
    """Of a range of words: the log shares of the words that chunks ask for, in their order."""

    def run(asked: pa.Table, counted: pa.Table) -> pa.Table:
        voc = shared.value[1]
        words, n = counted["word"].to_numpy().astype(U), counted["n"].to_numpy()
        order = np.argsort(words)
        words, n, out = words[order], n[order], []
        for chunk, bucket, blob in zip(asked["chunk"].to_pylist(), asked["bucket"].to_pylist(), asked["words"].to_pylist()):
            own = np.frombuffer(blob, U)
            out.append({"chunk": chunk, "bucket": bucket, "values": voc.shares(own, n[np.searchsorted(words, own)]).astype(np.float32).tobytes()})
        return pa.Table.from_pylist(out, CODED_ARROW)

    return run


def _finish(table: pa.Table) -> pa.Table:
    """Of one chunk: the documents' scores with the shares of their other words."""
    table = table.sort_by("bucket")
    head, shares = table.slice(1, 1).to_pylist()[0], gather(table.slice(2)["values"].to_pylist(), np.float32)
    doc, which, n = (np.frombuffer(head[c], np.uint32) for c in ("words", "values", "n"))
    size, score = np.frombuffer(head["size"], np.int64), np.frombuffer(table["score"][0].as_py(), np.float64)
    if len(doc):
        score = score + np.bincount(doc, shares[which].astype(np.float64) * n, len(score))
    return pa.table({"doc_id": pa.array(np.frombuffer(head["ids"], np.int64), mask=np.frombuffer(head["missing"], bool)), "n_words": size, "log_likelihood": score, "perplexity": np.exp(-score / (size + 1))})


def scores(docs: DataFrame, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, log_likelihood, perplexity) of every document, its end included.

    A null or empty text is scored as a text that ends at once.  A null doc_id stays
    null; each of repeated rows counts and is scored.  Other columns are ignored; an
    empty table gives no rows.
    """
    own, scratch = texts(docs, id_col, text_col), Scratch(docs.sparkSession)
    voc, counted, bits = vocabulary(own)
    coded = encoded(own, voc, bits)
    shared = Shared(docs.sparkSession, (train(own, voc, rounds, coded).flat, voc))
    heads = coded.filter("bucket = -1")
    scored = scratch.table(heads.select("chunk", "own", "size").mapInArrow(_scorer(shared), CODED), "scored")
    ranges = counted.withColumn("bucket", F.shiftrightunsigned("word", 64 - bits))
    answers = coded.filter("bucket >= 0").groupBy("bucket").cogroup(ranges.groupBy("bucket")).applyInArrow(_answers(shared), CODED)
    every = heads.withColumn("own", F.lit(None).cast("binary")).unionByName(scored).unionByName(answers)
    return every.groupBy("chunk").applyInArrow(_finish, "doc_id long, n_words long, log_likelihood double, perplexity double")
