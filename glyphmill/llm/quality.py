"""Quality and toxicity classifier: a factorisation machine over hashed words and word beginnings, structure statistics and metadata.

score(x) = b + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2), which is
linear in the features that a text has.  One machine is fitted for low quality and
one for toxicity, in one task, on at most `max_labelled` labelled documents, over the
features that a chi-squared test ties to its label; all documents are scored where
they lie, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Shared
from .words import U, Words, chunks, mix

BITS = 17
SIZE = 1 << BITS
FACTORS = 4
EPOCHS = 20  # passes over the labelled documents, whatever their number
BEGINNINGS = (4, 6)
TIED = 25.0
LETTERS = np.zeros(256, bool)
LETTERS[: 0x80] = [not chr(c).isalnum() for c in range(0x80)]
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def _table(members) -> np.ndarray:
    out = np.zeros(256, np.int32)
    out[list(members)] = 1
    return out


CLASSES = [_table(range(65, 91)), _table(range(97, 123)), _table(range(48, 58)), _table(b"#$%&*@^~+=<>"), _table(b"!?"), _table(b"|"), _table(b".,;:"), _table(b"\n"), _table(range(128, 256))]
EDGES = np.array([0.001, 0.003, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.25, 0.4, 0.6, 0.8])


def _beginnings(w: Words, doc: np.ndarray, mask: np.ndarray | None) -> list[np.ndarray]:
    """Keys of the first bytes of words that go on after them."""
    out, own, length = [], np.arange(len(w.starts)), w.ends - w.starts
    h, done = np.zeros(len(own), U), 0
    for n in BEGINNINGS:
        longer = length[own] > n
        own, h = own[longer], h[longer]
        for j in range(done, n):
            h = h * U(0x100000001B3) + FOLD[w.data[w.starts[own] + j]].astype(U)
        done = n
        number = (mix(h + U(n << 48)) >> U(64 - BITS)).astype(np.int64)
        known = slice(None) if mask is None else mask[number]
        out.append((doc[own[known]] << BITS) | number[known])
    return out


def features(piece: pa.RecordBatch, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, feature number) once each, and the words of each text; columns _id, _text, _lang, _source."""
    w = Words(piece.column(1), FOLD, LETTERS)
    counts = np.diff(w.first)
    doc = np.repeat(np.arange(len(counts)), counts)
    word = (w.hashes >> U(64 - BITS)).astype(np.int64)
    key = (doc << BITS) | word
    if mask is not None:
        key = key[mask[word]]
    key = np.unique(np.concatenate([key, *_beginnings(w, doc, mask)]))
    size = np.maximum(np.diff(w.at), 1)
    stats = []
    for table in CLASSES:
        total = np.concatenate([[0], np.cumsum(table[w.data], dtype=np.int64)])
        stats.append((total[w.at[1:]] - total[w.at[:-1]]) / size)
    alike = np.zeros(len(w.hashes), bool)
    for lag in (1, 2, 3):
        alike[lag:] |= (w.hashes[lag:] == w.hashes[:-lag]) & (doc[lag:] == doc[:-lag])
    stats.append(np.bincount(doc[alike], minlength=len(counts)) / np.maximum(counts, 1))
    binned = [np.searchsorted(EDGES, s) for s in stats]
    binned.append(np.log2(np.maximum(counts, 1)).astype(np.int64))
    binned.append(np.minimum(size / np.maximum(counts, 1), 40).astype(np.int64))
    extra = [mix((np.full(len(counts), k + 1, np.int64) << 32 | b).astype(U)) for k, b in enumerate(binned)]
    for column in (2, 3):
        names = Words(piece.column(column).cast(pa.string()), separator=np.zeros(256, bool))
        value = np.zeros(len(counts), U)
        value[np.diff(names.first) > 0] = names.hashes
        extra.append(mix(value + U(column)))
    other = np.unique(((np.tile(np.arange(len(counts)), len(extra)) << BITS) | (np.concatenate(extra) >> U(64 - BITS)).astype(np.int64)))
    key = np.union1d(key, other)
    return key >> BITS, key & (SIZE - 1), counts


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray

    def score(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        total = self.bias + np.bincount(doc, self.w[feature], n)
        square = np.bincount(doc, (self.v**2).sum(axis=1)[feature], n)
        for f in range(self.v.shape[1]):
            square -= np.bincount(doc, self.v[:, f][feature], n) ** 2
        return total - 0.5 * square

    def probability(self, doc, feature, n) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.score(doc, feature, n), -30, 30)))


def tied(flat: np.ndarray, positive: np.ndarray, n: int, n_positive: float) -> np.ndarray:
    """Features in at least 3 texts whose chi-squared with the label exceeds TIED; `positive` tells of each entry whether its text is."""
    df, a = np.bincount(flat, minlength=SIZE).astype(float), np.bincount(flat, positive, SIZE)
    b, c = df - a, n_positive - a
    d = n - n_positive - b
    return (df >= 3) & (n * (a * d - b * c) ** 2 > TIED * df * (c + d) * n_positive * (n - n_positive))


def fit(lists: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, batch: int = 128, rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> Machine:
    """Logistic loss by Adagrad over mini-batches of feature lists; y is 0 or 1.  Without a feature that is tied to the label nothing is told apart."""
    rng = np.random.default_rng(seed)
    size = np.array([len(x) for x in lists], np.int64)
    flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    known = tied(flat, np.repeat(y, size), len(y), float(y.sum()))
    row = np.repeat(np.arange(len(lists)), size)[known[flat]]
    flat, size = flat[known[flat]], np.bincount(row, minlength=len(lists))
    start = np.cumsum(size) - size
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    model = Machine(float(np.log(share / (1 - share))), np.zeros(SIZE), rng.normal(0, 0.01, (SIZE, FACTORS)) * known[:, None])
    if not known.any():
        model.bias, model.v = -30.0, model.v * 0
        return model
    gw, gv, gb = np.full(SIZE, 1e-2), np.full((SIZE, FACTORS), 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at : at + batch]
            n = size[rows]
            take = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[rows], n)
            feature, row = flat[take], np.repeat(np.arange(len(rows)), n)
            sums = np.stack([np.bincount(row, model.v[feature, f], len(rows)) for f in range(FACTORS)], axis=1)
            error = model.probability(row, feature, len(rows)) - y[rows]
            distinct, where = np.unique(feature, return_inverse=True)
            grad = np.bincount(where, error[row], len(distinct)) / len(rows) + decay * model.w[distinct]
            gw[distinct] += grad**2
            model.w[distinct] -= rate * grad / np.sqrt(gw[distinct])
            step = error[row, None] * (sums[row] - model.v[feature])
            for f in range(FACTORS):
                g = np.bincount(where, step[:, f], len(distinct)) / len(rows) + decay * model.v[distinct, f]
                gv[distinct, f] += g**2
                model.v[distinct, f] -= 0.2 * rate * g / np.sqrt(gv[distinct, f])
            g = float(error.mean())
            gb += g * g
            model.bias -= rate * g / gb**0.5
    return model


def _threshold(p: np.ndarray, y: np.ndarray, spare: float = 0.005) -> float:
    """The lowest of a few cuts that takes at most that share of the clean held-out documents, 0.5 if there are few."""
    if (y == 0).sum() < 200 or (y == 1).sum() < 20:
        return 0.5
    cuts = np.arange(2, 19) / 20
    fine = [c for c in cuts if (p[y == 0] >= c).mean() <= spare]
    return float(fine[0]) if fine else 0.9


def _train(table: pa.Table) -> pa.Table:
    lists = [np.frombuffer(b, np.int32).astype(np.int64) for b in table["features"].to_pylist()]
    keys = np.array(table["_id"].fill_null(0), np.int64).astype(U)
    held = (mix(keys) >> U(61)) == 0  # an eighth
    out = {"head": [], "bias": [], "cut": [], "w": [], "v": []}
    for head in ("bad", "toxic"):
        label = table[head].to_numpy(zero_copy_only=False).astype(float)
        have = ~np.isnan(label)
        rows, rest = np.flatnonzero(have & ~held), np.flatnonzero(have & held)
        model = fit([lists[k] for k in rows], label[rows])
        flat = np.concatenate([lists[k] for k in rest]) if len(rest) else np.zeros(0, np.int64)
        p = model.probability(np.repeat(np.arange(len(rest)), [len(lists[k]) for k in rest]), flat, len(rest)) if len(rest) else np.zeros(0)
        for k, v in (("head", head), ("bias", model.bias), ("cut", _threshold(p, label[rest])), ("w", model.w.astype(np.float32).tobytes()), ("v", model.v.astype(np.float32).tobytes())):
            out[k].append(v)
    return pa.table(out)


class Classifier:
    """A fitted pair of machines."""

    def __init__(self, machines: dict[str, Machine], cuts: dict[str, float]):
        self.machines, self.cuts = machines, cuts

    @classmethod
    def train(cls, docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, id_col: str = "doc_id") -> Classifier:
        """Fit on the labelled documents of the lowest hashes of doc_id, at most `max_labelled`."""
        chosen = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(1 - F.col("quality")).cast("double").alias("bad"), F.max("toxic").cast("double").alias("toxic"))
        chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
        own = _own(docs, id_col).join(F.broadcast(chosen), "_id").select("_id", "_text", "_lang", "_source", "bad", "toxic")

        def run(batches):
            for batch in batches:
                for piece in chunks(batch, 1):
                    doc, feature, _ = features(piece)
                    cut = np.searchsorted(doc, np.arange(piece.num_rows + 1))
                    lists = [feature[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:])]
                    yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(4), piece.column(5), pa.array(lists, pa.binary())], names=["_id", "bad", "toxic", "features"])

        listed = own.mapInArrow(run, "_id long, bad double, toxic double, features binary")
        found = listed.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(_train, "head string, bias double, cut double, w binary, v binary").collect()
        machines = {r.head: Machine(r.bias, np.frombuffer(r.w, np.float32).astype(np.float64), np.frombuffer(r.v, np.float32).reshape(SIZE, FACTORS).astype(np.float64)) for r in found}
        none = Machine(-30.0, np.zeros(SIZE), np.zeros((SIZE, FACTORS)))
        return cls({h: machines.get(h, none) for h in ("bad", "toxic")}, {h: next((r.cut for r in found if r.head == h), 0.5) for h in ("bad", "toxic")})

    def scored(self, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """(row, low_quality, toxicity, keep): the documents' columns in a struct, the probabilities and the decision."""
        shared = Shared(docs.sparkSession, self)
        own = _own(docs, id_col).select("_id", "_text", "_lang", "_source", "row")
        kind = own.schema["row"].dataType.simpleString()

        def run(batches):
            model = shared.value
            mask = np.zeros(SIZE, bool)
            for m in model.machines.values():
                mask |= (m.w != 0) | m.v.any(axis=1)
            for batch in batches:
                for piece in chunks(batch, 1):
                    doc, feature, counts = features(piece, mask)
                    bad, toxic = (model.machines[h].probability(doc, feature, piece.num_rows) for h in ("bad", "toxic"))
                    bad[counts == 0] = 1.0
                    keep = (bad < model.cuts["bad"]) & (toxic < model.cuts["toxic"])
                    yield pa.RecordBatch.from_arrays([piece.column(4), pa.array(bad), pa.array(toxic), pa.array(keep)], names=["row", "low_quality", "toxicity", "keep"])

        return own.mapInArrow(run, f"row {kind}, low_quality double, toxicity double, keep boolean")


def _own(docs: DataFrame, id_col: str) -> DataFrame:
    def text(name):
        return F.col(f"`{name}`").cast("string") if name in docs.columns else F.lit(None).cast("string")

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), text("text").alias("_text"), text("lang").alias("_lang"), text("source").alias("_source"), row)


def keep_good(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> DataFrame:
    """The documents that neither machine rejects, with their columns as they came.

    A null text or one without words is rejected.  Null lang, source or doc_id are
    values of their own.  Repeated rows are judged alike and all kept or rejected.
    Labels that are null count for the other machine only; without labels of both
    kinds a machine rejects nothing.  An empty table gives an empty result.
    """
    kept = Classifier.train(docs, labels, max_labelled).scored(docs).filter("keep")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def scores(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> DataFrame:
    """(doc_id, low_quality, toxicity) of the documents that are kept; cases as in keep_good."""
    kept = Classifier.train(docs, labels, max_labelled).scored(docs.select("doc_id", "text", "lang", "source")).filter("keep")
    return kept.select(F.col("row.doc_id").alias("doc_id"), "low_quality", "toxicity")
