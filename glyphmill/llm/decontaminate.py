"""Benchmark decontamination: SimHash windows, a multi-index of fingerprints, exact verification.

A window has as many words as the item it is held against (a shorter document is one
window).  Its 64-bit SimHash sums the shingles' hashes, weighted by their letters.  The
items' fingerprints are indexed by 8 blocks of 8 bits: of two fingerprints within 31 bits
at least one block differs by 3 bits or fewer, so looking up all such values of each block
finds every item within the radius.  Found pairs count if their exact weighted Jaccard
similarity reaches the threshold.  Windows whose shingles that occur in any item don't
weigh enough for that are never fingerprinted; the exact test would reject them.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Shared
from .quality import FOLD, LETTERS
from .words import U, Words, chunks, mix

SHINGLE = 3
RADIUS = 26
BLOCKS, NEAR = 8, RADIUS // 8
SLICE_BYTES = 16 << 20
_NEAR_VALUES = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :]) <= NEAR


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash and weight (letters) of the shingle at each word; the last two of a text have weight 0."""
    n = len(w.hashes)
    h, weight = np.zeros(n, U), np.zeros(n, np.int64)
    starts, value = w.windows(SHINGLE)
    letters = np.concatenate([[0], np.cumsum(w.ends - w.starts)])
    h[starts], weight[starts] = value, letters[starts + SHINGLE] - letters[starts]
    return h, weight


def fingerprints(h: np.ndarray, weight: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """SimHash of shingles[start:end] for each window."""
    if not len(start):
        return np.zeros(0, U)
    bits = np.unpackbits(mix(h).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64) * 2 - 1
    total = np.zeros((len(h) + 1, 64), np.int64)
    np.cumsum(bits * weight[:, None], axis=0, out=total[1:])
    return np.packbits(total[end] - total[start] > 0, axis=1).view(U).ravel()


class Index:
    """Fingerprints, shingles and weights of the items, by their number of words."""

    def __init__(self, items: list[tuple[int, str]], threshold: float):
        self.threshold, self.sizes = threshold, {}
        w = Words(pa.array([t for _, t in items], pa.string()), FOLD, LETTERS)
        h, weight = shingles(w)
        n = np.diff(w.first)
        known = []
        for k in np.flatnonzero(n >= SHINGLE).tolist():
            a, b = int(w.first[k]), int(w.first[k + 1]) - SHINGLE + 1
            bag = Counter(h[a:b].tolist())
            weights = dict(zip(h[a:b].tolist(), weight[a:b].tolist()))
            entry = self.sizes.setdefault(int(n[k]), {"ids": [], "bags": [], "totals": [], "prints": []})
            entry["ids"].append(items[k][0])
            entry["bags"].append({s: (c, weights[s]) for s, c in bag.items()})
            entry["totals"].append(int(weight[a:b].sum()))
            entry["prints"].append(fingerprints(h[a:b], weight[a:b], np.array([0]), np.array([b - a]))[0])
            known.append(h[a:b])
        self.known = np.unique(np.concatenate(known)) if known else np.zeros(0, U)
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[(self.known >> U(44)).astype(np.int64)] = True
        for entry in self.sizes.values():
            prints = np.array(entry["prints"], U)
            entry["prints"] = prints
            blocks = prints.view(np.uint8).reshape(-1, BLOCKS)
            entry["table"] = [_NEAR_VALUES[:, blocks[:, b]] for b in range(BLOCKS)]

    def matches(self, w: Words):
        """(text, item id, first word, words, similarity) of every window that reaches the threshold."""
        if not len(self.known) or not len(w.hashes):
            return
        h, weight = shingles(w)
        maybe = np.flatnonzero((weight > 0) & self.bitmap[(h >> U(44)).astype(np.int64)])
        at = np.searchsorted(self.known, h[maybe])
        hit = maybe[self.known[np.minimum(at, len(self.known) - 1)] == h[maybe]]
        if not len(hit):
            return
        gain = np.zeros(len(h) + 1, np.int64)
        gain[1:][hit] = weight[hit]
        gain, total = np.cumsum(gain), np.concatenate([[0], np.cumsum(weight)])
        doc_end = np.repeat(w.first[1:], np.diff(w.first))
        doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
        longest = max(self.sizes)
        least = self.threshold * min(min(e["totals"]) for e in self.sizes.values())
        every = np.arange(len(h))
        near = np.flatnonzero(gain[np.minimum(every + longest, doc_end)] - gain[every] >= least)
        for size, entry in self.sizes.items():
            end = np.minimum(near + size, doc_end[near])
            whole = (near + size <= doc_end[near]) | (w.first[doc[near]] == near)
            s, e = near[whole], np.maximum(near, end - SHINGLE + 1)[whole]
            enough = gain[e] - gain[s] >= self.threshold * min(entry["totals"])
            s, e = s[enough], e[enough]
            for part in range(0, len(s), 4096):
                yield from self._verify(h, weight, total, s[part : part + 4096], e[part : part + 4096], entry, doc)

    def _verify(self, h, weight, total, s, e, entry, doc):
        length = e - s
        flat = np.unique(np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length) + np.repeat(s, length))
        local = np.searchsorted(flat, s)
        prints = fingerprints(h[flat], weight[flat], local, local + length)
        blocks = prints.view(np.uint8).reshape(-1, BLOCKS)
        found = entry["table"][0][blocks[:, 0]]
        for b in range(1, BLOCKS):
            found = found | entry["table"][b][blocks[:, b]]
        window, item = np.nonzero(found)
        close = np.bitwise_count(prints[window] ^ entry["prints"][item]) <= RADIUS
        for k, i in zip(window[close].tolist(), item[close].tolist()):
            a, b = int(s[k]), int(e[k])
            bag, mine, shared = entry["bags"][i], Counter(), 0
            for x in h[a:b].tolist():
                if x in bag:
                    mine[x] += 1
                    if mine[x] <= bag[x][0]:
                        shared += bag[x][1]
            value = shared / (int(total[b] - total[a]) + entry["totals"][i] - shared)
            if value >= self.threshold:
                yield int(doc[a]), entry["ids"][i], a, b - a + SHINGLE - 1, value


def _slices(benchmark: DataFrame, id_col: str, text_col: str):
    """The items, some megabytes at a time; a benchmark of any usual size is one slice."""
    items = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("text is not null").distinct()
    n = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-n // SLICE_BYTES)
    for k in range(parts):
        yield [(r.id, r.text) for r in items.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == k).collect()]


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """The best window of each document for each benchmark item that it contains, near copies included.

    Returns (doc_id, item_id, start_word, n_words, similarity); ties go to the earliest
    window.  Words are runs of letters and digits without regard to ASCII case.

    Null, empty and wordless texts match nothing, nor do items of fewer than 3 words.  A null doc_id or item_id
    stays null.  Each of repeated rows of documents matches by itself; repeated items count once.
    Other columns are ignored; an empty table on either side gives an empty result.
    """
    spark, own, found = docs.sparkSession, docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col("text").cast("string").alias("_text")), None
    schema = "doc_id long, item_id long, start_word long, n_words long, similarity double"
    for items in _slices(benchmark, item_col, "text"):
        part = own.mapInArrow(_matcher(Shared(spark, Index(items, threshold))), schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], schema)


def _matcher(index):
    def run(batches):
        for batch in batches:
            for piece in chunks(batch, 1):
                w, best = Words(piece.column(1), FOLD, LETTERS), {}
                for doc, item, start, n, value in index.value.matches(w):
                    have = best.get((doc, item))
                    if have is None or (-value, start) < (-have[2], have[0]):
                        best[doc, item] = (start, n, value)
                if best:
                    keys = sorted(best, key=lambda k: (k[0], k[1] is None, k[1] or 0))
                    doc = np.array([k[0] for k in keys])
                    yield pa.RecordBatch.from_arrays(
                        [
                            piece.column(0).take(pa.array(doc)), pa.array([k[1] for k in keys], pa.int64()), pa.array(np.array([best[k][0] for k in keys]) - w.first[doc]),
                            pa.array([best[k][1] for k in keys], pa.int64()), pa.array([best[k][2] for k in keys], pa.float64()),
                        ],
                        names=["doc_id", "item_id", "start_word", "n_words", "similarity"],
                    )

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents, with their columns, that match no benchmark item; cases as in matches, so texts without words stay."""
    kept, at = docs, docs.columns.index("text")

    def dropper(index):
        def run(batches):
            for batch in batches:
                for piece in chunks(batch, at):
                    keep = np.ones(piece.num_rows, bool)
                    keep[[m[0] for m in index.value.matches(Words(piece.column(at), FOLD, LETTERS))]] = False
                    yield piece.filter(pa.array(keep))

        return run

    for items in _slices(benchmark, "item_id", "text"):
        kept = kept.mapInArrow(dropper(Shared(docs.sparkSession, Index(items, threshold))), docs.schema)
    return kept
