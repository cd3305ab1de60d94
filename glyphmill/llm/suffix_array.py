"""Suffix-array dedup by distributed prefix doubling over words.

Ranks begin as those of the first 8 words of every suffix.  A round hands each
suffix the rank of the suffix `step` words on, Spark groups the rank pairs by
ranges of the first rank, each range is sorted and reranked, and suffixes that
became unique leave.  Steps double (8, 16, ...) until the compared prefix has
`threshold` words; the last step overlaps so that it ends exactly there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..scratch import Scratch
from .blobs import STREAM, at_home, bucket_bits, by_bucket, gather, positions, repeated, runs, split, texts

START = 8


def _pairs(step: int, last: bool):
    """At a chunk: rank pairs (i, i + step); a suffix whose partner is unique is unique itself and leaves."""

    def run(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        pos, name, docs = at_home(table)
        partner = np.searchsorted(pos, pos + step)
        found = (partner < len(pos)) & (pos[np.minimum(partner, len(pos) - 1)] == pos + step) if len(pos) else np.zeros(0, bool)
        if step == 0:
            found[:] = True
        values = {"pos": pos[found].astype(np.uint32), "b": name[partner[found]]}
        if last:  # the pair and what tells which occurrence is the first
            first, ids = np.array(docs["first"], np.int64), docs["doc_id"].fill_null(np.iinfo(np.int64).max).to_numpy()
            doc = np.searchsorted(first + np.array(docs["n_words"], np.int64), pos[found], "right")
            values["b"] = np.rec.fromarrays([name[partner[found]], ids[doc], pos[found] - first[doc]], names="b,id,at")
        return by_bucket(chunk, name[found], **values)

    return run


def _rerank(last: bool):
    """In a range of ranks: sort the pairs; equal ones share the rank of the first."""

    def run(table: pa.Table) -> pa.Table:
        pos = table["pos"].to_pylist()
        sizes = np.array([len(p) // 4 for p in pos])
        a = gather(table["a"].to_pylist(), np.uint32)
        if last:
            whole = gather(table["b"].to_pylist(), np.dtype([("b", np.int64), ("id", np.int64), ("at", np.int64)]))
            b, more = whole["b"], (whole["at"], whole["id"])
        else:
            b, more = gather(table["b"].to_pylist(), np.int64), ()
        order = np.lexsort((*more, b, a))
        first, count = runs(a[order], b[order])
        rank, keep, later = np.empty(len(a), np.uint32), np.empty(len(a), bool), np.ones(len(a), np.uint8)
        rank[order] = np.repeat(first, count)
        keep[order] = np.repeat(count > 1, count)
        later[order[first]] = 0
        return split(table, keep, sizes, pos=gather(pos, np.uint32), a=rank, **({"b": later} if last else {}))

    return run


def _spans(threshold: int):
    """At a chunk: runs of positions whose window of `threshold` words repeats, as spans of words of a text."""

    def run(table: pa.Table) -> pa.Table:
        own = table.filter(pa.array(np.array(table["bucket"]) >= 0))
        pos, later = gather(own["pos"].to_pylist(), np.uint32).astype(np.int64), gather(own["b"].to_pylist(), np.uint8)
        order = np.argsort(pos)
        pos, later = pos[order], later[order]
        docs = table.filter(pa.array(np.array(table["bucket"]) < 0)).sort_by("first")
        first, n = np.array(docs["first"], np.int64), np.array(docs["n_words"], np.int64)
        head, count = runs(pos - np.arange(len(pos)))
        doc = np.searchsorted(first + n, pos[head], "right")
        return pa.table(
            {
                "doc_id": docs["doc_id"].take(pa.array(doc)),
                "start_word": pa.array(pos[head] - first[doc]),
                "n_words": pa.array(count + threshold - 1),
                "n_later": pa.array(np.add.reduceat(later.astype(np.int64), head) if len(head) else np.zeros(0, np.int64)),
            }
        )

    return run


def repeated_spans(docs: DataFrame, threshold: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of words covered by windows of `threshold` words that occur more than once in the corpus.

    Returns (doc_id, start_word, n_words, n_later): a longest span in which every
    window repeats, here or in another text, and how many of its windows are not
    the first occurrence, which is the one of the lowest (doc_id, position).

    A null, empty or shorter text has no spans.  A null doc_id stays null and
    ranks after all others.  Repeated rows are texts of their own and repeat each
    other.  Other columns are ignored; an empty table gives an empty result.
    """
    spark, own = docs.sparkSession, texts(docs, id_col, text_col)
    if threshold < 1:
        raise ValueError("threshold must be at least 1")
    scratch, bits, reach = Scratch(spark), bucket_bits(own), min(START, threshold)
    state = scratch.table(positions(own, reach, threshold, bits).groupBy("bucket").applyInArrow(repeated, STREAM), "round0")
    listing, number, done = state.filter("bucket < 0"), 0, False
    while not done:
        step = min(reach, threshold - reach)
        done, number = reach + step == threshold, number + 1
        own = state if number == 1 or not done else state.unionByName(listing)
        pairs = own.groupBy("chunk").applyInArrow(_pairs(step, done), STREAM)
        state = scratch.table(pairs.groupBy("bucket").applyInArrow(_rerank(done), STREAM), f"round{number}")
        if number > 1:
            scratch.drop(f"round{number - 1}")
        reach += step
    return state.unionByName(listing).groupBy("chunk").applyInArrow(_spans(threshold), "doc_id long, start_word long, n_words long, n_later long")
