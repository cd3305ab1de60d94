"""Substring dedup by prefix-partitioned suffix trees over words.

Suffixes are split by their first `threshold` words; those whose prefix is
unique can't lie under a node that deep and are left out, as are prefixes that
the same word always precedes, as their repeats begin further left.  What follows
a prefix is read only where the tree can branch: between branch points all
suffixes of a node go on alike, so a suffix is the list of the edges it takes.
Prefixes whose first occurrences lie in one place form a group, which gets the
edges of each run of repeated words once for all suffixes in it; a prefix with
very many suffixes is a group of its own.  A subtree is built top-down; every node
where it branches and whose suffixes different words precede is a maximal repeat, and
the parent of a leaf is the longest repeat there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .blobs import STREAM, at_home, bucket_bits, by_bucket, gather, positions, repeated, rows, runs, split, texts
from .words import U, mix

CROWD = 50_000
PLACE = 12
NEIGHBOURS = np.dtype([("before", np.int64), ("after", np.int64)])
MARK = np.dtype([("flags", np.uint8), ("group", U)])
SUFFIX = np.dtype([("key", U), ("before", np.int64), ("edge", np.int32), ("end", np.int32)])
EDGE = np.dtype([("name", np.int64), ("at", np.int32)])
LEAF = np.dtype([("node", np.int64), ("words", np.int64), ("copies", np.int64), ("prefix", np.int64), ("longest", np.bool_)])


def _neighbours(table: pa.Table) -> pa.Table:
    """At a chunk: each suffix with the prefix class of the suffix before and after it, -1 where that is unique."""
    pos, name, _ = at_home(table)
    values = np.full(len(pos), -1, np.int64).repeat(2).view(NEIGHBOURS)
    joined = np.flatnonzero(pos[1:] == pos[:-1] + 1)
    values["before"][joined + 1] = name[joined]
    values["after"][joined] = name[joined + 1]
    return by_bucket(table["chunk"][0].as_py(), name, pos=pos.astype(np.uint32), b=values)


def _diverse(value: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    low, high = np.minimum.reduceat(value, first), np.maximum.reduceat(value, first)
    return np.repeat((low < 0) | (low != high), count)


def _branching(table: pa.Table) -> pa.Table:
    """Of a range of prefix classes: 1 for suffixes whose class is preceded by different words, 2 where it goes on differently; the class's group."""
    pos = table["pos"].to_pylist()
    sizes = np.array([len(p) // 4 for p in pos])
    rank, near = gather(table["a"].to_pylist(), np.uint32), gather(table["b"].to_pylist(), NEIGHBOURS)
    order = np.argsort(rank, kind="stable")
    first, count = runs(rank[order])
    at = gather(pos, np.uint32)
    place = (np.repeat(np.array(table["chunk"], np.int64), sizes) << (32 - PLACE)) | (at >> np.uint32(PLACE))
    group = mix(np.minimum.reduceat(place[order], first).astype(U))
    crowd = count > CROWD
    group[crowd] = mix(group[crowd] ^ rank[order[first[crowd]]].astype(U))
    mark = np.zeros(len(rank), MARK)
    mark["flags"][order] = _diverse(near["before"][order], first, count) + 2 * _diverse(near["after"][order], first, count).astype(np.uint8)
    mark["group"][order] = np.repeat(group, count)
    return split(table, mark["flags"] > 0, sizes, pos=at, b=mark)


def _suffixes(bits: int):
    """At a chunk: suffixes of left-branching classes by group, with the edges of their runs."""

    def run(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        marked = pc.is_null(table["a"])
        flagged, plain = table.filter(marked), table.filter(pc.invert(marked))
        pos, name, _ = at_home(plain)
        mark = np.zeros(len(pos), MARK)
        mark[np.searchsorted(pos, gather(flagged["pos"].to_pylist(), np.uint32))] = gather(flagged["b"].to_pylist(), MARK)
        joined = pos[1:] == pos[:-1] + 1
        last = np.append(np.flatnonzero(~joined), len(pos) - 1) if len(pos) else np.zeros(0, np.int64)
        left, right = np.flatnonzero(mark["flags"] & 1), np.flatnonzero(mark["flags"] & 2)
        if not len(left):
            return pa.Table.from_batches([rows([])])
        before, after = np.full(len(pos), -1, np.int64), np.full(len(pos), -1, np.int64)
        before[1:][joined] = name[:-1][joined]
        after[:-1][joined] = name[1:][joined]
        edges = np.empty(len(right), EDGE)
        edges["name"], edges["at"] = after[right], pos[right]
        single = edges["name"] < 0  # a unique way on equals no other
        edges["name"][single] = -1 - (mix(pos[right[single]].astype(U) ^ mix(np.array([chunk]).astype(U))) >> U(2)).astype(np.int64)
        which = np.searchsorted(last, left)
        low, high = np.searchsorted(right, left), np.searchsorted(right, last[which], "right")
        group = mark["group"][left]
        order = np.lexsort((left, which, group))
        out = []
        bucket = (group >> U(64 - bits)).astype(np.int64)
        begin, count = runs(bucket[order])
        for x, n in zip(begin.tolist(), count.tolist()):
            mine = order[x : x + n]
            head, size = runs(group[mine], which[mine])
            lo, hi = low[mine[head]], high[mine[head]]
            number = hi - lo
            offset = np.cumsum(number) - number
            take = np.arange(int(number.sum())) + np.repeat(lo - offset, number)
            suffix = np.empty(n, SUFFIX)
            suffix["key"], suffix["before"] = mix(name[left[mine]].astype(U)), before[left[mine]]
            suffix["edge"], suffix["end"] = low[mine] + np.repeat(offset - lo, size), np.repeat(offset + number, size)
            out.append({"chunk": chunk, "bucket": int(bucket[mine[0]]), "pos": pos[left[mine]].astype(np.uint32).tobytes(), "a": suffix.tobytes(), "b": edges[take].tobytes()})
        return pa.Table.from_batches([rows(out)])

    return run


def _counts(values: np.ndarray) -> np.ndarray:
    order = np.argsort(values)
    _, count = runs(values[order])
    out = np.empty(len(values), np.int64)
    out[order] = np.repeat(count, count)
    return out


def _trees(threshold: int, every: bool):
    """Builds the subtrees of a group of prefixes and gives each leaf whose parent can't be extended to the left.

    With `every`, each suffix comes with its deepest node that can't, and each other such node with one suffix.
    """

    def run(table: pa.Table) -> pa.Table:
        pos = table["pos"].to_pylist()
        sizes = np.array([len(p) // 4 for p in pos])
        suffix, edges = gather(table["a"].to_pylist(), SUFFIX), gather(table["b"].to_pylist(), EDGE)
        edge_sizes = np.array([len(b) // EDGE.itemsize for b in table["b"].to_pylist()])
        shift = np.repeat(np.cumsum(edge_sizes) - edge_sizes, sizes)
        start, end = suffix["edge"] + shift, suffix["end"] + shift
        at = gather(pos, np.uint32)
        best, which, others = np.zeros(len(suffix), LEAF), [np.zeros(0, np.int64)], [np.zeros(0, LEAF)]
        live, node, depth = np.arange(len(suffix)), suffix["key"].copy(), 0
        count = _counts(node)
        live, node, count = live[count > 1], node[count > 1], count[count > 1]
        while len(live):
            go = start[live] + depth < end[live]
            live, node, count = live[go], node[go], count[go]
            if not len(live):
                break
            edge = edges[start[live] + depth]
            below = mix(node * U(3) + mix(edge["name"].astype(U)))
            size = _counts(below)
            ends = size == 1
            before = suffix["before"][live]
            alike = _counts(mix(node) ^ mix(before.astype(U)))  # node is the mixed name itself at the root
            if every:  # an edge that all suffixes take leads to the same node again
                found = (size < count) & ((before < 0) | (alike < count))
            else:
                found = ends & ((before < 0) | (alike == 1))
            own = live[found]
            leaf = np.empty(len(own), LEAF)
            leaf["node"], leaf["words"], leaf["copies"] = node[found].astype(np.int64), threshold + edge["at"][found] - at[own].astype(np.int64), count[found]
            leaf["prefix"], leaf["longest"] = best["node"][own], True
            best[own] = leaf
            if every:
                once = np.unique(leaf["node"], return_index=True)[1]
                which.append(own[once])
                others.append(leaf[once])
            live, node, count, depth = live[~ends], below[~ends], size[~ends], depth + 1
        deepest = np.flatnonzero(best["copies"])
        which, others = np.concatenate(which), np.concatenate(others)
        shared = ~np.isin(others["node"], best["node"][deepest])  # all of its suffixes have deeper nodes
        others["longest"] = False
        which, leaf = np.concatenate([deepest, which[shared]]), np.concatenate([best[deepest], others[shared]])
        order = np.argsort(which, kind="stable")
        which, leaf = which[order], leaf[order]
        sizes = np.diff(np.searchsorted(which, np.concatenate([[0], np.cumsum(sizes)])))
        return split(table, np.ones(len(which), bool), sizes, pos=at[which], b=leaf)

    return run


def _passages(table: pa.Table) -> pa.Table:
    bucket = np.array(table["bucket"])
    own, docs = table.filter(pa.array(bucket >= 0)), table.filter(pa.array(bucket < 0)).sort_by("first")
    pos, leaf = gather(own["pos"].to_pylist(), np.uint32).astype(np.int64), gather(own["b"].to_pylist(), LEAF)
    first, n = np.array(docs["first"], np.int64), np.array(docs["n_words"], np.int64)
    doc = np.searchsorted(first + n, pos, "right")
    return pa.table({"doc_id": docs["doc_id"].take(pa.array(doc)), "start_word": pa.array(pos - first[doc]), "n_words": pa.array(leaf["words"]), "n_copies": pa.array(leaf["copies"]), "repeat_id": pa.array(leaf["node"]), "prefix_id": pa.array(leaf["prefix"], mask=leaf["prefix"] == 0), "longest": pa.array(leaf["longest"])})


def maximal_repeats(docs: DataFrame, threshold: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where a word begins: the longest passage of at least `threshold` words that occurs again, if it can't be extended to the left and still do so.

    Returns (doc_id, start_word, n_words, n_copies, repeat_id): occurrences of one
    passage share repeat_id; n_copies counts all of its occurrences in the corpus,
    also those inside longer repeats.

    A null, empty or shorter text has no passages.  A null doc_id stays null.
    Repeated rows are texts of their own and repeat each other.  Other columns are
    ignored; an empty table gives an empty result.
    """
    return _repeats(docs, threshold, False, id_col, text_col).drop("prefix_id", "longest")


def all_maximal_repeats(docs: DataFrame, threshold: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every maximal repeat: each passage of at least `threshold` words whose occurrences don't all go on alike to either side.

    Returns (doc_id, start_word, n_words, n_copies, repeat_id, prefix_id, longest).  Each
    word at which maximal repeats begin has a row with `longest` for the longest of
    them; prefix_id is the next shorter repeat that begins there, null for none.  So the
    n_copies occurrences of a repeat are the `longest` rows of itself and of all repeats
    that lead to it by prefix_id.  A repeat without rows of its own has one without
    `longest`, at one of its occurrences.  Rows are at most twice the words at which
    repeats begin; spelled out, nested repeats would take the square.  Other cases are
    as in maximal_repeats.
    """
    return _repeats(docs, threshold, True, id_col, text_col)


def _repeats(docs: DataFrame, threshold: int, every: bool, id_col: str, text_col: str) -> DataFrame:
    if threshold < 1:
        raise ValueError("threshold must be at least 1")
    own = texts(docs, id_col, text_col)
    scratch, bits = Scratch(docs.sparkSession), bucket_bits(own)
    classes = scratch.table(positions(own, threshold, threshold, bits).groupBy("bucket").applyInArrow(repeated, STREAM), "classes")
    listing, own = classes.filter("bucket < 0"), classes.filter("bucket >= 0")
    near = own.groupBy("chunk").applyInArrow(_neighbours, STREAM)
    flags = scratch.table(near.groupBy("bucket").applyInArrow(_branching, STREAM), "branches")
    n = flags.agg(F.sum(F.octet_length("pos") / 4)).first()[0] or 0
    suffixes = own.unionByName(flags).groupBy("chunk").applyInArrow(_suffixes(max(2, int(np.ceil(np.log2(n / 50_000 + 1))))), STREAM)
    leaves = scratch.table(suffixes.groupBy("bucket").applyInArrow(_trees(threshold, every), STREAM), "leaves")
    scratch.drop("branches")
    return leaves.unionByName(listing).groupBy("chunk").applyInArrow(_passages, "doc_id long, start_word long, n_words long, n_copies long, repeat_id long, prefix_id long, longest boolean")
