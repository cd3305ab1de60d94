"""N-gram Jaccard self-join of documents by vertical partitioning.

The global n-gram order runs from rare to frequent: first by the power of 4 that
a gram's document frequency reaches, then by the first document that holds it,
then by the gram.  Grams of one document family therefore lie side by side, and
the order is cut into cells that hold all grams of one level and family.

Two documents of Jaccard t or more share a gram among the first
n - ceil(t n) + 1 of each.  Documents that have none which another document
shares drop out, however popular the passages in the rest of their text are; the
others belong to the cells of their grams.  A cell of few documents is a fragment of its
own: it counts how many grams a pair can share in it at most, these are summed per pair, and pairs that
can't reach t, as most that only share a passage, end there.

Pairs that can, and cells of many documents, are settled in units.  Documents take the largest
cell near them as their label, and those of one label are one unit, to which each sends its
grams once.  A cell or pair whose documents don't all have one label is a unit, too, so nothing is
lost; one of too many documents is cut into blocks, whose pairs are units.  In a unit the order is
cut into fragments again; each counts the overlaps of the documents that have grams in it,
and they are summed per pair.  A unit gives a number of links for each document and
the edges of a forest, never its pairs, so the output follows the input.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..scratch import Scratch
from .blobs import ARROW, STREAM, bucket_bits, fresh, gather, rows, runs, split, texts
from .words import U, Words, chunks, mix, window_hashes

SEEN = np.dtype([("level", np.uint8), ("cell", np.uint32)])
LIST = "key long, n int, cells array<long>, counts array<int>, firsts array<boolean>, low binary, high binary"
LIST_ARROW = pa.schema([("key", pa.int64()), ("n", pa.int32()), ("cells", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("firsts", pa.list_(pa.bool_())), ("low", pa.binary()), ("high", pa.binary())])
FOUND = "key long, other long, links long"
FRAGMENT, ROWS = 1024, 512
UNIT, FEW = 4096, 64
ROUNDS = 2
HAS_WORDS = "[^\\t-\\r ]"


def gram_sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (text, n-gram hash) of a batch; a text of fewer than n words is one gram."""
    counts = np.diff(w.first)
    starts, grams = w.windows(n)
    doc = np.repeat(np.arange(len(counts)), counts)[starts]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        grams = np.concatenate([grams, window_hashes(w.hashes, w.first[short], w.first[short + 1])])
        doc = np.concatenate([doc, short])
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    first, _ = runs(doc, grams)
    return doc[first], grams[first]


def _grams(n: int, bits: int):
    def run(batches):
        at = TaskContext.get().partitionId() << 24
        for batch in batches:
            for piece in (p.slice(k, 1 << 16) for p in chunks(batch, 1) for k in range(0, p.num_rows, 1 << 16)):
                doc, grams = gram_sets(Words(piece.column(1)), n)
                count = np.bincount(doc, minlength=piece.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(count), at)), pa.array(np.full(len(count), -1 - at)), *[pa.nulls(len(count), pa.binary())] * 3, piece.column(0), pa.array(np.arange(len(count))), pa.array(count)], schema=ARROW
                )
                order = np.argsort(grams)
                doc, grams = doc[order].astype(np.uint16), grams[order]
                cut = np.searchsorted(grams >> U(64 - bits), np.arange((1 << bits) + 1, dtype=U))
                key = (grams << U(bits)) >> U(16)
                hi, lo = (key >> U(32)).astype(np.uint16), key.astype(np.uint32)
                yield rows([{"chunk": at, "bucket": b, "pos": doc[x:y].tobytes(), "a": hi[x:y].tobytes(), "b": lo[x:y].tobytes()} for b, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if y > x])
                at += 1

    return run


def _frequencies(table: pa.Table) -> pa.Table:
    """Of one bucket, the grams that several documents hold, with level and family."""
    if table.num_rows == 0 or table["bucket"][0].as_py() < 0:
        return table
    pos = table["pos"].to_pylist()
    sizes = np.array([len(p) // 2 for p in pos])
    doc = gather(pos, np.uint16)
    key = (gather(table["a"].to_pylist(), np.uint16).astype(U) << U(32)) | gather(table["b"].to_pylist(), np.uint32)
    whose = (np.repeat(np.array(table["chunk"], np.int64), sizes) << 16) | doc
    order = np.argsort(key)
    first, count = runs(key[order])
    seen, keep, rank = np.empty(len(key), SEEN), np.empty(len(key), bool), np.empty(len(key), np.uint32)
    seen["level"][order] = np.repeat((np.log2(count) // 2).astype(np.uint8), count)
    seen["cell"][order] = np.repeat(mix(np.minimum.reduceat(whose[order], first).astype(U)).astype(np.uint32), count)
    keep[order] = np.repeat(count > 1, count)
    rank[order] = np.repeat(first, count)
    return split(table, keep, sizes, pos=doc, a=rank, b=seen)


def _lists(least: float):
    """At a chunk: the documents that can have a partner, with their shared grams and these grams' cells: how many of them, and whether any is among the first."""

    def run(table: pa.Table) -> pa.Table:
        bucket = np.array(table["bucket"], np.int64)
        own, docs = table.filter(pa.array(bucket >= 0)), table.filter(pa.array(bucket < 0)).sort_by("first")
        pos = own["pos"].to_pylist()
        doc, seen = gather(pos, np.uint16), gather(own["b"].to_pylist(), SEEN)
        name = gather(own["a"].to_pylist(), np.uint32).astype(U) | (np.repeat(np.array(own["bucket"], np.int64), [len(p) // 2 for p in pos]).astype(U) << U(32))
        name = mix(name)
        cell = (seen["level"].astype(np.int64) << 32) | seen["cell"]
        order = np.lexsort((name, cell, doc))
        doc, cell, name = doc[order], cell[order], name[order]
        key, size = docs["doc_id"].to_numpy(), np.array(docs["n_words"], np.int64)
        out = {f.name: [] for f in LIST_ARROW}
        for x, shared in zip(*(v.tolist() for v in runs(doc))):
            n = int(size[doc[x]])
            prefix = n - math.ceil(least * n - 1e-9) + 1 - (n - shared)
            if prefix <= 0:
                continue
            names, (begin, count) = name[x : x + shared], runs(cell[x : x + shared])
            for k, v in (("key", int(key[doc[x]])), ("n", n), ("cells", cell[x + begin]), ("counts", count), ("firsts", begin < prefix), ("low", names.astype(np.uint32).tobytes()), ("high", (names >> U(48)).astype(np.uint16).tobytes())):
                out[k].append(v)
        return pa.table(out, schema=LIST_ARROW)

    return run


def overlaps(ids: list[np.ndarray], first: int) -> np.ndarray:
    """The sizes of the intersections of the first lists with the others (of all with all if `first` takes all), fragment by fragment.

    Ids that lie in one list only are left out; the rest are ordered by the first list that has them, so a
    fragment concerns few lists, and only these are counted in it.
    """
    whole = first == len(ids)
    both = np.zeros((first, len(ids) - (0 if whole else first)), np.float32)
    flat, row = np.concatenate(ids), np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    order = np.argsort(flat, kind="stable")
    begin, count = runs(flat[order])
    row = row[order]
    shared = np.flatnonzero(count > 1)
    place = np.full(len(count), -1)
    place[shared[np.argsort(row[begin[shared]], kind="stable")]] = np.arange(len(shared))
    column = np.repeat(place, count)
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    cut = np.searchsorted(column, np.arange(0, len(shared) + FRAGMENT, FRAGMENT))
    for f, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
        part = []
        for mine in ([slice(x, y)] if whole else [np.flatnonzero(row[x:y] < first) + x, np.flatnonzero(row[x:y] >= first) + x]):
            lists, at = np.unique(row[mine], return_inverse=True)
            ones = np.zeros((len(lists), min(FRAGMENT, len(shared) - f * FRAGMENT)), np.float32)
            ones[at, column[mine] - f * FRAGMENT] = 1
            part.append((lists, ones))
        (a, left), (b, right) = part[0], part[-1]
        if len(a) and len(b):
            both[np.ix_(a, b if whole else b - first)] += left @ right.T
    return both


def _linked(names: list[np.ndarray], n: np.ndarray, first: int, least: float) -> np.ndarray:
    """Which documents of a unit are linked, as a symmetric matrix; of two blocks only pairs across."""
    both, k = overlaps(names, first), len(names)
    linked, shift = np.zeros((k, k), bool), k - both.shape[1]
    for a in range(0, len(both), ROWS):
        part = both[a : a + ROWS].astype(np.float64)
        linked[a : a + ROWS, shift:][: len(part)] = (part >= 0.5) & (part / (n[a : a + len(part), None] + n[None, shift:] - part) >= least)
    linked |= linked.T
    np.fill_diagonal(linked, False)
    return linked


def forest(linked: np.ndarray) -> np.ndarray:
    """For each row the least row that it reaches."""
    root = np.arange(len(linked))
    for start in np.flatnonzero(linked.any(axis=1)).tolist():
        if root[start] != start:
            continue
        seen = np.zeros(len(linked), bool)
        seen[start], front = True, np.array([start])
        while len(front):
            reach = linked[front].any(axis=0) & ~seen
            seen |= reach
            front = np.flatnonzero(reach)
        root[seen] = start
    return root


def _links(least: float):
    """In a group of units: for each document its number of links (other = key), and the edges of forests (links 0)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("own", "unit", "i", "j", "part", "key")])
        columns = {c: table[c].to_numpy() for c in ("unit", "i", "j", "part", "key", "n", "copies")}
        key, n, copies = columns["key"], columns["n"].astype(np.int64), columns["copies"].astype(np.float64)
        own = table["own"].to_numpy(zero_copy_only=False)
        found = [np.zeros((0, 3), np.int64)]
        for x, k in zip(*(v.tolist() for v in runs(own, columns["unit"], columns["i"], columns["j"]))):
            if k == 1:
                continue
            piece, part = table.slice(x, k), columns["part"][x : x + k]
            first = k if part[0] == part[-1] else int((part == part[0]).sum())
            if first == k and columns["i"][x] != columns["j"][x]:
                continue  # one of the two blocks is empty
            names = [np.frombuffer(a, np.uint32).astype(U) | (np.frombuffer(b, np.uint16).astype(U) << U(32)) for a, b in zip(piece["low"].to_pylist(), piece["high"].to_pylist())]
            linked = _linked(names, n[x : x + k], first, least)
            if not own[x]:  # pairs of one label, or of an earlier common cell, are linked there
                label = piece["label"].to_numpy(zero_copy_only=False).astype(np.float64, copy=False) if piece["label"].null_count == k else np.array([np.nan if v is None else v for v in piece["label"].to_pylist()])
                linked &= label[:, None] != label[None, :]
                cells = [np.array(c, np.int64) for c in piece["extra"].to_pylist()]
                linked &= overlaps([c[c < columns["unit"][x]] for c in cells], k) == 0
            links = np.concatenate([linked[a : a + ROWS].astype(np.float64) @ copies[x : x + k] for a in range(0, k, ROWS)]).astype(np.int64)
            a = np.flatnonzero(links)
            found.append(np.stack([key[x + a], key[x + a], links[a]], axis=1))
            root = forest(linked)
            a = np.flatnonzero(root != np.arange(k))
            found.append(np.stack([key[x + a], key[x + root[a]], np.zeros(len(a), np.int64)], axis=1))
        return pa.table(dict(zip(("key", "other", "links"), np.concatenate(found).T)))

    return run


class _Join:
    """members: the distinct (_id, _key) of the documents; keys: for each text with words its copies, lowest _id, root and links."""

    def __init__(self, docs: DataFrame, n: int, least: float, id_col: str, text_col: str):
        if n < 1 or not 0 < least <= 1:
            raise ValueError("n must be at least 1 and the least Jaccard in (0, 1]")
        own = texts(docs, id_col, text_col).filter("_id is not null").withColumn("_words", F.coalesce(F.col("_text").rlike(HAS_WORDS), F.lit(False))).withColumn("_key", F.xxhash64("_text"))
        self.scratch = scratch = Scratch(docs.sparkSession)
        self.members = scratch.table(own.select("_id", "_key", "_words").distinct(), "members")
        copies = scratch.table(self.members.filter("_words").groupBy(F.col("_key").alias("key")).agg(F.count("*").alias("copies"), F.min("_id").alias("low_id")), "copies")
        texts_of = scratch.table(own.filter("_words").groupBy("_key").agg(F.first("_text").alias("_text")), "texts")
        bits = bucket_bits(texts_of)
        grams = texts_of.select("_key", "_text").mapInArrow(_grams(n, bits), STREAM)
        shared = scratch.table(grams.groupBy("bucket").applyInArrow(_frequencies, STREAM), "shared")
        scratch.drop("texts")
        lists = scratch.table(shared.groupBy("chunk").applyInArrow(_lists(least), LIST), "lists")
        scratch.drop("shared")
        sends = lists.join(self._routes(lists, least), "key").join(copies.select("key", "copies"), "key").withColumn("bucket", F.pmod(F.xxhash64("own", "unit", "i", "j"), F.lit(1 << bits)))
        found = scratch.table(sends.drop("cells", "counts", "firsts").groupBy("bucket").applyInArrow(_links(least), FOUND), "found")
        scratch.drop("lists", "near", "cells", "extra", "label", *[f"label{k}" for k in range(ROUNDS + 1)])
        roots = components(scratch, found.filter("key <> other").toDF("key_a", "key_b", "links"))
        links = found.filter("key = other").groupBy("key").agg(F.sum("links").alias("links"))
        self.keys = copies.join(roots, "key", "left").join(links, "key", "left").select("key", "copies", "low_id", F.coalesce("root", "key").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))

    def _cells(self, lists: DataFrame, least: float) -> DataFrame:
        """(key, cell, docs): the cells of many documents, and each pair of fewer that may have enough in common as a cell of two."""
        each = lists.select("key", "n", F.explode(F.arrays_zip("cells", "counts", "firsts")).alias("x")).select("key", "n", F.col("x.cells").alias("cell"), F.col("x.counts").alias("count"), F.col("x.firsts").alias("first"))
        sizes = each.groupBy("cell").agg(F.count("*").alias("docs"), F.count_if("first").alias("firsts")).filter("docs > 1")
        near = self.scratch.table(each.join(sizes, "cell"), "near")
        many, few = near.filter(F.col("docs") > FEW), near.filter(F.col("docs") <= FEW)
        rest = many.groupBy("key").agg(F.sum("count").alias("rest"))
        a, b = (few.select("cell", *[F.col(c).alias(f"{c}_{x}") for c in ("key", "n", "count", "first")]) for x in "ab")
        pairs = a.join(b, "cell").filter((F.col("key_a") < F.col("key_b")) & (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * least - 1e-6))
        pairs = pairs.groupBy("key_a", "key_b", "n_a", "n_b").agg(F.sum(F.least("count_a", "count_b")).alias("common"), F.max(F.col("first_a") & F.col("first_b")).alias("first")).filter("first")
        for x in "ab":
            pairs = pairs.join(rest.toDF(f"key_{x}", f"rest_{x}"), f"key_{x}", "left")
        possible = F.col("common") + F.coalesce(F.least("rest_a", "rest_b"), F.lit(0)) * (F.col("rest_a").isNotNull() & F.col("rest_b").isNotNull()).cast("int")
        close = pairs.filter(possible >= least / (1 + least) * (F.col("n_a") + F.col("n_b")) - 1e-6)
        twos = close.select(F.explode(F.array("key_a", "key_b")).alias("key"), F.xxhash64("key_a", "key_b").alias("cell"), F.lit(2).cast("long").alias("docs"))
        return many.filter("first and firsts > 1").select("key", "cell", F.col("firsts").alias("docs")).unionByName(twos)

    def _routes(self, lists: DataFrame, least: float) -> DataFrame:
        """(key, own, unit, i, j, part, label, extra): the units of each document.

        The labels spread from cell to document and back in a fixed number of rounds.  The documents of a label that
        has more than UNIT of them take that of the round before; without any, their cells are units.
        """
        table = self.scratch.table
        cells = table(self._cells(lists, least), "cells")
        labels = [table(cells.groupBy("key").agg(F.max(F.struct("docs", "cell")).alias("label")), "label0")]
        for k in range(ROUNDS):
            best = cells.join(labels[-1], "key").groupBy("cell").agg(F.max("label").alias("label"))
            labels.append(table(cells.join(best, "cell").groupBy("key").agg(F.max("label").alias("label")), f"label{k + 1}"))
        label = None
        for k, each in enumerate(labels):
            fits = each.groupBy("label").agg(F.count("*").alias("size")).filter(F.col("size") <= UNIT)
            each = each.join(fits.select("label"), "label", "left_semi").select("key", F.col("label.cell").alias(f"l{k}"))
            label = each if label is None else label.join(each, "key", "full")
        label = table(cells.select("key").distinct().join(label, "key", "left").select("key", F.coalesce(*[F.col(f"l{k}") for k in reversed(range(len(labels)))]).alias("label")), "label")
        label = label.join(label.filter("label is not null").groupBy("label").agg(F.count("*").alias("size")), "label", "left")
        whole = cells.join(label, "key").groupBy("cell").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("label").alias("labelled"), F.count("*").alias("docs"))
        rest = whole.filter("labelled < docs or low <> high").select("cell", "docs")
        extra = table(cells.select("key", "cell").join(rest, "cell"), "extra")
        parts = F.when(F.col("docs") > UNIT, F.ceil(F.col("docs") / (UNIT // 2))).otherwise(F.lit(1))
        units = label.filter("size > 1").select("key", F.lit(True).alias("own"), F.col("label").alias("unit"), F.lit(1).cast("long").alias("parts")).unionByName(extra.select("key", F.lit(False).alias("own"), F.col("cell").alias("unit"), parts.cast("long").alias("parts")))
        units = units.withColumn("part", F.pmod(F.xxhash64("key"), "parts")).withColumn("q", F.explode(F.expr("sequence(0L, parts - 1)")))
        also = label.select("key", "label").join(extra.groupBy("key").agg(F.array_sort(F.collect_list("cell")).alias("extra")), "key", "left")
        return units.join(also, "key").select("key", "own", "unit", F.least("part", "q").alias("i"), F.greatest("part", "q").alias("j"), "part", "label", F.coalesce("extra", F.array().cast("array<long>")).alias("extra"))


def linked_documents(docs: DataFrame, n: int = 3, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links) of every document, by pairs whose sets of n-grams of words have a Jaccard similarity of at least `least`.

    n_links counts the documents with which a document makes such a pair, copies of its text included.
    Documents that pairs link, directly or through others, are one class; class_id is its lowest doc_id.

    A document is a distinct (doc_id, text); repeated rows are one.  A doc_id with several texts has a row for
    each, and its texts may be linked.  A text of 1 to n - 1 words is one gram; a null text or one without words
    has no links and is its own class; a null doc_id has no row.  Other columns are ignored; an
    empty table gives an empty result.
    """
    join = _Join(docs, n, least, id_col, text_col)
    keys = join.scratch.table(join.keys, "keys")
    classes = keys.groupBy("root").agg(F.min("low_id").alias("class_id"))
    of = keys.join(classes, "root").select(F.col("key").alias("_key"), "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    return join.members.join(of, "_key", "left").select(F.col("_id").alias("doc_id"), F.coalesce("class_id", "_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(key, root): the least key that each key reaches; edges (key_a, key_b)."""
    both = scratch.table(edges.select("key_a", "key_b").union(edges.select("key_b", "key_a")).filter("key_a <> key_b").distinct(), "edges")
    roots = scratch.table(both.groupBy("key_a").agg(F.least("key_a", F.min("key_b")).alias("root")).withColumnRenamed("key_a", "key"), "roots0")
    number = 0
    while True:
        number += 1
        nearest = both.join(roots, both.key_b == roots.key).groupBy("key_a").agg(F.min("root").alias("near"))
        better = roots.join(nearest, F.col("key") == F.col("key_a"), "left").select("key", "root", F.least("root", "near").alias("next"))
        jumped = better.alias("x").join(better.select(F.col("key").alias("k2"), F.col("next").alias("n2")), F.col("next") == F.col("k2"), "left")
        state = scratch.table(jumped.select("key", F.col("root").alias("was"), F.least("next", "n2").alias("root")), f"roots{number}")
        scratch.drop(f"roots{number - 1}")
        roots = state.select("key", "root")
        if state.filter("was <> root").isEmpty():
            return roots


def drop_near_duplicates(docs: DataFrame, n: int = 3, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near copies: of each group linked by pairs of enough similarity, the lowest doc_id stays.

    All columns and documents outside of groups stay as they are; a null text or a
    text without words, and a null doc_id, are in no group.  Of repeated rows of one doc_id
    and text, which are copies, too, one stays; of several texts of the lowest doc_id in a group, one.
    """
    join = _Join(docs, n, least, id_col, text_col)
    keys = join.scratch.table(join.keys, "keys")
    stay = keys.groupBy("root").agg(F.min(F.struct("low_id", "key")).alias("first")).select(F.col("first.key").alias("_key"), F.col("first.low_id").alias("_low"))
    goes = join.scratch.table(join.members.filter("_words").join(stay, "_key", "left").filter("_low is null or _low <> _id").select("_id", "_key"), "goes")
    own_id, own_key, nth = (fresh(docs.columns, c) for c in ("id", "key", "nth"))
    id_, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    grouped = F.coalesce(id_.isNotNull() & text.rlike(HAS_WORDS), F.lit(False))
    stays = docs.filter(grouped).withColumns({own_id: id_, own_key: F.xxhash64(text)}).join(goes.toDF(own_id, own_key), [own_id, own_key], "left_anti")
    once = stays.withColumn(nth, F.row_number().over(Window.partitionBy(own_id, own_key).orderBy(own_id))).filter(F.col(nth) == 1)
    return once.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.filter(~grouped))
