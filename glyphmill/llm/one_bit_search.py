"""Nearest neighbours of a query set by randomly rotated one-bit codes.

Vectors are normalised and given to centres that were fitted on a bounded sample; a residual
to its centre is rotated at random and kept as one sign bit a dimension with two scalars: the
residual's length and its inner product with the code.  A query's rotated residual is
quantised to 4 bits, its inner product with a code is 4 popcounts, and the code's scalar turns
that into an estimate with an error bound.  Vectors whose lower bound of distance beats the
query's k-th best so far are reranked exactly.

Every vector is in the index.  Queries and vectors travel in blocks; a block of queries
first searches one block of its own centre, which bounds its k-th best, and then the blocks
that the triangle inequality doesn't rule out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .words import settle

BLOCK, QUERIES = 8192, 2048
CENTRES, SAMPLE = 1024, 1 << 16
TILE = 128
PLANES = 4
BLOCKS = "block long, cluster long, centre array<float>, radius double, ids binary, vectors binary"
BLOCKS_ARROW = pa.schema([("block", pa.int64()), ("cluster", pa.int64()), ("centre", pa.list_(pa.float32())), ("radius", pa.float64()), ("ids", pa.binary()), ("vectors", pa.binary())])
FOUND_ARROW = pa.schema([("vec_id", pa.int64()), ("neighbour_id", pa.int64()), ("similarity", pa.float32())])
FOUND = "vec_id long, neighbour_id long, similarity float"


def rotation(d: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


class Codes:
    """Packed sign bits of rotated unit residuals with their correction scalars."""

    def __init__(self, vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        residual = vectors - centre
        self.length = np.linalg.norm(residual, axis=1)
        unit = (residual / np.maximum(self.length, 1e-12)[:, None]) @ turn.T
        d = unit.shape[1]
        bits = unit > 0
        self.inner = np.maximum(np.abs(unit).sum(axis=1) / math.sqrt(d), 1e-6)  # <code, residual>
        padded = np.zeros((len(bits), -(-d // 64) * 64), bool)
        padded[:, :d] = bits
        self.words = np.packbits(padded, axis=1).view(np.uint64)
        self.ones = bits.sum(axis=1).astype(np.float32)
        self.spread = np.sqrt(np.maximum(1 - self.inner**2, 0)) / self.inner / math.sqrt(max(d - 1, 1))
        self.d = d

    def bounds(self, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, sure: float) -> np.ndarray:
        """Lower bounds of the squared distances from each query to each coded vector."""
        residual = queries - centre
        length = np.linalg.norm(residual, axis=1)
        unit = (residual / np.maximum(length, 1e-12)[:, None]) @ turn.T
        low = unit.min(axis=1, keepdims=True)
        step = np.maximum(unit.max(axis=1, keepdims=True) - low, 1e-9) / ((1 << PLANES) - 1)
        level = np.rint((unit - low) / step).astype(np.uint8)
        padded = np.zeros((len(level), self.words.shape[1] * 64), np.uint8)
        padded[:, : self.d] = level
        total = np.zeros((len(queries), len(self.words)), np.float32)
        for p in range(PLANES):
            plane = np.packbits((padded >> p) & 1, axis=1).view(np.uint64)
            for w in range(plane.shape[1]):
                total += np.bitwise_count(plane[:, None, w] & self.words[None, :, w]).astype(np.float32) * np.float32(1 << p)
        # sum of sign * quantised value = 2 * sum over set bits - sum over all
        dot = 2 * (step * total + low * self.ones[None, :]) - (step * level.sum(axis=1, keepdims=True) + low * self.d)
        estimate = dot / math.sqrt(self.d) / self.inner[None, :] + sure * self.spread[None, :] + step / self.inner[None, :] / 2
        return length[:, None] ** 2 + self.length[None, :] ** 2 - 2 * length[:, None] * self.length[None, :] * np.minimum(estimate, 1)


def exact(queries, query_ids, vectors, ids, allowed):
    """(query, vector, similarity) of the allowed pairs without those of one id, sorted by query, falling similarity, id."""
    row, column = np.nonzero(allowed)
    other = query_ids[row] != ids[column]
    row, column = row[other], column[other]
    found = np.empty(len(row), np.float32)
    for a in range(0, len(row), 1 << 16):
        found[a : a + (1 << 16)] = np.einsum("ij,ij->i", queries[row[a : a + (1 << 16)]], vectors[column[a : a + (1 << 16)]])
    order = np.lexsort((ids[column], -found, row))
    return row[order], column[order], found[order]


def best(row, k: int) -> np.ndarray:
    """Which entries of sorted rows are among the first k of their row."""
    return np.arange(len(row)) - np.searchsorted(row, row) < k


def search(queries, query_ids, worst, vectors, ids, centre, turn, k, sure):
    """(query, vector, similarity): of each query up to k vectors of a block, at least as similar as the query's k-th best so far (-inf: none yet)."""
    codes = Codes(vectors, centre, turn)
    radius = codes.length.max() if len(codes.length) else 0.0
    far = np.linalg.norm(queries - centre, axis=1) - radius
    need = np.flatnonzero(far <= np.sqrt(np.maximum(2 - 2 * worst.astype(np.float64), 0)) + 1e-5)
    out = []
    for a in range(0, len(need), TILE):
        rows = need[a : a + TILE]
        bound = codes.bounds(queries[rows], centre, turn, sure)
        limit = worst[rows].astype(np.float64)
        if np.isneginf(limit).any():  # no k-th best yet: the nearest by estimate give one
            near = np.argpartition(bound, min(4 * k, bound.shape[1] - 1), axis=1)[:, : 4 * k]
            first = np.zeros(bound.shape, bool)
            np.put_along_axis(first, near, True, axis=1)
            row, _, found = exact(queries[rows], query_ids[rows], vectors, ids, first)
            last = (np.arange(len(row)) - np.searchsorted(row, row)) == k - 1
            limit[row[last]] = np.maximum(limit[row[last]], found[last])
        row, column, found = exact(queries[rows], query_ids[rows], vectors, ids, bound <= np.where(np.isneginf(limit), np.inf, 2 - 2 * limit + 1e-5)[:, None])
        good = best(row, k) & (found >= worst[rows][row])
        out.append((rows[row[good]], column[good], found[good]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))


def fitted(sample: np.ndarray, count: int, rounds: int = 5) -> np.ndarray:
    """Lloyd's rounds over the sample, from its first vectors."""
    centres = sample[:count].copy()
    for _ in range(rounds):
        near = nearest(sample, centres)
        n = np.bincount(near, minlength=count)
        total = np.zeros(centres.shape)
        np.add.at(total, near, sample)
        centres[n > 0] = (total[n > 0] / n[n > 0, None]).astype(np.float32)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([(x[a : a + 4096] @ centres.T - half).argmax(axis=1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def _matrix(column, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(-1, d)


def _blocks(rows: DataFrame, d: int, centres, size: int) -> DataFrame:
    """The rows (id, v) in blocks of about `size` of one cluster."""

    def assign(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest(_matrix(batch.column(1), d), centres.value))], names=["id", "v", "cluster"])

    def block(table: pa.Table) -> pa.Table:
        settle()
        table = table.sort_by("id")
        cluster, x = table["cluster"][0].as_py(), np.ascontiguousarray(_matrix(table["v"], d), np.float32)
        centre = centres.value[cluster]
        return pa.Table.from_pylist([{"block": cluster << 32 | table["salt"][0].as_py(), "cluster": cluster, "centre": centre.tolist(), "radius": float(np.linalg.norm(x - centre, axis=1).max()), "ids": table["id"].to_numpy().tobytes(), "vectors": x.tobytes()}], BLOCKS_ARROW)

    assigned = rows.mapInArrow(assign, "id long, v array<float>, cluster long")
    parts = assigned.groupBy("cluster").agg(F.ceil(F.count("*") / size).alias("parts"))
    salted = assigned.join(F.broadcast(parts), "cluster").withColumn("salt", F.pmod(F.xxhash64("id"), "parts"))  # a row a centre, at most CENTRES
    return salted.select("id", "v", "cluster", "salt").groupBy("cluster", "salt").applyInArrow(block, BLOCKS)


def neighbours(vectors: DataFrame, k: int = 10, every: int = 20, sure: float = 2.5, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """The k vectors of largest cosine similarity to each query, itself excluded, among all vectors.

    Queries are the rows whose id is divisible by `every`.  Returns (vec_id, rank, neighbour_id,
    similarity), rank from 1; ties go to the lower id.  `sure` is the error bound in standard
    deviations of the estimate: 2.5 finds more than 0.99 of the true neighbours.  The centres are
    fitted on the `sample` vectors of the lowest hashes; all vectors are indexed.

    Rows with a null id, or a null, empty, zero or not finite vector, or one of another length than the
    most frequent, are left out.  Of several vectors of one id the least counts.  With
    fewer than k others all are given.  Other columns are ignored; an empty table
    gives an empty result.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).filter("id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    own = own.withColumn("l", F.expr("sqrt(aggregate(v, 0D, (a, x) -> a + x * x))")).filter("l > 0")
    sizes = own.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "vec_id long, rank long, neighbour_id long, similarity double")
    d, total = sizes["d"], sizes["count"]
    scratch = Scratch(spark)
    unit = own.filter(F.size("v") == d).groupBy("id").agg(F.min(F.struct("v", "l")).alias("x")).select("id", F.expr("transform(x.v, y -> cast(y / x.l as float))").alias("v"))
    unit = scratch.table(unit, "unit")
    chosen = [r.v for r in unit.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toLocalIterator()]
    centres = spark.sparkContext.broadcast(fitted(np.array(chosen, np.float32), min(CENTRES, len(chosen), -(-total // (2 * BLOCK)))))
    turn = rotation(d)
    # of equal vectors only the k + 1 lowest ids can be anyone's neighbours; a limited rank is cut before the shuffle
    distinct = unit.withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("nth") <= k + 1).select("id", "v")
    data = scratch.table(_blocks(distinct, d, centres, BLOCK), "blocks")
    asked = scratch.table(_blocks(unit.filter(F.col("id") % every == 0), d, centres, QUERIES), "asked")
    query = asked.select(F.col("block").alias("qb"), F.col("cluster"), F.col("centre").alias("qc"), F.col("radius").alias("qr"), F.col("ids").alias("qi"), F.col("vectors").alias("qv"))
    block = data.select(F.col("block").alias("db"), "centre", F.col("radius").alias("dr"), "ids", "vectors")

    def blobs(row):
        return np.frombuffer(row["qi"], np.int64), np.frombuffer(row["qv"], np.float32).reshape(-1, d), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.float32).reshape(-1, d), np.array(row["centre"], np.float32)

    def begin(batches):
        """The k best in one block of the query's own centre, or any, and their k-th similarity."""
        settle()
        for batch in batches:
            for row in batch.to_pylist():
                qi, qv, ids, x, centre = blobs(row)
                q, c, found = search(qv, qi, np.full(len(qi), -np.inf, np.float32), x, ids, centre, turn, k, sure)
                worst, last = np.full(len(qi), -np.inf, np.float32), (np.arange(len(q)) - np.searchsorted(q, q)) == k - 1
                worst[q[last]] = found[last]
                yield pa.RecordBatch.from_pylist([{"qb": row["qb"], "first": row["db"], "worst": worst.tobytes(), "limit": float(np.sqrt(np.maximum(2 - 2 * worst.astype(np.float64), 0)).max()), "q": qi[q].tobytes(), "c": ids[c].tobytes(), "s": found.tobytes()}], pa.schema([("qb", pa.int64()), ("first", pa.int64()), ("worst", pa.binary()), ("limit", pa.float64()), ("q", pa.binary()), ("c", pa.binary()), ("s", pa.binary())]))

    home = data.groupBy("cluster").agg(F.min("block").alias("db"))  # a row a centre
    some = home.agg(F.min("db").alias("any"))
    started = query.join(F.broadcast(home), "cluster", "left").crossJoin(F.broadcast(some)).withColumn("db", F.coalesce("db", "any")).join(block, "db")
    begun = scratch.table(started.select("qb", "db", "qi", "qv", "ids", "vectors", "centre").mapInArrow(begin, "qb long, first long, worst binary, limit double, q binary, c binary, s binary"), "begun", records=4)
    reach = query.select("qb", "qc", "qr").join(begun.select("qb", "first", "limit"), "qb")
    apart = F.sqrt(F.aggregate(F.zip_with("qc", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
    pairs = reach.crossJoin(block.select("db", "centre", "dr")).filter((F.col("first") != F.col("db")) & (apart - F.col("qr") - F.col("dr") <= F.col("limit") + 1e-4)).select("qb", "db")  # the numbers of blocks, the queries against all rows
    joined = pairs.repartition("qb", "db").join(query.select("qb", "qi", "qv").join(begun.select("qb", "worst"), "qb"), "qb").join(block, "db")

    def improve(batches):
        settle()
        for batch in batches:
            for row in batch.to_pylist():
                qi, qv, ids, x, centre = blobs(row)
                q, c, found = search(qv, qi, np.frombuffer(row["worst"], np.float32), x, ids, centre, turn, k, sure)
                yield pa.RecordBatch.from_arrays([pa.array(qi[q]), pa.array(ids[c]), pa.array(found)], schema=FOUND_ARROW)

    def unpack(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row["q"], np.int64)), pa.array(np.frombuffer(row["c"], np.int64)), pa.array(np.frombuffer(row["s"], np.float32))], schema=FOUND_ARROW)

    improved = scratch.table(joined.select("qb", "qi", "qv", "worst", "ids", "vectors", "centre").mapInArrow(improve, FOUND), "improved", records=4)
    found = begun.select("q", "c", "s").mapInArrow(unpack, FOUND).unionByName(improved)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "neighbour_id"))).filter(F.col("rank") <= k)
    return ranked.select("vec_id", F.col("rank").cast("long").alias("rank"), "neighbour_id", F.col("similarity").cast("double").alias("similarity"))
