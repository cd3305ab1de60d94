"""Position streams: many small records of one text chunk travel as a few binary rows.

Positions are word numbers inside a chunk (some megabytes of whole texts).  A
bucket is a range of hash values; its rows hold, chunk by chunk, the records
that fall into it, so one shuffle row carries thousands of records.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U, Words, chunks, gather

STREAM = "chunk long, bucket long, pos binary, a binary, b binary, doc_id long, first long, n_words long"
ARROW = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("pos", pa.binary()), ("a", pa.binary()), ("b", pa.binary()), ("doc_id", pa.int64()), ("first", pa.int64()), ("n_words", pa.int64())])


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that count, under names that nothing else can clash with."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))


def fresh(taken: list[str], name: str) -> str:
    """A column name that no column has."""
    low = {c.lower() for c in taken}
    while name in low:
        name += "_"
    return name


def bucket_bits(df: DataFrame, records_each: int = 1 << 18) -> int:
    """Bits that number the buckets, from the bytes of all texts."""
    n = df.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    return max(2, math.ceil(math.log2(max(1, n / 5 / records_each))))


def rows(items: list[dict]) -> pa.RecordBatch:
    cols = {f.name: pa.array([x.get(f.name) for x in items], f.type) for f in ARROW}
    return pa.RecordBatch.from_arrays([cols[f.name] for f in ARROW], schema=ARROW)


def positions(df: DataFrame, window: int, least: int, bits: int) -> DataFrame:
    """Every window of every text with at least `least` words: its position and hash, bucketed by the hash's first bits.

    Also one row for each text (bucket below 0): chunk, doc_id, first word, words.
    """

    def run(batches):
        at = TaskContext.get().partitionId() << 24
        for batch in batches:
            for piece in chunks(batch, 1):
                w = Words(piece.column(1))
                counts = np.diff(w.first)
                shift = np.arange(len(counts))  # a number is left free between texts, so no partner lies in the next one
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(counts), at)), pa.array(np.full(len(counts), -1 - at)), *[pa.nulls(len(counts), pa.binary())] * 3, piece.column(0), pa.array(w.first[:-1] + shift), pa.array(counts)], schema=ARROW
                )
                starts, h = w.windows(window)
                long_enough = np.repeat(counts >= least, counts)[starts]
                starts, h = (starts + np.repeat(shift, counts)[starts])[long_enough].astype(np.uint32), h[long_enough]
                order = np.argsort(h)
                starts, h = starts[order], h[order]
                cut = np.searchsorted(h >> U(64 - bits), np.arange((1 << bits) + 1, dtype=U))
                key = (h << U(bits)) >> U(16)
                hi, lo = (key >> U(32)).astype(np.uint16), key.astype(np.uint32)
                yield rows([{"chunk": at, "bucket": b, "pos": starts[x:y].tobytes(), "a": hi[x:y].tobytes(), "b": lo[x:y].tobytes()} for b, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if y > x])
                at += 1

    return df.select("_id", "_text").mapInArrow(run, STREAM)


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of equal values in sorted arrays."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(new)))


def split(table: pa.Table, keep: np.ndarray, sizes: np.ndarray, **values: np.ndarray) -> pa.Table:
    """The kept records, as one row again for each row of the table."""
    out, at = [], 0
    for chunk, bucket, n in zip(table["chunk"].to_pylist(), table["bucket"].to_pylist(), sizes.tolist()):
        mine = keep[at : at + n]
        if mine.any():
            out.append({"chunk": chunk, "bucket": bucket} | {k: v[at : at + n][mine].tobytes() for k, v in values.items()})
        at += n
    return pa.Table.from_batches([rows(out)])


def repeated(table: pa.Table) -> pa.Table:
    """Of one bucket, the positions whose hash occurs again, with the hash's rank in the bucket; rows of texts pass."""
    if table.num_rows == 0 or table["bucket"][0].as_py() < 0:
        return table
    pos = table["pos"].to_pylist()
    sizes = np.array([len(p) // 4 for p in pos])
    key = (gather(table["a"].to_pylist(), np.uint16).astype(U) << U(32)) | gather(table["b"].to_pylist(), np.uint32)
    order = np.argsort(key)
    first, count = runs(key[order])
    rank = np.empty(len(key), np.uint32)
    rank[order] = np.repeat(first, count)
    keep = np.empty(len(key), bool)
    keep[order] = np.repeat(count > 1, count)
    return split(table, keep, sizes, pos=gather(pos, np.uint32), a=rank)


def at_home(table: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """Sorted positions of one chunk with their names (bucket and rank in one number), and its rows of texts."""
    own = table.filter(pa.array(np.array(table["bucket"]) >= 0))
    pos = own["pos"].to_pylist()
    name = gather(own["a"].to_pylist(), np.uint32).astype(np.int64) | (np.repeat(np.array(own["bucket"], np.int64), [len(p) // 4 for p in pos]) << 32)
    pos = gather(pos, np.uint32).astype(np.int64)
    order = np.argsort(pos)
    return pos[order], name[order], table.filter(pa.array(np.array(table["bucket"]) < 0)).sort_by("first")


def by_bucket(chunk: int, name: np.ndarray, **values: np.ndarray) -> pa.Table:
    """Rows of one chunk for each bucket of the names; a takes the rank inside the bucket."""
    bucket = name >> 32
    order = np.argsort(bucket, kind="stable")
    first, count = runs(bucket[order])
    out = []
    for x, n in zip(first.tolist(), count.tolist()):
        mine = order[x : x + n]
        out.append({"chunk": chunk, "bucket": int(bucket[mine[0]]), "a": name[mine].astype(np.uint32).tobytes()} | {k: v[mine].tobytes() for k, v in values.items()})
    return pa.Table.from_batches([rows(out)])
