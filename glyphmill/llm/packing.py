"""Hierarchical multi-length packing of documents into training windows.

Lengths are UTF-8 bytes plus one separator a document (a byte-level vocabulary).  A
document goes to the shortest tier that holds it; what exceeds the longest tier is cut
into full windows of it.  From the longest tier down each tier is packed best-fit
decreasing, then its gaps are filled with the longest pieces of shorter tiers that fit.
Windows of a tier then form step groups of equal token budget, balanced by attention
cost.  Only lengths are shuffled, to shards of about as many bytes and at most about as many pieces.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIERS = (4096, 16384, 65536)
STEP_BYTES = 262_144
SHARD_BYTES, SHARD_PIECES = 64 << 20, 250_000
PACKS = "shard long, tier long, pack long, step_group long, n_used long, doc_ids array<long>, starts array<long>, lengths array<long>"


def pack(pieces: list[tuple], tiers: tuple[int, ...]) -> list[tuple[int, list[tuple]]]:
    """(tier, pieces) of each window; a piece is (length, ...), and ties keep the given order."""
    order = sorted(range(len(pieces)), key=lambda k: (-pieces[k][0], k))
    pools: dict[int, list] = {t: [] for t in tiers}
    for k in order:
        pools[min(t for t in tiers if t >= pieces[k][0])].append(k)
    shorter = {t: [(pieces[k][0], -k) for k in reversed(pools[t])] for t in tiers}  # ascending
    out = []
    for tier in sorted(tiers, reverse=True):
        free: list[tuple[int, int]] = []  # (room, window) ascending
        windows: list[list[int]] = []
        for n, minus in reversed(shorter.pop(tier)):
            at = bisect_left(free, (n, -1))
            if at < len(free):
                room, w = free.pop(at)
            else:
                room, w = tier, len(windows)
                windows.append([])
            windows[w].append(-minus)
            if room > n:
                insort(free, (room - n, w))
        for room, w in sorted(free, key=lambda x: (-x[0], x[1])):
            for t in sorted(shorter, reverse=True):
                while room and shorter[t] and shorter[t][0][0] <= room:
                    n, minus = shorter[t].pop(bisect_right(shorter[t], (room, 1)) - 1)
                    windows[w].append(-minus)
                    room -= n
        out += [(tier, [pieces[k] for k in w]) for w in windows]
    return out


def groups(costs: list[int], size: int) -> list[int]:
    """The group of each window: groups of `size` windows of balanced total cost, the costliest first to the lightest."""
    n = -(-len(costs) // size)
    load = [(0, 0, g) for g in range(n)]
    out = [0] * len(costs)
    for k in sorted(range(len(costs)), key=lambda k: (-costs[k], k)):
        total, have, g = heapq.heappop(load)
        out[k] = g
        if have + 1 < size:
            heapq.heappush(load, (total + costs[k], have + 1, g))
    return out


def _shard(tiers, step_bytes):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("length", "ascending")])
        pieces = list(zip(table["length"].to_pylist(), table["doc_id"].to_pylist(), table["start"].to_pylist()))
        windows = pack(pieces, tiers)
        by_tier: dict[int, list[int]] = {}
        for k, (tier, _) in enumerate(windows):
            by_tier.setdefault(tier, []).append(k)
        group = [0] * len(windows)
        for tier, own in by_tier.items():
            for k, g in zip(own, groups([sum(p[0] ** 2 for p in windows[k][1]) for k in own], max(1, step_bytes // tier))):
                group[k] = g
        return pa.table(
            {
                "shard": pa.array([table["shard"][0].as_py()] * len(windows), pa.int64()),
                "tier": pa.array([t for t, _ in windows], pa.int64()),
                "pack": pa.array(np.arange(len(windows))),
                "step_group": pa.array(group, pa.int64()),
                "n_used": pa.array([sum(p[0] for p in w) for _, w in windows], pa.int64()),
                "doc_ids": pa.array([[p[1] for p in w] for _, w in windows], pa.list_(pa.int64())),
                "starts": pa.array([[p[2] for p in w] for _, w in windows], pa.list_(pa.int64())),
                "lengths": pa.array([[p[0] for p in w] for _, w in windows], pa.list_(pa.int64())),
            }
        )

    return run


def packed(docs: DataFrame, tiers: tuple[int, ...] = TIERS, step_bytes: int = STEP_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each window: shard, tier, pack (its number in the shard), step_group (of its shard and tier), bytes used, pieces.

    doc_ids, starts and lengths list the pieces: bytes start ... start + length of the
    document followed by one separator.  Every document is in the windows once, whole.

    A null or empty text isn't packed.  A null doc_id is packed as null.  Repeated rows
    are packed once each.  Other columns are ignored; an empty table gives no windows.
    """
    if not tiers or min(tiers) < 1:
        raise ValueError("tiers must be positive")
    tiers, most = tuple(sorted(tiers)), max(tiers)
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.octet_length(F.col(f"`{text_col}`").cast("string")).cast("long").alias("n")).filter("n > 0").withColumn("n", F.expr("n + 1"))
    total, count = own.agg(F.sum("n"), F.count("*")).first()
    total = total or 0
    shards = max(1, -(-total // SHARD_BYTES), -(-(count + total // most) // SHARD_PIECES))
    cut = own.withColumn("start", F.explode(F.expr(f"sequence(0L, n - 1, {most}L)"))).select("doc_id", "start", F.expr(f"least(n - start, {most}L)").alias("length"))
    sharded = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "length"), F.lit(shards)))
    return sharded.groupBy("shard").applyInArrow(_shard(tiers, step_bytes), PACKS)
