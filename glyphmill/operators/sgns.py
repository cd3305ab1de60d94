"""Skip-gram vectors with negative sampling: the single step, serial training, and training by partitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch, Shared

MOST, LONGEST = 16, 0.5
RANGE = 4096
LANES, ROOM, NEAR = 32, 64 << 20, 1 << 23  # a task trains so many runs side by side, of models of so many bytes and of so many contexts
MOVES = "side int, part int, ids binary, d binary"


def initial(vocab_size: int, dim: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices, uniform within half a unit over the dimension."""
    if vocab_size < 1 or dim < 1:
        raise ValueError("vocabulary and dimension must be positive")
    rng = np.random.default_rng(seed)
    return tuple(((rng.random((vocab_size, dim)) - 0.5) / dim).astype(np.float32) for _ in range(2))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


def pair_step(w_in: np.ndarray, w_out: np.ndarray, center: int, context: int, negatives, rate: float) -> None:
    """One pair with its negatives, in place: targets move one after another, the center at the end."""
    own, move = w_in[center], np.zeros_like(w_in[center])
    for target, label in [(context, 1.0), *((n, 0.0) for n in negatives)]:
        g = np.float32((label - sigmoid(float(own @ w_out[target]))) * rate)
        move += g * w_out[target]
        w_out[target] += g * own
    own += move


def corpus_pass(w_in, w_out, ids: np.ndarray, slots: np.ndarray, window: int, n_neg: int, rate: float, stop=lambda: False) -> bool:
    """All pairs in serial order; False if stopped before the end."""
    k = np.arange(1, n_neg + 1)
    for i in range(len(ids)):
        if stop():
            return False
        for j in range(max(0, i - window), min(len(ids), i + window + 1)):
            if j != i:
                pair_step(w_in, w_out, ids[i], ids[j], slots[(7 * (i + 1) + 13 * (j + 1) + 17 * k) % len(slots)], rate)
    return True


def slot_array(table: DataFrame) -> np.ndarray:
    """The slots as an array; `table` has a row a token."""
    rows = table.filter("n_slots > 0").orderBy("first_slot").toPandas()
    return np.repeat(rows["token_id"].to_numpy(np.int32), rows["n_slots"].to_numpy(np.int64))


def train_exact(tokens: DataFrame, table: DataFrame, vocab_size: int, dim: int = 100, window: int = 5, n_neg: int = 5, rate: float = 0.025, epochs: int = 5, seed: int = 1) -> DataFrame:
    """(id, w_in, w_out) by the serial order of pairs, in one task: for small streams and for comparison."""
    slots = slot_array(table)

    def run(pdf):
        import pandas as pd

        w_in, w_out = initial(vocab_size, dim, seed)
        ids = pdf.sort_values("pos")["token_id"].to_numpy()
        for _ in range(epochs):
            corpus_pass(w_in, w_out, ids, slots, window, n_neg, rate)
        return pd.DataFrame({"id": np.arange(vocab_size), "w_in": list(w_in), "w_out": list(w_out)})

    return tokens.select("pos", "token_id", F.lit(0).alias("one")).groupBy("one").applyInPandas(run, "id int, w_in array<float>, w_out array<float>")


def train(tokens: DataFrame, table: DataFrame, vocab_size: int, dim: int = 100, window: int = 5, n_neg: int = 5, rate: float = 0.025, epochs: int = 5, seed: int = 1, block: int = 1 << 16, stop=lambda: False, runs: int = 1024):
    """(w_in, w_out, losses): runs of positions train side by side, and an epoch's moves are averaged by use.

    The stream is cut into blocks of `block` positions, each with a margin of `window` on both sides
    for its contexts; at most `runs` runs take the blocks in turn, each on its own copy
    of the model.  A run sends the rows that it moved once, as bytes by ranges of rows, whatever
    its number of blocks.  Between epochs the model is on the driver, which it must fit, as
    it must fit every worker; `stop` is asked there.
    """
    spark, slots = tokens.sparkSession, slot_array(table)
    w_in, w_out = initial(vocab_size, dim, seed)
    pos = F.col("pos")
    last = tokens.agg(F.max("pos")).first()[0]
    runs = min(runs, (last or 0) // block + 1)
    homes = F.array_distinct(F.array(F.greatest(F.floor((pos - window) / block), F.lit(0)), F.floor(pos / block), F.least(F.floor((pos + window) / block), F.lit((last or 0) // block))))
    tasks = max(-(-runs // max(1, min(LANES, ROOM // (8 * vocab_size * dim), NEAR // (2 * window * block)))), min(runs, spark.sparkContext.defaultParallelism))
    placed = tokens.select("pos", "token_id", F.explode(homes).alias("block")).withColumn("run", F.col("block") % runs)
    placed = placed.withColumn("lane", (F.col("run") % tasks).cast("int")).withColumn("turn", F.floor(F.col("block") / runs))
    placed = Scratch(spark).table(placed, "blocks")
    losses: list[float] = []
    for _ in range(epochs):
        if stop():
            break
        shared = Shared(spark, (w_in, w_out, slots))
        ordered = placed.repartitionById(tasks, "lane").sortWithinPartitions("lane", "turn", "run", "block", "pos")
        moves = ordered.select("lane", "turn", "run", "block", "pos", "token_id").mapInArrow(_epoch(shared, block, window, n_neg, rate), MOVES)
        w_in, w_out, loss = w_in.copy(), w_out.copy(), 0.0
        for r in moves.groupBy("side", "part").applyInArrow(_average, MOVES).toLocalIterator():
            if r.side == 2:
                loss = float(np.frombuffer(r.d, np.float32).sum())
            else:
                (w_in, w_out)[r.side][np.frombuffer(r.ids, np.int32)] += np.frombuffer(r.d, np.float32).reshape(-1, dim)
        losses.append(loss)
    return w_in, w_out, losses


def _moves(items: list[tuple]) -> pa.RecordBatch:
    side, part, ids, d = zip(*items)
    return pa.RecordBatch.from_arrays([pa.array(side, pa.int32()), pa.array(part, pa.int32()), pa.array(ids, pa.binary()), pa.array(d, pa.binary())], names=["side", "part", "ids", "d"])


def _epoch(shared, block: int, window: int, n_neg: int, rate: float):
    """For each run: the moves of all rows that its pairs touch, by ranges of rows, and its loss as side 2.

    The runs of a lane train side by side, one block of each in a turn, on copies of the model that stand in a row.
    """

    def run(batches):
        now, held, models, losses = (None, None), {}, None, {}

        def train_turn():
            own = [tuple(np.concatenate(x) for x in zip(*v)) for v in held.values()]
            for r in held:
                losses.setdefault(r, 0.0)
            places = [places_of.setdefault(r, len(places_of)) for r in held]
            grow()
            found = _own_passes(*models, shared.value[0].shape[0], places, [(pos, ids, pos // block == pos_block) for (pos, ids), pos_block in zip(own, blocks.values())], shared.value[2], window, n_neg, rate)
            for r, x in zip(held, found):
                losses[r] += x

        def grow():
            nonlocal models
            n = len(shared.value[0])
            have = 0 if models is None else len(models[0]) // n
            if len(places_of) > have:
                more = [np.tile(w, (len(places_of) - have, 1)) for w in shared.value[:2]]
                models = more if models is None else [np.concatenate(x) for x in zip(models, more)]

        def finish():
            n = len(shared.value[0])
            for r, place in places_of.items():
                model = [w[place * n : (place + 1) * n] for w in models]
                out = [(2, 0, b"", np.array([losses[r]], np.float32).tobytes())]
                for side in (0, 1):
                    moved = np.flatnonzero((model[side] != shared.value[side]).any(axis=1)).astype(np.int32)
                    for x, m in zip(*(v.tolist() for v in _runs(moved // RANGE))):
                        rows = moved[x : x + m]
                        out.append((side, int(rows[0]) // RANGE, rows.tobytes(), (model[side][rows] - shared.value[side][rows]).tobytes()))
                yield _moves(out)

        places_of, blocks = {}, {}
        for batch in batches:
            columns = [batch.column(k).to_numpy() for k in range(6)]
            for x, n in zip(*(v.tolist() for v in _runs(*columns[:4]))):
                key = (int(columns[0][x]), int(columns[1][x]))
                if key != now:
                    if held:
                        train_turn()
                    if key[0] != now[0] and places_of:
                        yield from finish()
                        places_of, models, losses = {}, None, {}
                    now, held, blocks = key, {}, {}
                r = int(columns[2][x])
                blocks[r] = int(columns[3][x])
                held.setdefault(r, []).append((columns[4][x : x + n], columns[5][x : x + n]))
        if held:
            train_turn()
            yield from finish()

    return run


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of equal keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(new)))


def _average(part: pa.Table) -> pa.Table:
    """Of a range of rows, each row's moves averaged over the runs that moved it; of the losses the sum."""
    side, number = part["side"][0].as_py(), part["part"][0].as_py()
    blobs = list(zip(part["ids"].to_pylist(), part["d"].to_pylist()))
    if side == 2:
        total = np.array([sum(float(np.frombuffer(d, np.float32)[0]) for _, d in blobs)], np.float32)
        return pa.Table.from_batches([_moves([(2, 0, b"", total.tobytes())])])
    total, uses = None, np.zeros(RANGE, np.int64)
    for ids, d in blobs:
        rows = np.frombuffer(ids, np.int32) - number * RANGE
        values = np.frombuffer(d, np.float32).reshape(len(rows), -1)
        if total is None:
            total = np.zeros((RANGE, values.shape[1]))
        total[rows] += values
        uses[rows] += 1
    rows = np.flatnonzero(uses)
    return pa.Table.from_batches([_moves([(side, number, (rows + number * RANGE).astype(np.int32).tobytes(), (total[rows] / uses[rows, None]).astype(np.float32).tobytes())])])


def _own_pass(w_in, w_out, pos, ids, own, slots, window, n_neg, rate) -> float:
    """_own_passes of one run."""
    return _own_passes(w_in, w_out, len(w_in), [0], [(pos, ids, own)], slots, window, n_neg, rate)[0]


def _own_passes(w_in, w_out, n_rows, places, parts, slots, window, n_neg, rate) -> list[float]:
    """All pairs of runs by small batches, one of each run at a time, and each run's summed loss; margins only serve as contexts.

    w_in and w_out have the runs' models in a row, that of places[k] at places[k] * n_rows; parts: (pos, ids, own) of each run.
    A batch's pairs are scored with the same weights and their moves summed.  A row that a batch uses more than
    MOST times moves by that many average moves, and by at most LONGEST, as stale moves of a frequent token would
    carry it ever further.
    """
    k, offsets = np.arange(1, n_neg + 1), np.array([d for d in range(-window, window + 1) if d])
    batch = min(64, max(8, n_rows // 16))  # of few tokens each would move too often within a batch
    # batches never cross a chunk of 1 << 13 positions of their run
    mine = [[np.flatnonzero(own[a : a + (1 << 13)]) + a for a in range(0, len(pos), 1 << 13)] for pos, _, own in parts]
    steps = [[c[a : a + batch] for c in chunks for a in range(0, len(c), batch)] for chunks in mine]
    before = np.cumsum([0, *(len(pos) for pos, _, _ in parts)])
    everything = np.concatenate([pos for pos, _, _ in parts])
    tokens = np.concatenate([ids.astype(np.int64) + p * n_rows for (_, ids, _), p in zip(parts, places)])
    found = [np.searchsorted(pos, pos[:, None] + offsets) for pos, _, _ in parts]
    near = np.concatenate([np.minimum(f, len(pos) - 1) + b for f, (pos, _, _), b in zip(found, parts, before)])
    there = everything[near] == everything[:, None] + offsets
    base = np.concatenate([np.full(len(pos), p * n_rows, np.int64) for (pos, _, _), p in zip(parts, places)])
    of = np.concatenate([np.full(len(pos), x) for x, (pos, _, _) in enumerate(parts)])
    loss = np.zeros(len(parts))
    label = np.zeros(1 + n_neg, np.float32)
    label[0] = 1
    label = np.tile(label, len(offsets))
    for s in range(max(map(len, steps), default=0)):
        now = [x[s] + b for x, b in zip(steps, before) if s < len(x)]
        own = np.concatenate(now)
        want = everything[own][:, None] + offsets
        have = np.repeat(there[own], 1 + n_neg, axis=1)
        picks = slots[(7 * (everything[own][:, None, None] + 1) + 13 * (want[:, :, None] + 1) + 17 * k) % len(slots)] + base[own][:, None, None]
        targets = np.concatenate([tokens[near[own]][:, :, None], picks], axis=2).reshape(len(own), -1)
        centers = tokens[own]
        x, t = w_in[centers], w_out[targets]
        p = sigmoid((t @ x[:, :, None])[:, :, 0])
        lost = np.where(have, np.log(np.maximum(np.where(label == 1, p, 1 - p), 1e-9)), 0)
        loss -= np.bincount(of[own], lost.sum(axis=1), len(parts))
        g = np.where(have, (label - p) * np.float32(rate), 0).astype(np.float32)
        move = (g[:, None, :] @ t)[:, 0]
        _add_rows(w_out, targets.ravel(), (g[:, :, None] * x[:, None, :]).reshape(-1, x.shape[1]), have.ravel())
        _add_rows(w_in, centers, move)
    return loss.tolist()


def _add_rows(matrix: np.ndarray, rows: np.ndarray, values: np.ndarray, counted: np.ndarray | None = None) -> None:
    """matrix[rows] += values with repeated rows summed, as far as _bounded lets them; counted: which of them are uses."""
    order = np.argsort(rows, kind="stable")
    rows, values = rows[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    uses = np.diff(np.append(first, len(rows))) if counted is None else np.add.reduceat(counted[order].astype(np.int64), first)
    matrix[rows[first]] += _bounded(np.add.reduceat(values, first, axis=0), uses)


def _bounded(moves: np.ndarray, uses: np.ndarray) -> np.ndarray:
    moves = moves * np.minimum(1, MOST / np.maximum(uses, 1)).astype(np.float32)[:, None]
    return moves * np.minimum(1, LONGEST / np.maximum(np.linalg.norm(moves, axis=1), 1e-12)).astype(np.float32)[:, None]
