"""op4 against brute force."""

import numpy as np

from glyphmill.llm import one_bit_search as o


def clustered(n, d, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, d))
    return (centres[rng.integers(0, 8, n)] + rng.normal(size=(n, d)) * 0.7).astype(np.float32)


def exact(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return np.argsort(-s, axis=1, kind="stable")[:, :k], s


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in row], "clash", 1) for i, row in zip(ids, x)], "vec_id long, embedding array<float>, id string, cluster int").repartition(4)


def test_recall_over_all_queries(spark, monkeypatch):
    x = clustered(1500, 48)
    monkeypatch.setattr(o, "BLOCK", 256)
    near, s = exact(x, 10)
    monkeypatch.setattr(o, "QUERIES", 200)
    got = o.neighbours(frame(spark, x), 10, every=1).collect()
    assert len(got) == 15_000 and sorted({r.vec_id for r in got}) == list(range(1500))
    mine = {}
    for r in got:
        assert abs(s[r.vec_id, r.neighbour_id] - r.similarity) < 1e-4
        mine.setdefault(r.vec_id, {})[r.rank] = r.neighbour_id
    assert all(sorted(v) == list(range(1, 11)) for v in mine.values())
    hits = sum(len(set(v.values()) & set(near[k].tolist())) for k, v in mine.items())
    assert hits / 15_000 > 0.95


def test_bounds_hold_for_nearly_all_pairs():
    x = clustered(400, 64, 3)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centre, turn = x.mean(axis=0), o.rotation(64)
    low = o.Codes(x, centre, turn).bounds(x, centre, turn, 2.5)
    true = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert (low <= true + 1e-4).mean() > 0.985


def test_awkward_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [1.0]), (7, [float("nan"), 1.0]), (None, [1.0, 0.0]), (8, [0.0, 1.0]), (8, [0.0, 1.0]), (9, [2.0, 0.0]), (10, [None, 1.0]), (11, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.vec_id, r.rank): r.neighbour_id for r in o.neighbours(df, 3, every=1).collect()}
    assert {k for k, _ in got} == {1, 2, 8, 9}
    assert got[1, 1] == 9 and got[9, 1] == 1 and [got[8, k] for k in (1, 2, 3)] == [2, 1, 9]  # ties to the lower id


def test_few_and_equal_vectors(spark):
    assert o.neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    assert o.neighbours(frame(spark, np.ones((1, 4)))).collect() == []
    got = o.neighbours(frame(spark, np.ones((40, 4))), 5, every=1).collect()
    assert {(r.vec_id, r.rank, r.neighbour_id) for r in got} == {(q, k + 1, n) for q in range(40) for k, n in enumerate([i for i in range(40) if i != q][:5])}


def test_queries_against_all_vectors_of_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    near, s = exact(np.array([r.embedding for r in rows], np.float32), 10)
    got = o.neighbours(df).collect()
    assert len(got) == 10 * len(range(0, len(rows), 20)) and all(r.vec_id % 20 == 0 for r in got)
    assert sum(r.neighbour_id in near[r.vec_id] for r in got) / len(got) > 0.95


def test_a_third_of_equal_vectors(spark):
    x = clustered(900, 16, 4)
    x[::3] = x[0]
    got = {(r.vec_id, r.rank): r.neighbour_id for r in o.neighbours(frame(spark, x), 5, every=30).collect()}
    assert len(got) == 30 * 5
    assert all([got[q, k] for k in range(1, 6)] == [i for i in range(0, 21, 3) if i != q][:5] for q in range(0, 900, 30))
