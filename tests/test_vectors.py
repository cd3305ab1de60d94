"""Skip-grams, negative samples, training and vector queries against plain loops; the commands end to end."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill import cli
from glyphmill.functions import arrays
from glyphmill.operators import sgns, skipgram, vectors
from glyphmill.sources import store


def slots_by_loop(counts, size):
    p = np.array(counts, float) ** 0.75
    cum, out, w = np.cumsum(p), [], 0
    for i in range(size):
        if i == 0 or cum[-1] == 0:
            out.append(0)
            continue
        while cum[w] < i / size * cum[-1] and w < len(counts) - 1:
            w += 1
        out.append(w)
    return out


@pytest.mark.parametrize("counts,size", [([5, 0, 3, 9, 1], 101), ([0, 0, 7], 7), ([0, 4, 0], 50), (list(range(40)), 1000)])
def test_negative_table(spark, counts, size):
    frame = spark.createDataFrame([(k, n) for k, n in enumerate(counts)], "token_id int, n long")
    rows = {r.slot: r.token_id for r in skipgram.expand_slots(skipgram.negative_table(frame, size)).collect()}
    assert [rows[k] for k in range(size)] == slots_by_loop(counts, size)


def test_positions_are_dense_and_in_order(spark):
    rows = [(k, [k * 10 + j for j in range(k % 4)]) for k in range(30)]
    got = skipgram.positions(spark.createDataFrame(rows, "doc_id long, ids array<int>").repartition(5)).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(len(got))) and [r.token_id for r in got] == [x for _, ids in rows for x in ids]


@pytest.mark.parametrize("within", [False, True])
def test_pairs(spark, monkeypatch, within):
    monkeypatch.setattr(skipgram, "BLOCK", 16)
    tokens = [(p, p % 7, p // 9) for p in range(100)]
    got = skipgram.skipgram_pairs(spark.createDataFrame(tokens, "pos long, token_id int, doc_id long"), 3, within).collect()
    slow = [(i, j, a, b) for i, a, d in tokens for j, b, e in tokens if i != j and abs(i - j) <= 3 and (d == e or not within)]
    assert sorted(map(tuple, got)) == sorted(slow)


def test_negative_samples(spark):
    counts = spark.createDataFrame([(0, 1), (1, 5), (2, 9)], "token_id int, n long")
    pairs = spark.createDataFrame([(0, 1, 5, 6), (3, 2, 6, 5)], "i long, j long, center int, context int")
    got = skipgram.negative_samples(pairs, skipgram.negative_table(counts, 97), 4, 97).collect()
    table = slots_by_loop([1, 5, 9], 97)
    assert {(r.i, r.k): r.neg_id for r in got} == {(i, k): table[(7 * (i + 1) + 13 * (j + 1) + 17 * k) % 97] for i, j in ((0, 1), (3, 2)) for k in range(1, 5)}


def test_pair_step():
    w_in, w_out = np.array([[1.0, 0.0], [0.5, 0.5]], np.float32), np.array([[0.2, 0.1], [0.3, -0.4]], np.float32)
    a, b = w_in.copy(), w_out.copy()
    sgns.pair_step(w_in, w_out, 0, 1, [0, 0], 0.1)
    x, move = a[0].copy(), np.zeros(2)
    for t, label in ((1, 1), (0, 0), (0, 0)):
        g = (label - 1 / (1 + np.exp(-(x @ b[t])))) * 0.1
        move += g * b[t]
        b[t] = b[t] + g * x
    assert np.allclose(w_out, b, atol=1e-6) and np.allclose(w_in[0], a[0] + move, atol=1e-6) and np.array_equal(w_in[1], a[1])


def stream(spark, n=4000):
    ids = [(p, (p // 2 % 5) * 2 + p % 2) for p in range(n)]
    return spark.createDataFrame([(p, t, 0) for p, t in ids], "pos long, token_id int, doc_id long")


def test_training(spark):
    tokens = stream(spark)
    table = skipgram.negative_table(skipgram.unigram_counts(tokens, 10), 101)
    w_in, w_out, losses = sgns.train(tokens, table, 10, dim=8, window=1, n_neg=2, epochs=4, rate=0.05, block=512)
    assert len(losses) == 4 and losses[-1] < 0.97 * losses[0] and np.isfinite(w_in).all()
    same = sgns.train(tokens, table, 10, dim=8, window=1, n_neg=2, epochs=1, rate=0.05, block=512)
    again = sgns.train(tokens.repartition(7), table, 10, dim=8, window=1, n_neg=2, epochs=1, rate=0.05, block=512)
    assert np.allclose(same[0], again[0], atol=1e-5) and sgns.train(tokens, table, 10, dim=4, epochs=3, stop=lambda: True)[2] == []


def test_training_stays_finite_on_a_skewed_stream(spark):
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.2, 20_000) - 1, 65_535)
    w_in, w_out = sgns.initial(65_536, 100)
    p = np.bincount(ids, minlength=65_536) ** 0.75
    slots = rng.choice(65_536, 100_003, p=p / p.sum()).astype(np.int32)
    losses = [sgns._own_pass(w_in, w_out, np.arange(len(ids)), ids, np.ones(len(ids), bool), slots, 5, 5, 0.025) for _ in range(2)]
    assert np.isfinite(w_in).all() and np.isfinite(w_out).all() and losses[1] < losses[0]
    assert max(np.linalg.norm(w_in, axis=1).max(), np.linalg.norm(w_out, axis=1).max()) < 50


def test_training_in_runs_moves_each_row_once_a_run(spark):
    tokens = stream(spark)
    table = skipgram.negative_table(skipgram.unigram_counts(tokens, 10), 101)
    w_in, _, losses = sgns.train(tokens, table, 10, dim=8, window=1, n_neg=2, epochs=3, rate=0.05, block=512, runs=2)
    assert np.isfinite(w_in).all() and losses[-1] < losses[0]


def test_models_and_vocabularies_in_other_file_systems(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    store.save_model(f"file://{tmp_path}/m", x, -x, 1, 0.5)
    assert np.array_equal(store.load_model(f"file://{tmp_path}/m")[1], -x)
    store.write_model(store.model_frame(spark, x, -x), f"{tmp_path}/table")
    assert [list(r.w_out) for r in store.read_model(spark, f"{tmp_path}/table").orderBy("id").collect()] == (-x).tolist()
    with pytest.raises(FileNotFoundError):
        store.load_model(f"file://{tmp_path}/none")


def test_options_take_the_next_argument_verbatim(spark, tmp_path, capsys):
    assert cli._verbatim(["similar", "--word", "-x", "--topk=3"]) == ["similar", "--word=-x", "--topk=3"]
    assert cli.main(["similar", "--model", str(tmp_path / "none"), "--word", "-x"], spark) == 1 and "Error" in capsys.readouterr().err


def test_workers_need_no_copy_of_the_package(tmp_path):
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"import sys; sys.path.insert(0, {root!r})\nfrom pyspark.sql import SparkSession\nfrom glyphmill import catalog\nspark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\nprint('ROWS', catalog.QUERIES['corpus_token_ids'](spark, '/root/testdata/sf0.001').count(), catalog.QUERIES['sgns_train'](spark, '/root/testdata/sf0.001').count())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS" in done.stdout, done.stderr[-2000:]


def test_bench_rate(spark):
    import bench

    assert bench.words_per_second(spark, "/root/testdata/sf0.001") > 0


def test_exact_training_is_the_serial_loop(spark):
    tokens = stream(spark, 120)
    table = skipgram.negative_table(skipgram.unigram_counts(tokens, 10), 101)
    got = sgns.train_exact(tokens, table, 10, dim=4, window=2, n_neg=2, epochs=2).orderBy("id").collect()
    w_in, w_out = sgns.initial(10, 4)
    ids = np.array([(p // 2 % 5) * 2 + p % 2 for p in range(120)])
    for _ in range(2):
        assert sgns.corpus_pass(w_in, w_out, ids, sgns.slot_array(table), 2, 2, 0.025)
    assert np.allclose([r.w_in for r in got], w_in, atol=1e-6) and np.allclose([r.w_out for r in got], w_out, atol=1e-6)
    assert not sgns.corpus_pass(w_in, w_out, ids, sgns.slot_array(table), 2, 2, 0.025, stop=lambda: True)


def test_vector_queries(spark):
    x = np.random.default_rng(0).normal(size=(40, 6)).astype(np.float32)
    x[7] = 0
    x[9] = x[8]
    frame = store.model_frame(spark, x, x)
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def best(q, without, k):
        s = u @ (q / np.linalg.norm(q))
        return sorted((i for i in range(40) if i not in without), key=lambda i: (-round(float(s[i]), 5), i))[:k]

    assert [r.id for r in vectors.similar(frame, 3, 5).collect()] == best(x[3], {3}, 5)
    assert [r.id for r in vectors.similar(frame, 8, 1).collect()] == [9]
    terms = [(1, 1.0), (2, -1.0), (3, 1.0), (1, 1.0)]
    assert [r.id for r in vectors.analogy(frame, terms, 5).collect()] == best(2 * x[1] - x[2] + x[3], {1, 2, 3}, 5)
    assert {r.similarity for r in vectors.similar(frame, 7, 5).collect()} == {0.0}
    assert vectors.parse_analogy("king - man + woman -x") == [("king", 1.0), ("man", -1.0), ("woman", 1.0), ("-x", 1.0)]


def test_arrays(spark):
    row = spark.createDataFrame([([1.0, 2.0, 3.0], [0.5, 0.0, -1.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = row.select(arrays.array_sum(a), arrays.array_scale(a, 2.5), arrays.dot(a, b), arrays.axpy(F.lit(2.0), a, b), arrays.sigmoid(F.lit(99.0)), arrays.array_sum(F.array().cast("array<double>"))).first()
    assert list(got) == [6.0, [2.5, 5.0, 7.5], -2.5, [2.5, 4.0, 5.0], 1 / (1 + np.exp(-20)), 0.0]


def test_model_files(tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    store.save_model(str(tmp_path / "m"), x, -x, 42, 0.01)
    w_in, w_out, epoch, rate = store.load_model(str(tmp_path / "m"))
    assert np.array_equal(w_in, x) and np.array_equal(w_out, -x) and epoch == 42 and rate == pytest.approx(0.01)
    data = (tmp_path / "m").read_bytes()
    for bad in (b"NOPE" + data[4:], data[:50], b""):
        with pytest.raises(store.FormatError):
            store.parse_model(bad)


def test_commands(spark, tmp_path, capsys):
    source, model = str(tmp_path / "c.txt"), str(tmp_path / "m")
    (tmp_path / "c.txt").write_text("the cat sat on the mat\nthe dog sat on the log\n" * 40)
    run = lambda *a: (cli.main(list(a), spark), capsys.readouterr())
    code, out = run("bpe-train", "--input", source, "--output", str(tmp_path / "v"), "--vocab-size", "20")
    assert code == 0 and "Vocabulary size: 20" in out.out
    code, out = run("bpe-encode", "--vocab", str(tmp_path / "v"), "--text", "The cat zat!")
    assert code == 0 and "'the' -> [" in out.out and "tokens" in out.out
    code, out = run("train", "--input", source, "--output", model, "--vocab-size", "40", "--dim", "8", "--epochs", "1")
    assert code == 0 and (tmp_path / "m.vocab").exists()
    assert "Embedding for 'the' (dim=8)" in run("embed", "--model", model, "--word", "the")[1].out
    assert len(run("similar", "--model", model, "--word", "the", "--topk", "4")[1].out.splitlines()) == 5
    assert "Results:" in run("analogy", "--model", model, "--query", "the - t + a")[1].out
    assert "Merge rules" in run("info", "--vocab", str(tmp_path / "v"))[1].out and "Dimension: 8" in run("info", model)[1].out
    code, out = run("similar", "--model", model, "--word", "absent-word")
    assert code == 1 and "not in vocabulary" in out.err
    assert run("info", str(tmp_path / "none"))[0] == 1 and run("nonsense")[0] == 0 and run()[0] == 0


def test_runs_side_by_side_move_as_each_alone():
    rng, n = np.random.default_rng(4), 40
    slots = rng.integers(0, n, 101).astype(np.int32)
    parts = []
    for r, size in enumerate((300, 1024, 77)):
        pos = np.arange(max(0, r * 1024 - 2), r * 1024 + size)
        parts.append((pos, rng.integers(0, n, len(pos)).astype(np.int32), pos // 1024 == r))
    start = sgns.initial(n, 6)
    together = [np.tile(w, (3, 1)) for w in start]
    losses = sgns._own_passes(*together, n, [2, 0, 1], parts, slots, 2, 2, 0.05)
    for place, part, loss in zip([2, 0, 1], parts, losses):
        alone = [w.copy() for w in start]
        assert sgns._own_pass(*alone, *part, slots, 2, 2, 0.05) == pytest.approx(loss)
        for side in (0, 1):
            assert np.allclose(together[side][place * n : (place + 1) * n], alone[side], atol=1e-5)
