"""op5: gradients against differences, probabilities that sum to one, scores against one word at a time, learning."""

import numpy as np
import pytest

from glyphmill.llm import language_model as lm
from glyphmill.llm.blobs import texts

from . import cases


@pytest.fixture(scope="module")
def fitted(spark):
    own = texts(cases.frame(spark), "doc_id", "text")
    voc, counted, _ = lm.vocabulary(own)
    return own, voc, lm.train(own, voc), {np.uint64(r.word % (1 << 64)): r.n for r in counted.collect()}


def rough(seed=0):
    rng = np.random.default_rng(seed)
    voc = lm.Vocabulary(rng.integers(1, 1 << 60, 50).astype(np.uint64), rng.integers(1, 90, 50).astype(float), rng.integers(0, 9, lm.SLOTS).astype(float), 7)
    model = lm.Model.start(voc)
    return lm.Model(model.flat.astype(np.float64) + rng.normal(0, 0.2, len(model.flat))), voc


def test_gradient_equals_differences():
    model, _ = rough()
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, lm.VOCABULARY, (5, 3)), rng.integers(0, lm.VOCABULARY, (5, 3))
    live = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], bool)
    h = rng.normal(size=(3, lm.HIDDEN))
    loss, n, gradient, _ = model.window(x, y, live, h)
    assert n == live.sum()
    moving = np.flatnonzero(np.abs(gradient.flat) > 1e-4)
    for k in rng.choice(moving, 40, replace=False):
        up, down = lm.Model(model.flat.copy()), lm.Model(model.flat.copy())
        up.flat[k] += 1e-5
        down.flat[k] -= 1e-5
        slope = (up.window(x, y, live, h)[0] - down.window(x, y, live, h)[0]) / 2e-5
        assert abs(slope - gradient.flat[k]) < 1e-3 * max(1, abs(slope)), k


def test_class_and_word_probabilities_sum_to_one():
    model, _ = rough(2)
    h = np.random.default_rng(3).normal(size=(1, lm.HIDDEN))
    got = model.output(np.repeat(h, lm.VOCABULARY, axis=0), np.arange(lm.VOCABULARY))[0]
    assert abs(np.exp(got).sum() - 1) < 1e-9


def share(voc, counts, word):
    return 0.0 if voc.known(np.array([word]))[0] else float(voc.shares(np.array([word]), np.array([counts[word]]))[0])


def test_all_words_and_the_end_share_one_probability(fitted):
    _, voc, model, counts = fitted
    hashes = np.array(list(counts), np.uint64)
    ids = np.append(voc.encode(hashes), voc.end)
    shares = np.array([*[share(voc, counts, w) for w in hashes], 0.0])
    h = np.random.default_rng(4).normal(size=(1, lm.HIDDEN)).astype(np.float32)
    all_ids = np.exp(model.output(np.repeat(h, lm.VOCABULARY, axis=0), np.arange(lm.VOCABULARY))[0])
    used = np.unique(ids)
    assert abs(np.exp(model.output(np.repeat(h, len(ids), axis=0), ids)[0] + shares).sum() - all_ids[used].sum()) < 1e-3


def test_counts_are_those_of_all_words(fitted):
    counts = fitted[3]
    w = lm.Words(lm.pa.array([t for _, t in cases.documents()], lm.pa.string()))
    words, n = np.unique(w.hashes, return_counts=True)
    assert counts == dict(zip(words, n.tolist()))


def one_by_one(model, voc, ids):
    h, last, total = np.zeros((1, lm.HIDDEN), np.float32), lm.VOCABULARY, 0.0
    for y in [*ids.tolist(), voc.end]:
        h = model.step(model.E[[last]] @ model.W + model.b, h)[0]
        total += float(model.output(h, np.array([y]))[0][0])
        last = y
    return total


def test_scores_equal_one_word_at_a_time(fitted):
    _, voc, model, _ = fitted
    rows = [r for r in cases.documents(long=400) if r[0] != 10]
    w = lm.Words(lm.pa.array([t for _, t in rows], lm.pa.string()))
    ids = voc.encode(w.hashes)
    got = lm.log_likelihoods(model, voc, ids, w.first)
    slow = [one_by_one(model, voc, ids[a:b]) for a, b in zip(w.first[:-1], w.first[1:])]
    assert np.allclose(got, slow, rtol=1e-4, atol=1e-3)


def test_the_table_s_scores_are_ids_and_shares(spark, fitted, monkeypatch):
    own, voc, model, counts = fitted
    monkeypatch.setattr(lm, "vocabulary", lambda _: (voc, spark.createDataFrame([(int(np.int64(w)), n) for w, n in counts.items()], "word long, n long"), 3))
    monkeypatch.setattr(lm, "train", lambda *_: model)
    rows = cases.documents(long=400)
    expected = []
    for k, t in rows:
        w = lm.Words(lm.pa.array([t], lm.pa.string()))
        unseen = [x for x in w.hashes if x not in counts]
        if not unseen:
            expected.append((repr(k), one_by_one(model, voc, voc.encode(w.hashes)) + sum(share(voc, counts, x) for x in w.hashes)))
    got = sorted((repr(r.doc_id), r.log_likelihood) for r in lm.scores(cases.frame(spark, [r for r in rows if r[0] not in (10, 11)])).collect())
    expected = sorted(x for x in expected if x[0] not in ("10", "11"))
    assert [k for k, _ in got] == [k for k, _ in expected] and np.allclose([x for _, x in got], [x for _, x in expected], rtol=1e-4, atol=2e-3)


def test_every_row_is_scored_whole(spark):
    rows = cases.documents()
    got = lm.scores(cases.frame(spark, rows)).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.n_words) for r in got)) == sorted((k is None, k or 0, len(cases.words(t))) for k, t in rows)
    assert all(np.isfinite(r.log_likelihood) and r.log_likelihood < 0 and abs(np.exp(-r.log_likelihood / (r.n_words + 1)) - r.perplexity) < 1e-6 * r.perplexity for r in got)
    same = {round(r.log_likelihood, 3) for r in got if r.n_words == 0}
    assert len(same) == 1  # null, empty and blank texts end at once


def test_training_learns_what_follows_what(spark, monkeypatch):
    monkeypatch.setattr(lm, "BATCH", 4)  # small tables give few steps otherwise
    rng = np.random.default_rng(6)
    follow = {f"a{k}": f"b{k}" for k in range(12)}
    rows = [(n, " ".join(x for k in rng.integers(0, 12, 400) for x in (f"a{k}", follow[f"a{k}"]))) for n in range(240)]
    own = texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), "doc_id", "text")
    voc = lm.vocabulary(own)[0]
    w = lm.Words(lm.pa.array([rows[0][1]]))
    ids = voc.encode(w.hashes)
    before = lm.log_likelihoods(lm.Model.start(voc), voc, ids, w.first)[0]
    after = lm.log_likelihoods(lm.train(own, voc, rounds=3), voc, ids, w.first)[0]
    assert after / len(ids) > before / len(ids) + 0.5


def test_every_word_of_every_text_trains_the_model():
    voc = rough()[1]
    n = np.array([0, 1, 15, 16, 255, 4000, 40])
    first = np.concatenate([[0], np.cumsum(n)])
    ids = np.random.default_rng(7).integers(0, 100, first[-1])
    model = lm.Model.start(voc)
    adam, given = lm.Adam(len(model.flat), 0.01), []
    window = model.window
    model.window = lambda x, y, live, h: (given.append(y[live]), window(x, y, live, h))[1]
    assert lm.train_texts(model, adam, ids, first, voc.end) == n.sum() + len(n)
    expected = np.concatenate([ids, np.full(len(n), voc.end)])
    assert sorted(np.concatenate(given).tolist()) == sorted(expected.tolist())


def plain_window(model, x, y, live, h):
    """Loss of a window and last states, a step and an output at a time."""
    loss = 0.0
    for t in range(len(x)):
        new = model.step(model.E[x[t]] @ model.W + model.b, h)[0]
        h = np.where(live[t][:, None], new, h)
        loss -= model.output(h[live[t]], y[t][live[t]])[0].sum()
    return loss, h


def test_a_window_s_loss_and_states_are_those_of_single_steps():
    model, _ = rough(8)
    rng = np.random.default_rng(9)
    x, y, h = rng.integers(0, lm.VOCABULARY, (lm.WINDOW, 40)), rng.integers(0, lm.VOCABULARY, (lm.WINDOW, 40)), rng.normal(size=(40, lm.HIDDEN))
    live = np.arange(lm.WINDOW)[:, None] <= rng.integers(0, lm.WINDOW, 40)
    loss, _, _, last = model.window(x, y, live, h)
    expected, states = plain_window(model, x, y, live, h)
    assert abs(loss - expected) < 1e-9 * expected and np.allclose(last, states, atol=1e-12)


def test_logits_beyond_the_range_of_exponentials():
    model, _ = rough(10)
    model = lm.Model((model.flat * 60).astype(np.float32))
    h = np.full((1, lm.HIDDEN), 0.9, np.float32)
    got = model.output(np.repeat(h, lm.VOCABULARY, axis=0), np.arange(lm.VOCABULARY))[0]
    assert np.isfinite(got).all() and abs(np.exp(got.astype(float)).sum() - 1) < 1e-2


def test_texts_that_end_leave_their_places(monkeypatch):
    monkeypatch.setattr(lm, "BATCH", 4)
    voc, n = rough()[1], np.array([640, 20, 300, *[60] * 30])
    first = np.concatenate([[0], np.cumsum(n)])
    ids = np.random.default_rng(11).integers(0, 100, first[-1])
    model = lm.Model.start(voc)
    adam, sizes = lm.Adam(len(model.flat), 0.01), []
    window = model.window
    model.window = lambda x, y, live, h: (sizes.append(x.shape[1]), window(x, y, live, h))[1]
    assert lm.train_texts(model, adam, ids, first, voc.end) == n.sum() + len(n)
    assert sum(sizes) == (n // lm.WINDOW + 1).sum()  # all windows
    assert len(sizes) <= -(-sum(sizes) // 4) + 3  # and nearly all of them full


def test_words_of_all_parts_come_once_and_in_order():
    rng = np.random.default_rng(12)
    sizes = [rng.integers(0, 90, k) for k in (3, 0, 1, 40, 2, 25)]
    sizes[2][:] = 700
    texts_, parts = [], []
    for n in sizes:
        own = [rng.integers(0, 1000, k) for k in n]
        parts.append((np.concatenate([np.zeros(0, np.int64), *own]), np.concatenate([[0], np.cumsum(n)]).astype(np.int64)))
        texts_ += own
    seen = {k: [] for k in range(len(texts_))}
    before = np.zeros(0, np.int64)
    for text, kept, x, y, live in lm.windows(parts, -5, 8):
        assert (text[: len(kept)] == before[kept]).all() and all(not seen[k] for k in text[len(kept) :])
        for j, k in enumerate(text.tolist()):
            assert x[live[:, j], j].tolist() == [seen[k][-1] if seen[k] else lm.VOCABULARY, *y[live[:, j], j][:-1]]
            seen[k] += y[live[:, j], j].tolist()
        before = text
    assert all(seen[k] == [*t.tolist(), -5] for k, t in enumerate(texts_))


def test_a_long_text_s_rest_does_not_undo_what_was_learnt():
    rng, voc = np.random.default_rng(13), rough()[1]
    n = np.array([24000, *[40] * 600])
    first = np.concatenate([[0], np.cumsum(n)])
    ids = np.where(np.arange(first[-1]) < n[0], rng.integers(50, 90, first[-1]), rng.integers(0, 10, first[-1]))
    model = lm.Model.start(voc)
    lm.train_texts(model, lm.Adam(len(model.flat), 0.01), ids, first, voc.end)
    short = lm.log_likelihoods(model, voc, ids[n[0] :], first[1:] - n[0])
    assert short.sum() / (n[1:] + 1).sum() > np.log(1 / 90)


def counted_reads(spark, rows):
    """The rows as a table that counts how often one of them is read."""
    reads = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    return cases.frame(spark, rows).select("doc_id", "text").mapInArrow(run, "doc_id long, text string"), reads


def test_texts_are_read_once_for_all_rounds_and_the_scores(spark):
    rows = cases.documents(long=400)
    docs, reads = counted_reads(spark, rows)
    assert len(lm.scores(docs, rounds=3).collect()) == len(rows)
    assert reads.value <= 3 * len(rows)  # their bytes are summed, their words are counted, and they become ids


def test_the_rounds_read_whole_texts_as_ids(spark, fitted):
    own, voc, _, _ = fitted
    coded = lm.encoded(own, voc, 3)
    got = []
    for r in coded.filter("bucket = -1").collect():
        n = np.frombuffer(r.size, np.int64)
        first = np.concatenate([[0], np.cumsum(n)])
        ids = np.frombuffer(r.own, np.uint16).astype(np.int64)
        assert first[-1] == len(ids)
        got += [tuple(ids[a:b].tolist()) for a, b in zip(first[:-1], first[1:])]
    expected = [tuple(voc.encode(lm.Words(lm.pa.array([t], lm.pa.string())).hashes).tolist()) for _, t in cases.documents()]
    assert sorted(got) == sorted(expected)
    none = own.filter("1 = 0")
    given, made = lm.train(none, voc, 1, coded).flat, lm.train(own, voc, 1).flat
    assert np.allclose(given, made, atol=1e-3) and not np.allclose(given, lm.Model.start(voc).flat, atol=1e-3)


def test_gates_beyond_the_range_of_exponentials():
    model, _ = rough(14)
    model = lm.Model(model.flat.astype(np.float32))
    model.V *= 500
    model.W *= 500
    rng = np.random.default_rng(15)
    x, y, h = rng.integers(0, lm.VOCABULARY, (lm.WINDOW, 9)), rng.integers(0, lm.VOCABULARY, (lm.WINDOW, 9)), rng.normal(size=(9, lm.HIDDEN)).astype(np.float32)
    live = np.arange(lm.WINDOW)[:, None] <= rng.integers(0, lm.WINDOW, 9)
    with np.errstate(all="raise", under="ignore"):
        loss, _, gradient, last = model.window(x, y, live, h)
    with np.errstate(over="ignore"):
        expected, states = plain_window(model, x, y, live, h)
    assert abs(loss - expected) < 1e-3 * expected and np.allclose(last, states, atol=1e-3) and np.isfinite(gradient.flat).all()


def test_empty_table(spark):
    assert lm.scores(cases.empty(spark)).collect() == []
