"""op8: the linear-time score against all pairs, held-out accuracy, and awkward rows."""

import random

import numpy as np

from glyphmill.llm import quality as q

from . import cases

GOOD, BAD, TOXIC = (("river mountain letter evening garden window story history people music".split()), ("click buy cheap offer $$$ win free now !!! deal".split()), ("idiot scum hate vermin filth trash loser stupid".split()))


def made(n, seed):
    rng, docs, labels = random.Random(seed), [], []
    for k in range(n):
        kind = k % 4
        w = [rng.choice(GOOD) for _ in range(rng.randint(20, 60))]
        if kind == 1:
            w = [rng.choice(BAD + GOOD[:3]) for _ in w]
        if kind == 2:
            for j in range(0, len(w), 9):
                w[j] = rng.choice(TOXIC)
        docs.append((k, " ".join(w)))
        if k % 2 or k % 4 == 2 or k % 8 == 0:
            labels.append((k, 0 if kind == 1 else 1, 1 if kind == 2 else 0))
    return docs, labels


def labelled(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, quality int, toxic int, text string")


def test_score_equals_all_pairs():
    rng = np.random.default_rng(0)
    m = q.Machine(0.3, rng.normal(size=q.SIZE), rng.normal(size=(q.SIZE, q.FACTORS)))
    for n in (0, 1, 7):
        x = rng.choice(q.SIZE, n, replace=False)
        slow = 0.3 + m.w[x].sum() + sum(m.v[a] @ m.v[b] for i, a in enumerate(x) for b in x[:i])
        assert abs(m.score(np.zeros(n, int), x, 1)[0] - slow) < 1e-9


def test_held_out_documents_are_told_apart(spark):
    docs, labels = made(900, 1)
    train = [r for r in labels if r[0] < 600]
    kept = {r.doc_id for r in q.keep_good(cases.frame(spark, docs), labelled(spark, train)).collect()}
    test = [(k, k % 4) for k in range(600, 900)]
    clean, bad, toxic = ([k for k, kind in test if kind in kinds] for kinds in ((0, 3), (1,), (2,)))
    assert np.mean([k in kept for k in clean]) > 0.97 and np.mean([k in kept for k in bad]) < 0.05 and np.mean([k in kept for k in toxic]) < 0.1


def test_awkward_rows(spark):
    docs, labels = made(400, 2)
    docs = [*docs, (1000, None), (1001, ""), (1002, " ?! "), (None, docs[0][1]), (0, docs[0][1]), (1003, " ".join(GOOD * 4000))]
    labels = [*labels, (None, 1, 0), (5, None, None), (77777, 0, 1), labels[0]]
    frame = cases.frame(spark, docs)
    got = q.keep_good(frame, labelled(spark, labels))
    assert got.columns == frame.columns
    rows = got.collect()
    assert not {1000, 1001, 1002} & {r.doc_id for r in rows}
    assert {tuple(r) for r in rows} <= {tuple(r) for r in frame.collect()}
    assert sum(r.doc_id == 0 for r in rows) in (0, 2)
    scored = q.scores(frame, labelled(spark, labels))
    assert scored.columns == ["doc_id", "low_quality", "toxicity"] and scored.count() == len(rows)


def test_without_labels_nothing_with_words_is_rejected(spark):
    frame = cases.frame(spark, [(1, "some words"), (2, None), (3, "more")])
    assert {r.doc_id for r in q.keep_good(frame, labelled(spark, [])).collect()} == {1, 3}
    assert q.keep_good(cases.empty(spark), labelled(spark, [(1, 1, 0)])).collect() == []
    plain = spark.createDataFrame([(1, "no other columns")], "doc_id long, text string")
    assert q.keep_good(plain, labelled(spark, [(1, 1, 0)])).count() == 1
