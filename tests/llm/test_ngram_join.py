"""op10 against all pairs of gram sets."""

import random

import numpy as np
import pytest

from glyphmill.llm import ngram_join

from . import cases


def grams(text, n):
    w = cases.words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, least):
    own = sorted({(k, t) for k, t in rows if k is not None and t is not None and grams(t, n)})
    out = set()
    for i, (a, x) in enumerate(own):
        for b, y in own[:i]:
            p, q = grams(x, n), grams(y, n)
            if a != b and len(p & q) / len(p | q) >= least:
                out.add((min(a, b), max(a, b), len(p & q), round(len(p & q) / len(p | q), 9)))
    return out


def varied():
    base = cases.made(60, 9).split()
    rows = list(cases.documents(long=400))
    for k in range(25):  # a family at every distance
        w = list(base)
        for j in range(k):
            w[(j * 7) % 60] = f"n{k}_{j}"
        rows.append((100 + k, " ".join(w)))
    return rows


def linked(rows, n, least):
    """(doc_id, class, links) of each distinct document, from all pairs of them."""
    own = sorted({(k, t) for k, t in rows if k is not None}, key=repr)
    sets, parent, links = [grams(t, n) for _, t in own], list(range(len(own))), [0] * len(own)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(own)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= least:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    lowest = {}
    for i, (k, _) in enumerate(own):
        lowest[root(i)] = min(k, lowest.get(root(i), k))
    return sorted((k, lowest[root(i)], links[i]) for i, (k, _) in enumerate(own))


def test_classes_and_links_equal_brute_force(spark):
    for n, least in ((3, 0.5), (1, 0.8), (5, 0.3)):
        got = ngram_join.linked_documents(cases.frame(spark, varied()), n, least).collect()
        assert sorted(tuple(r) for r in got) == linked(varied(), n, least)


def crossed(seed=5):
    """Families, passages of half a text that tie them together, and copies."""
    rng = random.Random(seed)
    parts = [cases.made(30, 500 + k).split() for k in range(12)]
    rows = []
    for k in range(160):
        w = [x for p in rng.sample(range(12), rng.choice([1, 2, 2, 3])) for x in parts[p]]
        for _ in range(rng.choice([0, 0, 1, 3])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(50)}"
        rows.append((1000 + k, " ".join(w)))
    return rows + [(2000 + k, rows[k % 7][1]) for k in range(30)]


@pytest.mark.parametrize("unit, rounds, few", [(4096, 2, 16), (4096, 0, 3), (12, 2, 2), (2, 1, 5)])
def test_units_of_every_size_lose_no_link(spark, monkeypatch, unit, rounds, few):
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "UNIT", unit)
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    got = ngram_join.linked_documents(cases.frame(spark, crossed()), 3, 0.5).collect()
    assert sorted(tuple(r) for r in got) == linked(crossed(), 3, 0.5)


def test_overlaps_of_all_and_of_two_blocks(monkeypatch):
    monkeypatch.setattr(ngram_join, "FRAGMENT", 7)
    rng = np.random.default_rng(2)
    ids = [rng.choice(90, rng.integers(0, 40), replace=False).astype(np.int64) for _ in range(25)]
    expected = np.array([[len(np.intersect1d(a, b)) for b in ids] for a in ids])
    whole = ngram_join.overlaps(ids, 25)
    np.fill_diagonal(whole, 0), np.fill_diagonal(expected, 0)
    assert (whole == expected).all() and (ngram_join.overlaps(ids, 9) == expected[:9, 9:]).all()


def test_one_document_of_each_group_stays(spark):
    rows = varied()
    got = ngram_join.drop_near_duplicates(cases.frame(spark, rows), 3, 0.5)
    assert got.columns == cases.frame(spark, rows).columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    parent = {k: k for k, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, *_ in brute(rows, 3, 0.5):
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    other = [(6, cases.made(15, 61))]  # the second text of a doc_id, in no group
    expected = sorted([(k, t) for k, t in rows if k is not None and root(k) == k] + other, key=repr)
    assert sorted([x for x in kept if x[0] is not None], key=repr) == expected
    assert sorted((x for x in kept if x[0] is None), key=repr) == sorted(((k, t) for k, t in rows if k is None), key=repr)


def test_other_columns_stay(spark):
    docs = cases.frame(spark, [(1, "a b c d"), (2, "a b c d"), (3, None), (None, "a b c d")])
    got = {tuple(r) for r in ngram_join.drop_near_duplicates(docs).collect()}
    assert got == {tuple(r) for r in docs.collect() if r.doc_id != 2}


def test_empty_table(spark):
    assert ngram_join.linked_documents(cases.empty(spark)).collect() == []
    assert ngram_join.drop_near_duplicates(cases.empty(spark)).collect() == []
