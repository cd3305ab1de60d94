"""op3 against every window of every document for every item."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa

from glyphmill.llm import decontaminate as d
from glyphmill.llm.words import Words

from . import cases

ITEMS = [(1, cases.made(24, 50)), (2, cases.made(9, 51)), (3, "two words"), (4, None), (5, ""), (6, cases.made(24, 52)), (6, cases.made(24, 52)), (None, cases.made(12, 53)), (7, "Ana b, c; ana B c ana b c")]


def docs():
    item = ITEMS[0][1].split()
    near = list(item)
    near[3], near[15] = "other", "words"
    far = [w if k % 3 else f"q{k}" for k, w in enumerate(item)]
    return [
        (1, cases.made(40, 60) + " " + ITEMS[0][1] + " " + cases.made(10, 61)), (2, cases.made(5, 62) + " " + " ".join(near).upper()), (3, " ".join(far)), (4, ITEMS[1][1]),
        (5, None), (6, ""), (7, "?!"), (None, ITEMS[0][1]), (8, cases.made(3000, 63)), (8, ITEMS[5][1]), (8, ITEMS[5][1]), (9, ITEMS[7][1] + ". " + ITEMS[1][1]), (10, "ana b c ana b c ana b"), (11, " ".join(item[:18])),
    ]


def tokens(text):
    return re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text or "")


def bag(w):
    return Counter((tuple(x.lower() for x in w[i : i + 3]), sum(len(x.encode()) for x in w[i : i + 3])) for i in range(len(w) - 2))


def printed(w):
    text = Words(pa.array([" ".join(w)]), d.FOLD, d.LETTERS)
    h, weight = d.shingles(text)
    return d.fingerprints(h, weight, np.array([0]), np.array([len(w) - 2]))[0]


def brute(rows, items, threshold):
    out = Counter()
    own = {(k, t) for k, t in items if t is not None}
    for k, t in rows:
        w = tokens(t)
        for item, text in own:
            x = tokens(text)
            if len(x) < 3 or len(w) < 3:
                continue
            target, best = bag(x), None
            for i in range(max(1, len(w) - len(x) + 1)):
                window = w[i : i + len(x)]
                mine = bag(window)
                shared = sum(n * s[1] for s, n in (mine & target).items())
                value = shared / (sum(n * s[1] for s, n in mine.items()) + sum(n * s[1] for s, n in target.items()) - shared)
                if value >= threshold and np.bitwise_count(printed(window) ^ printed(x)) <= d.RADIUS and (best is None or value > best[2]):
                    best = (i, len(window), value)
            if best:
                out[k, item, best[0], best[1], round(best[2], 9)] += 1
    return out


def frames(spark):
    extra = [(k, t, "clash") for k, t in ITEMS]
    return cases.frame(spark, docs()), spark.createDataFrame(extra, "item_id long, text string, doc_id string")


def test_matches_equal_brute_force(spark):
    own, items = frames(spark)
    for threshold in (0.5, 0.8):
        got = d.matches(own, items, threshold).collect()
        assert Counter((*tuple(r)[:4], round(r.similarity, 9)) for r in got) == brute(docs(), ITEMS, threshold)


def test_verbatim_and_near_copies_go(spark):
    own, items = frames(spark)
    kept = Counter((r.doc_id, r.text) for r in d.drop_contaminated(own, items, 0.5).collect())
    hit = {(k, t) for k, t in docs() if brute([(k, t)], ITEMS, 0.5)}
    assert {k for k, _ in hit} >= {1, 2, 4, None, 8, 9, 10}
    assert kept == Counter(x for x in docs() if x not in hit)
    assert d.drop_contaminated(own, items).columns == own.columns


def test_blocks_miss_nothing_within_the_radius():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a = rng.integers(0, 256, 8, dtype=np.uint8)
        flips = np.zeros(64, np.uint8)
        flips[rng.choice(64, d.RADIUS, replace=False)] = 1
        b = a ^ np.packbits(flips)
        assert any(d._NEAR_VALUES[a[k], b[k]] for k in range(8))


def test_empty_tables(spark):
    own, items = frames(spark)
    assert d.matches(cases.empty(spark), items).collect() == [] and d.matches(own, items.limit(0)).collect() == []
    assert d.drop_contaminated(own, items.limit(0)).count() == len(docs())
    assert d.drop_contaminated(cases.empty(spark), items).collect() == []
