"""op9: every byte once, windows within their tier, step groups balanced; the packing against a plain one."""

from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from glyphmill.llm import packing

from . import cases


def plain(lengths, tiers):
    """Quadratic best-fit decreasing by tiers, gaps filled from shorter tiers; (tier, lengths) of the windows."""
    left, out = sorted(lengths, reverse=True), []
    for tier in sorted(tiers, reverse=True):
        shorter = [t for t in tiers if t < tier]
        own = [n for n in left if n > max(shorter, default=0)]
        left = [n for n in left if n <= max(shorter, default=0)]
        windows = []
        for n in own:
            fits = [w for w in windows if tier - sum(w) >= n]
            if fits:
                min(fits, key=lambda w: (tier - sum(w), windows.index(w))).append(n)
            else:
                windows.append([n])
        for w in sorted((w for w in windows if sum(w) < tier), key=lambda w: (-(tier - sum(w)), windows.index(w))):
            for t in sorted(shorter, reverse=True):
                low = max((x for x in shorter if x < t), default=0)
                while fit := [n for n in left if low < n <= min(t, tier - sum(w))]:
                    w.append(max(fit))
                    left.remove(max(fit))
        out += [(tier, sorted(w)) for w in windows]
    return out


@given(st.lists(st.integers(1, 40), max_size=40))
@settings(max_examples=80, deadline=None)
def test_packing_equals_the_plain_one(lengths):
    got = packing.pack([(n, k) for k, n in enumerate(lengths)], (8, 20, 40))
    assert Counter((t, tuple(sorted(p[0] for p in w))) for t, w in got) == Counter((t, tuple(w)) for t, w in plain(lengths, (8, 20, 40)))


@given(st.lists(st.integers(1, 100), max_size=30), st.integers(1, 5))
@settings(max_examples=50, deadline=None)
def test_groups_are_full_and_balanced(costs, size):
    got = packing.groups(costs, size)
    count = Counter(got)
    assert all(n <= size for n in count.values()) and len(count) == -(-len(costs) // size) if costs else got == []


def test_every_document_is_packed_whole(spark):
    rows = cases.documents()
    got = packing.packed(cases.frame(spark, rows), tiers=(64, 512, 4096), step_bytes=8192).collect()
    pieces = defaultdict(list)
    for r in got:
        assert r.n_used == sum(r.lengths) <= r.tier and len(r.doc_ids) == len(r.starts) == len(r.lengths)
        for k, a, n in zip(r.doc_ids, r.starts, r.lengths):
            pieces[k].append((a, n))
    expected = Counter()
    for k, t in rows:
        if t:
            expected[k] += len(t.encode()) + 1
    assert {k: sum(n for _, n in p) for k, p in pieces.items()} == dict(expected)
    for k in (10, 11):  # cut into full windows of the longest tier
        at = 0
        for a, n in sorted(pieces[k]):
            assert a == at
            at += n
    per_group = Counter((r.shard, r.tier, r.step_group) for r in got)
    assert all(n * k[1] <= max(8192, k[1]) for k, n in per_group.items())


def test_empty_table(spark):
    assert packing.packed(cases.empty(spark)).collect() == []
    assert packing.packed(cases.frame(spark, [(1, None), (2, "")])).collect() == []
