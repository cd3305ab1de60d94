"""op1 and op7 against every window and every substring."""

from collections import Counter, defaultdict

from glyphmill.llm import suffix_array, suffix_tree

from . import cases


def brute_spans(rows, threshold):
    texts = [(k, cases.words(t)) for k, t in rows]
    where = defaultdict(list)
    for n, (k, w) in enumerate(texts):
        for i in range(len(w) - threshold + 1):
            where[tuple(w[i : i + threshold])].append(((k is None, k or 0), i, n))
    marks = defaultdict(dict)
    for found in where.values():
        if len(found) > 1:
            for nth, (_, i, n) in enumerate(sorted(found)):
                marks[n][i] = nth > 0
    out = Counter()
    for n, own in marks.items():
        for i in sorted(own):
            if i - 1 in own:
                continue
            j = i
            while j in own:
                j += 1
            out[texts[n][0], i, j - i + threshold - 1, sum(own[x] for x in range(i, j))] += 1
    return out


def brute_repeats(rows, threshold):
    texts = [(k, cases.words(t)) for k, t in rows]
    longest = max(len(w) for _, w in texts)
    known = {}
    for n in range(threshold, longest + 2):
        known[n] = Counter(tuple(w[i : i + n]) for _, w in texts for i in range(len(w) - n + 1))
        if not any(c > 1 for c in known[n].values()):
            break
    out = Counter()
    for k, w in texts:
        for i in range(len(w) - threshold + 1):
            n = threshold - 1
            while i + n + 1 <= len(w) and known.get(n + 1, {}).get(tuple(w[i : i + n + 1]), 0) > 1:
                n += 1
            if n < threshold:
                continue
            if i and known.get(n + 1, {}).get(tuple(w[i - 1 : i + n]), 0) > 1:
                continue
            out[k, i, n, known[n][tuple(w[i : i + n])]] += 1
    return out


def small():
    rows = [r for r in cases.documents(long=300)]
    again = "a b a b a b a c a b a b"
    return [*rows, (30, " ".join([again] * 9)), (31, "z " + " ".join([again] * 7) + " q")]


def test_spans_equal_brute_force(spark):
    for threshold in (8, 20, 50):
        got = suffix_array.repeated_spans(cases.frame(spark, small()), threshold).collect()
        assert Counter(tuple(r) for r in got) == brute_spans(small(), threshold)


def test_spans_at_odd_thresholds(spark):
    rows = small()[:8]
    for threshold in (1, 3, 9):
        got = suffix_array.repeated_spans(cases.frame(spark, rows), threshold).collect()
        assert Counter(tuple(r) for r in got) == brute_spans(rows, threshold)


def test_repeats_equal_brute_force(spark):
    for threshold in (10, 50):
        got = suffix_tree.maximal_repeats(cases.frame(spark, small()), threshold).collect()
        assert Counter(tuple(r)[:4] for r in got) == brute_repeats(small(), threshold)


def brute_all(rows, threshold):
    """Rows of all substrings that occur again and that different words, or none, precede and follow."""
    texts = [(k, cases.words(t)) for k, t in rows]
    out = Counter()
    for n in range(threshold, max(len(w) for _, w in texts) + 1):
        found = defaultdict(list)
        for number, (_, w) in enumerate(texts):
            for i in range(len(w) - n + 1):
                found[tuple(w[i : i + n])].append((number, i))
        found = [f for f in found.values() if len(f) > 1]
        if not found:
            break
        for places in found:
            left = {texts[d][1][i - 1] if i else (d, "start") for d, i in places}
            right = {texts[d][1][i + n] if i + n < len(texts[d][1]) else (d, "end") for d, i in places}
            if len(left) > 1 and len(right) > 1:
                out.update((texts[d][0], i, n, len(places)) for d, i in places)
    return out


def spelled_out(rows):
    """All occurrences of all repeats, by the links from each repeat to the next shorter one."""
    known = {r.repeat_id: (r.n_words, r.n_copies, r.prefix_id) for r in rows}
    assert all(known[r.repeat_id] == (r.n_words, r.n_copies, r.prefix_id) for r in rows)
    out, ids = Counter(), Counter()
    for r in rows:
        k = r.repeat_id if r.longest else None
        while k is not None:
            out[r.doc_id, r.start_word, *known[k][:2]] += 1
            ids[k] += 1
            k = known[k][2]
    assert ids == {k: n for k, (_, n, _) in known.items()}
    return out


def test_a_passage_inside_repeats_is_given(spark):
    p = cases.made(60, 70)
    a, b = (f"{cases.made(30, 71 + k)} {p} {cases.made(30, 81 + k)}" for k in (0, 1))
    rows = [(1, a), (2, a), (3, b), (4, b)]
    got = Counter(tuple(r)[:4] for r in suffix_tree.all_maximal_repeats(cases.frame(spark, rows), 50).collect())
    assert got == Counter([(1, 0, 120, 2), (2, 0, 120, 2), (3, 0, 120, 2), (4, 0, 120, 2), *((k, 30, 60, 4) for k in (1, 2, 3, 4))])


def test_all_repeats_equal_brute_force(spark):
    for threshold in (10, 50):
        got = suffix_tree.all_maximal_repeats(cases.frame(spark, small()), threshold).collect()
        assert spelled_out(got) == brute_all(small(), threshold)


def test_occurrences_of_a_passage_share_an_id(spark):
    rows = small()
    got = suffix_tree.maximal_repeats(cases.frame(spark, rows), 50).collect()
    texts, by = defaultdict(set), defaultdict(set)
    for k, t in rows:
        by[k].add(t)
    for r in got:
        possible = {" ".join(cases.words(t)[r.start_word : r.start_word + r.n_words]) for t in by[r.doc_id]}
        texts[r.repeat_id] = texts[r.repeat_id] & possible if r.repeat_id in texts else possible
    assert texts and all(texts.values())


def test_empty_table(spark):
    assert suffix_array.repeated_spans(cases.empty(spark), 50).collect() == []
    assert suffix_tree.maximal_repeats(cases.empty(spark), 50).collect() == []
    nothing = cases.frame(spark, [(1, None), (2, ""), (None, "a b")])
    assert suffix_array.repeated_spans(nothing, 50).collect() == [] and suffix_tree.maximal_repeats(nothing, 50).collect() == []
