"""Byte pairs: literal cases, a quadratic trainer and encoder, round trips and files."""

import struct
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.operators import bpe
from glyphmill.sources import store

WORDS = st.lists(st.text(alphabet="abcé你", min_size=1, max_size=8), max_size=12)


def merge(seq, left, right, to):
    out, i = [], 0
    while i < len(seq):
        if seq[i : i + 2] == [left, right]:
            out.append(to)
            i += 2
        else:
            out.append(seq[i])
            i += 1
    return out


def slow_train(counts, target):
    seqs, v = {w: list(w) for w in counts}, bpe.Vocabulary()
    for c in sorted({c for w in counts for c in w}):
        v.add(c)
    while len(v) < target:
        pairs = Counter()
        for w, n in counts.items():
            for p in zip(seqs[w], seqs[w][1:]):
                pairs[p] += n
        if not pairs:
            break
        left, right = min(pairs, key=lambda p: (-pairs[p], p))
        v.add_rule(left, right)
        seqs = {w: merge(s, left, right, left + right) for w, s in seqs.items()}
    return v


def slow_encode(v, word):
    seq = [v.id_of(c) for c in word]
    for left, right, to in v.rules:
        seq = merge(seq, left, right, to)
    return seq


@given(WORDS, st.integers(4, 30))
@settings(max_examples=150, deadline=None)
def test_training_and_encoding_equal_the_slow_ones(words, target):
    counts = Counter(words)
    v, slow = bpe.train_words(sorted(counts), [counts[w] for w in sorted(counts)], target), slow_train(counts, target)
    assert (v.tokens, v.rules) == (slow.tokens, slow.rules)
    encoder = bpe.Encoder(v)
    for w in [*words, "zab", "aaaa"]:
        assert encoder.encode(w) == slow_encode(v, w)
    for w in words:
        assert "".join(v.tokens[i] for i in encoder.encode(w)) == w


def test_an_earlier_rule_is_not_revisited():
    v = bpe.Vocabulary([*bpe.SPECIALS, "a", "b", "ab", "aab"], [(4, 6, 7), (4, 5, 6)])
    assert bpe.Encoder(v).encode("aab") == slow_encode(v, "aab") == [4, 6]


def test_known_vocabularies():
    assert len(bpe.train_words([], [], 100)) == 4 and len(bpe.train_words(["a", "b", "c"], [1, 1, 1], 10)) == 7
    v = bpe.train_words(["aab", "aac"], [3, 1], 20)
    assert "aa" in v and v.id_of("nope") == 0 and v.add("aa") == v.ids["aa"]


def test_distributed_training(spark):
    rows = [("low lower lowest newest widest low",), ("new newer low! don't",), (None,), ("",)]
    counts = bpe.pretoken_counts(bpe.pretokens(spark.createDataFrame(rows, "text string")))
    plain = {r.tok: r.freq for r in counts.collect()}
    assert plain["low"] == 3 and "" not in plain
    slow = slow_train(plain, 40)
    assert (lambda v: (v.tokens, v.rules))(bpe.train(counts, 40)) == (slow.tokens, slow.rules)
    frames = bpe.train_by_frames(counts, 10, every=3)
    assert [(a, b) for a, b, _ in frames] == [(slow.tokens[a], slow.tokens[b]) for a, b, _ in slow.rules[:10]]
    assert len(bpe.train(counts.limit(0), 40)) == 4 and bpe.train_by_frames(counts.limit(0), 3) == []


def test_columns(spark):
    v = slow_train(Counter({"hello": 3, "help": 2, "world": 1}), 24)
    df = spark.createDataFrame([("hello",), ("help",), ("xhel",), ("w",), (None,)], "tok string")
    got = df.select("tok", bpe.encode_column(F.col("tok"), spark, v).alias("ids"), bpe.encode_native(F.col("tok"), v).alias("tokens")).collect()
    for r in got:
        if r.tok is not None:
            assert list(r.ids) == slow_encode(v, r.tok) and list(r.tokens) == [v.tokens[i] for i in r.ids]
    texts = spark.createDataFrame([(1, "Hello help"), (2, None), (3, "")], "doc_id int, text string")
    coded = {r.doc_id: r.ids for r in bpe.encode_texts(texts, v).collect()}
    assert coded == {1: slow_encode(v, "hello") + slow_encode(v, "help"), 2: [], 3: []}
    ids = spark.createDataFrame([(1, [0, 999]), (2, []), (3, slow_encode(v, "hello")), (4, [-1])], "k int, ids array<int>")
    assert {r.k: r.text for r in bpe.decode(ids, v).collect()} == {1: "[UNK][UNK]", 2: "", 3: "hello", 4: "[UNK]"}


def test_files(spark, tmp_path):
    v = slow_train(Counter({"你好": 2, "hello": 3}), 20)
    store.save_vocabulary(v, str(tmp_path / "v"))
    assert (tmp_path / "v").read_bytes()[:8] == b"BPE\0" + struct.pack("<I", 1)
    back = store.load_vocabulary(str(tmp_path / "v"))
    store.write_vocabulary(spark, v, str(tmp_path / "table"))
    again = store.read_vocabulary(spark, str(tmp_path / "table"))
    assert (back.tokens, back.rules) == (again.tokens, again.rules) == (v.tokens, v.rules)
    data = store.dump_vocabulary(v)
    for bad in (b"XXXX" + data[4:], data[:4] + struct.pack("<I", 2) + data[8:], data[:-3], data[:30], b"", data[:16] + struct.pack("<I", 9 << 20) + data[20:]):
        with pytest.raises(store.FormatError):
            store.parse_vocabulary(bad)


def test_merge_loop_in_parts_equals_the_slow_one(spark):
    import random

    rng = random.Random(5)
    counts = {"".join(rng.choice("abcé你\U00020000\0") for _ in range(rng.randint(1, 12))): rng.randint(1, 9) for _ in range(300)} | {"a" * 30: 50, "abab" * 5: 40}
    frame = spark.createDataFrame(list(counts.items()), "tok string, freq long")
    v, slow = bpe.train(frame, 150, part_chars=700), slow_train(counts, 150)  # three or four tasks
    assert (v.tokens, v.rules) == (slow.tokens, slow.rules)


def test_merge_loop_takes_many_words_quickly():
    import random
    import time

    rng = random.Random(6)
    words = sorted({"".join(rng.choices("etaoinshrdlucmfgypwb", range(20, 0, -1), k=rng.randint(4, 14))) for _ in range(150_000)})
    began = time.process_time()
    assert len(bpe.train_words(words, [1] * len(words), 1500)) == 1500
    assert time.process_time() - began < 20


def test_counts_of_raw_texts_are_those_of_normalised_ones(spark):
    texts = ["  HELLO…… ‘x’ “Y”—z　a\u0085B ", "ÄÖ北京Ÿ don't‛s a–b", "Σ… Ñ\U00020000x\x00y", "", None, "a  b\tc\nD Á"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(bpe.text_counts(frame)) == rows(bpe.pretoken_counts(bpe.pretokens(frame)))


def test_texts_are_encoded_as_they_stand(spark):
    v = bpe.train_words(["hello", "'x'", ".", "-", '"'], [9, 2, 1, 1, 1], 20)
    texts = ["HELLO… ‘X’—“hello”", "a ÄÖ…", None]
    got = bpe.encode_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), v)
    assert "translate" not in got._jdf.queryExecution().optimizedPlan().toString()
    encode = bpe.Encoder(v).encode
    words = [["hello", ".", ".", ".", "'x'", "-", '"', "hello", '"'], ["a", "äö", ".", ".", "."], []]
    assert {r.doc_id: r.ids for r in got.collect()} == {k: [i for w in ws for i in encode(w)] for k, ws in enumerate(words)}
