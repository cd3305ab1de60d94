"""Normalisation, pre-tokens, scripts and lines on literal cases, and against plain Python on random strings."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.functions import chars, text
from glyphmill.sources.text import read_html, read_text, text_lines
from glyphmill.streaming.text import pretoken_count_stream, read_text_stream, windowed_pretoken_counts

NORMAL = [
    ("  HELLO   'World'   你好…  ", "hello 'world' 你好..."), ("a–b—c", "a-b-c"), ("Ü北京 — PARIS — 東京", "ü北京 - paris - 東京"), ("“x” ‘y’", "\"x\" 'y'"), ("ÁÉÑ Σ", "ÁéÑ Σ"), ("a\u0085b\u2003c\u3000", "a b c"),
    ("ŁÓDŹ Œuvre", "łódź œuvre"), ("", ""), (" \t\n", ""), (None, None),
]
TOKENS = [("hello, world!", ["hello", ",", "world", "!"]), ("don't 'x'", ["don't", "'x'"]), ("hello你好world", ["hello", "你", "好", "world"]), ("", []), ("a-b €5。", ["a", "-", "b", "€5。"]), ("ひら 한국", ["ひら", "한국"])]


def values(spark, rows, turn):
    return [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "k int, v string").orderBy("k").select(turn(F.col("v"))).collect()]


def test_literal_cases(spark):
    assert values(spark, [a for a, _ in NORMAL], text.normalize) == [b for _, b in NORMAL]
    assert values(spark, [a for a, _ in TOKENS], text.pretokenize) == [b for _, b in TOKENS]


def test_scripts(spark):
    expected = {"中": "cjk", "\U00020000": "cjk", "한": "hangul", "あ": "hiragana", "ア": "katakana", "a": None, "é": None}
    for c, name in expected.items():
        row = spark.createDataFrame([(c,)], "v string").select(*[text.is_class(F.col("v"), k).alias(k) for k in chars.CLASSES]).first()
        assert {k for k in ("cjk", "hangul", "hiragana", "katakana") if row[k]} == ({name} if name else set())
        assert row["east_asian"] == (name is not None)


def python_class(ranges):
    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: "\\U" + m[1].zfill(8), ranges)


@given(st.lists(st.text(alphabet=st.sampled_from(list("aZ'.,-_ \t\u0085\u00a0\u2003你あ한é€¿ÄÑ“—…\U00020000")), max_size=30), min_size=1, max_size=30))
@settings(max_examples=8, deadline=None)
def test_random_strings_equal_plain_python(spark, rows):
    table = str.maketrans(chars.FROM, chars.TO)
    space = f"[{python_class(chars.WHITESPACE)}]+"

    def normal(s):
        return re.sub(space, " ", s.translate(table).replace("…", "...")).strip(" ")

    assert values(spark, rows, text.normalize) == [normal(r) for r in rows]
    assert values(spark, rows, text.pretokenize) == [re.findall(python_class(chars.PRETOKEN), r) for r in rows]
    once = [normal(r) for r in rows]
    assert values(spark, once, text.normalize) == once


@pytest.mark.parametrize("value,most,expected", [("a\rb\r\nc\n\nlast\r", 99, ["a\rb", "c", "", "last\r"]), ("", 9, []), ("x\n", 9, ["x"]), ("abcdef\nxy", 3, ["abc", "xy"]), ("éé", 3, ["é"]), ("a\U0001f600", 4, ["a"]), ("abc", 0, [""])])
def test_lines(spark, value, most, expected):
    df = spark.createDataFrame([(1, value)], "doc_id int, text string")
    assert [r.value for r in text_lines(df, most=most).orderBy("line_no").collect()] == expected


def test_files(spark, tmp_path):
    (tmp_path / "t.txt").write_bytes(b"one\r\ntwo\n\nbad \xff byte\n" + b"y" * 50)
    assert [r.value for r in read_text(spark, str(tmp_path / "t.txt"), 12).collect()] == ["one", "two", "", "bad \ufffd byte", "y" * 12]
    (tmp_path / "p.html").write_text("<p>A</p>\n<p>B</p>\n")
    assert [r.text for r in read_html(spark, str(tmp_path / "p.html")).collect()] == ["A B"]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("To be, or not\nto BE\n")
    query = pretoken_count_stream(read_text_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("pretokens").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {(r.tok, r.freq) for r in spark.table("pretokens").collect()} == {("to", 2), ("be", 2), (",", 1), ("or", 1), ("not", 1)}
    rows = spark.createDataFrame([("2024-01-01 00:01:00", "a b"), ("2024-01-01 00:02:00", "A"), ("2024-01-01 00:06:00", "a")], "t string, v string").withColumn("t", F.col("t").cast("timestamp"))
    got = {(r.window.start.minute, r.tok, r.freq) for r in windowed_pretoken_counts(rows, "t", "v").collect()}
    assert got == {(0, "a", 2), (0, "b", 1), (5, "a", 1)}


def test_class_counts_are_those_of_plain_python(spark):
    texts = ["a b\tc\u3000d", "漢字 ひらがな カタカナ 한글 \U00020000", "", None, "A-b! \u00a0", " "]
    spans = {k: re.compile("[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08X}", v) + "]") for k, v in chars.CLASSES.items()}
    each = {k: [len(p.findall(t)) for t in texts if t is not None] for k, p in spans.items()}
    want = sorted((k, sum(n > 0 for n in v), sum(v)) for k, v in each.items())
    assert sorted(map(tuple, text.class_counts(spark.createDataFrame([(t,) for t in texts], "text string")).collect())) == want
    assert sorted(map(tuple, text.class_counts(spark.createDataFrame([], "text string")).collect())) == sorted((k, 0, 0) for k in chars.CLASSES)
