"""HTML and wiki markup on literal cases."""

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import html, wiki
from glyphmill.sources import wiki as dumps

PAGES = [
    ("<p>Hi</p><script>alert('bad')</script><p>Bye</p>", "Hi Bye"), ("&#x4F60;&#X597D;", "你好"), ("&#20320;&#22909;", "你好"), ("Hello <unclosed", "Hello <unclosed"), ("<>Content</>", "Content"), ("A<!-- x\ny -->B", "AB"),
    ("A<!-->B-->C", "AB-->C"), ("<script/>x", "x"), ("<SCRIPT>x</Script>y", "y"), ("a<style>b", "a"), ("<p>A</p>B", "AB"), ("<pre-x>a</pre-x>b", "ab"), ("x<pre-x>y", "x y"), ("&lt;div&gt; &amp;lt;", "<div> &lt;"), ("&nbsp;", ""),
    ("AT&T &unknown; &amp no", "AT&T &unknown; &amp no"), ("&#xD800; &#1114112;", "&#xD800; &#1114112;"), ("5 > 3 a<b", "5 > 3 a<b"), ("<img alt='a>b'>", "b'>"), ("<ul><li>One</li><li>Two</li></ul>", "One Two"), ("", ""), (None, None),
    ("<svg><circle/></svg>c", "c"), ("Line1<br/>Line2\n\n x", "Line1 Line2 x"), ("&#+65;&hellip;&euro;", "A…€"),
]
MARKS = [
    ("[[Target|Display]] [[Plain]] [[Category:X]][[File:a.png]]", "Display Plain"), ("{{nested {{inner}}}}", ""), ("=== Sub ===\ntext", "Sub \ntext"), ("text<ref name=\"x\"/>more", "textmore"), ("a<ref>b</ref>c", "ac"), ("a<ref b", "a b"),
    ("'''bold''' and ''it'' don't", "bold and it don't"), ("x {| a |} y", "x  y"), ("a<!-- c -->b <!-- open", "ab <!-- open"), ("open {{ rest", "open"), ("[[a|b|c]] [[open|end", "c end"), ("a = b\nc == d", "a = b\nc  d"), ("x =\ny", "x \ny"), ("", ""),
    ("[[File:x|[[y]] z]]", "[[y]] z"), ("<ref/> keep </ref> end", "end"), ("{ | [ = '", "{ | [ = '"),
]


def test_html(spark):
    df = spark.createDataFrame([(k, v) for k, (v, _) in enumerate(PAGES)], "k int, v string").orderBy("k")
    assert [r[0] for r in df.select(html.strip_html(F.col("v"))).collect()] == [x for _, x in PAGES]


def test_entities(spark):
    df = spark.createDataFrame([("&amp;&lt;p&gt; <b> &no; &#65;&",)], "v string")
    assert df.select(html.decode_entities(F.col("v"))).first()[0] == "&<p> <b> &no; A&"


@pytest.mark.parametrize("value,expected", MARKS)
def test_wikitext(value, expected):
    assert wiki.strip(value) == expected


def test_wikitext_column(spark):
    df = spark.createDataFrame([(k, v) for k, (v, _) in enumerate([*MARKS, (None, None)])], "k int, v string").orderBy("k")
    assert [r[0] for r in df.select(wiki.strip_wikitext(F.col("v"))).collect()] == [*[x for _, x in MARKS], None]


def test_single_line_tags(spark):
    df = spark.createDataFrame([("<title>A b</title>",), ("<title></title>",), ("<title>x",), ("none",)], "v string")
    assert [r[0] for r in df.select(wiki.single_line_tag(F.col("v"), "title")).collect()] == ["A b", None, None, None]


DUMP = """<mediawiki>
<page>
 <title>A &amp; B</title>
 <ns>0</ns>
 <text>first ''line''
   second [[x|y]]
 </text>
</page>
<page>
 <title>
 Split
 </title>
 <ns>1</ns>
 <text xml:space="preserve">hidden</text>
</page>
<page><title>C</title>
<ns>zero</ns>
<text>one</text></page>
</mediawiki>
"""


def test_articles(spark, tmp_path):
    (tmp_path / "dump.xml").write_text(DUMP * 3)
    got = dumps.read_articles(spark, str(tmp_path / "dump.xml"), main_only=False).collect()
    assert [tuple(r) for r in got] == [("A &amp; B", 0, "first line\nsecond y"), ("Split", 1, ""), ("", 0, "one")] * 3
    main = dumps.read_articles(spark, str(tmp_path / "dump.xml")).collect()
    assert [r.namespace for r in main] == [0, 0] * 3
    full = dumps.read_articles(spark, str(tmp_path / "dump.xml"), main_only=False, compat=False).collect()
    assert [(r.title.strip(), r.text) for r in full[:3]] == [("A & B", "first line\n   second y"), ("Split", "hidden"), ("C", "one")]


def test_stripping_a_batch_keeps_few_texts_in_memory():
    import tracemalloc

    import pyarrow as pa

    from glyphmill.functions import wiki

    texts = pa.array([None, *["'''a''' [[b|c]] " * 1000] * 1500], pa.string())
    tracemalloc.start()
    out = wiki._strip(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20
    assert out[0].as_py() is None and out[1500].as_py() == ("a c " * 1000).strip() and len(out) == 1501
