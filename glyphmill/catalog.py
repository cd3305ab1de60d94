"""The registered queries of the engine's own operators and the SQL that gives the same rows.

Text queries read the whole table and a few literal rows that hold the characters which
the tables lack.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import arrays, chars, html, text, wiki
from .operators import bpe, sgns, skipgram, vectors
from .sources import store
from .sources.text import text_lines as lines_of
from .sources.wiki import parse_articles

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

LITERALS = [
    (-1, "  HELLO   'World'   你好…  Ünï–CODE　ÁÉÑ"), (-2, "Ü北京 — PARIS — 東京 “quoted” ‘single’ 한국어 ひらがな カタカナ"), (-3, "don't can't stop!? a-b_c €5 ¿qué? Σ Ж"),
    (-4, "one\r\ntwo\n\nthree\rstill three\n"), (-5, ""), (-6, "𠀀𪜀x y\u0085z ŁÓDŹ ŒUVRE"),
]
MARKUP = [
    (-1, "<p>Hi</p><script>alert('bad')</script><p>Bye</p>"), (-2, "&#x4F60;&#X597D; &#20320;&#22909; &unknown; AT&T &amp;lt; &#xD800; &#+65;"), (-3, "Hello <unclosed &lt;b&gt;"), (-4, "<>Content</><!--> A <!-- x --> B <DIV a='1'>C</DIV>D"),
    (-5, "<script />kept<style>gone"), (-6, "<pre-x>a</pre-x>b<svg><circle/></svg>c &nbsp;&hellip;"),
]
WINDOW, N_NEG, SLOTS, DIM_RATE = 2, 2, 1009, 0.05
CHARS = "abcdefghijklmnopqrstuvwxyz0123456789'.,:;!?-()äöüßéèàçñáíóú"
MERGES = "t+h th+e i+n e+r a+n o+n r+e e+n e+s i+s d+e l+e o+u a+t s+t n+d an+d in+g e+d o+r c+h t+i ti+on l+l er+s q+u d+er u+n".split()


def fixed_vocabulary() -> bpe.Vocabulary:
    """The vocabulary of the encoding queries."""
    v = bpe.Vocabulary()
    for c in CHARS:
        v.add(c)
    for m in MERGES:
        v.add_rule(*m.split("+"))
    return v


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_text(value: str) -> str:
    """A literal without control characters."""
    parts, run = [], ""
    for c in value:
        if ord(c) < 32:
            parts += [_quoted(run), f"chr({ord(c)})"]
            run = ""
        else:
            run += c
    return " || ".join([*parts, _quoted(run)])


def _with(rows, table, id_, col) -> str:
    return f"SELECT {id_}, {col} FROM {table} UNION ALL SELECT * FROM (VALUES {', '.join(f'({k}, {_sql_text(v)})' for k, v in rows)}) AS v({id_}, {col})"


_DOCS, _PAGES = _with(LITERALS, "documents", "doc_id", "text"), _with(MARKUP, "pages", "page_id", "html")
_SQL_NORMAL = f"trim(regexp_replace(replace(translate(text, {_quoted(chars.FROM)}, {_quoted(chars.TO)}), '{chars.ELLIPSIS}', '...'), {_quoted('[' + chars.WHITESPACE + ']+')}, ' ', 'g'))"
_SQL_TOKENS = f"regexp_extract_all({_SQL_NORMAL}, {_quoted(chars.PRETOKEN)})"
_SQL_FREQ = f"SELECT tok, count(*) AS freq FROM (SELECT unnest({_SQL_TOKENS}) AS tok FROM corpus) WHERE tok <> '' GROUP BY tok"


def _add(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def _table(spark, sf_dir, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(LITERALS, "doc_id long, text string"))


def _pages(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", "html").unionByName(spark.createDataFrame(MARKUP, "page_id long, html string"))


def _counts(spark, sf_dir) -> DataFrame:
    return bpe.text_counts(_docs(spark, sf_dir))


# text


@_add("normalize_text", f"WITH corpus AS ({_DOCS}) SELECT doc_id, {_SQL_NORMAL} AS normal FROM corpus")
def normalize_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.normalize(F.col("text")).alias("normal"))


@_add("pretoken_freq", f"WITH corpus AS ({_DOCS}) {_SQL_FREQ}")
def pretoken_freq(spark, sf_dir):
    return _counts(spark, sf_dir)


@_add("pretoken_topk", f"WITH corpus AS ({_DOCS}) SELECT * FROM ({_SQL_FREQ}) ORDER BY freq DESC, tok LIMIT 20")
def pretoken_topk(spark, sf_dir):
    return _counts(spark, sf_dir).orderBy(F.desc("freq"), "tok").limit(20)


@_add(
    "script_class_counts",
    f"WITH corpus AS ({_DOCS}) "
    + " UNION ALL ".join(f"SELECT '{k}' AS class, count(*) FILTER (n > 0) AS n_texts, coalesce(sum(n), 0)::BIGINT AS n_chars FROM (SELECT length(regexp_replace(text, {_quoted('[^' + v + ']')}, '', 'g')) AS n FROM corpus)" for k, v in chars.CLASSES.items()),
)
def script_class_counts(spark, sf_dir):
    return text.class_counts(_docs(spark, sf_dir))


@_add(
    "text_lines",
    f"""WITH corpus AS ({_DOCS}), parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM corpus WHERE text IS NOT NULL),
each AS (SELECT doc_id, unnest(p) AS v, generate_subscripts(p, 1) AS k, len(p) AS n FROM parts)
SELECT doc_id, (k - 1)::INTEGER AS line_no, CASE WHEN k < n AND ends_with(v, chr(13)) THEN left(v, length(v) - 1) ELSE v END AS value
FROM each WHERE k < n OR v <> ''""",
)
def text_lines(spark, sf_dir):
    return lines_of(_docs(spark, sf_dir))


# pages

_SQL_NAMES = "MAP {" + ", ".join(f"{_quoted(f'&{k};')}: {_quoted(v)}" for k, v in html.NAMED.items()) + "}"
_SQL_NUMBER = r"""coalesce(try_cast(nullif(regexp_extract(p, '^&#\+?([0-9]{1,10});$', 1), '') AS BIGINT), try_cast('0x' || nullif(regexp_extract(p, '^&#[xX]\+?([0-9A-Fa-f]{1,9});$', 1), '') AS BIGINT))"""
_SQL_ENTITY = rf"""CASE WHEN {_SQL_NAMES}[p] IS NOT NULL THEN {_SQL_NAMES}[p]
 WHEN {_SQL_NUMBER} BETWEEN 0 AND 55295 OR {_SQL_NUMBER} BETWEEN 57344 AND 1114111 THEN chr(({_SQL_NUMBER})::INTEGER) ELSE p END"""


@_add(
    "strip_html",
    rf"""WITH corpus AS ({_PAGES})
SELECT page_id, trim(regexp_replace(array_to_string(list_transform(regexp_extract_all(html, {_quoted(html.PIECE)}),
 lambda p: CASE WHEN regexp_matches(p, {_quoted(html.BLOCK)}) THEN ' ' WHEN regexp_matches(p, '\A<[\s\S]+\z') THEN '' WHEN regexp_matches(p, '\A&[\s\S]+;\z') THEN {_SQL_ENTITY} ELSE p END), ''),
 {_quoted('[' + chars.WHITESPACE + ']+')}, ' ', 'g')) AS text FROM corpus""",
)
def strip_html(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", html.strip_html(F.col("html")).alias("text"))


@_add(
    "decode_entities",
    rf"""WITH corpus AS ({_PAGES})
SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, {_quoted(html.ENTITY + '|[^&]+|&')}),
 lambda p: CASE WHEN regexp_matches(p, '\A&[\s\S]+;\z') THEN {_SQL_ENTITY} ELSE p END), '') AS text FROM corpus""",
)
def decode_entities(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", html.decode_entities(F.col("html")).alias("text"))


WIKI = """<mediawiki>
 <page>
  <title>Alpha</title>
  <ns>0</ns>
  <text>'''Alpha''' is the [[Letter|first letter]] of [[Greek]].{{cite|{{nested}}}}
== Use ==
It has<ref name="a">x</ref> many [[Category:Letters]]uses.
{| class="t"
| cell
|}
<!-- note -->End.</text>
 </page>
 <page>
  <title>Talk:Alpha</title>
  <ns>1</ns>
  <text>Not in the main namespace.</text>
 </page>
 <page>
  <title>Beta</title>
  <ns>x</ns>
  <text>One line with <ref/> a mark.</text>
 </page>
</mediawiki>
"""


def _chunks(spark, sf_dir):
    """The literal dump, and every page of the table as an article."""
    fixed = spark.createDataFrame([(c,) for c in WIKI.split("</page>")], "value string")
    own = _table(spark, sf_dir, "pages").select(F.concat(F.lit("<page>\n<title>"), F.col("url"), F.lit("</title>\n<ns>0</ns>\n<text>"), F.regexp_replace("html", "</?(text|page)[^>]*>", " "), F.lit("</text>\n")).alias("value"))
    return fixed.unionByName(own)


@_add("wiki_articles")
def wiki_articles(spark, sf_dir):
    return parse_articles(_chunks(spark, sf_dir))


@_add("strip_wikitext")
def strip_wikitext(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", wiki.strip_wikitext(F.col("html")).alias("text"))


# byte pairs

_K = 4


def _sql_train(k: int) -> str:
    """k merges, one after another, each a table of its own."""
    ctes = [f"corpus AS ({_DOCS})", f"freq AS MATERIALIZED ({_SQL_FREQ})", "w0 AS MATERIALIZED (SELECT freq, ' ' || array_to_string(regexp_extract_all(tok, '[\\s\\S]'), '  ') || ' ' AS s FROM freq)"]
    for i in range(k):
        ctes.append(
            f"b{i} AS MATERIALIZED (SELECT l, r, sum(freq)::BIGINT AS cnt FROM (SELECT freq, unnest(list_zip(a[1:len(a) - 1], a[2:])) AS p, p[1] AS l, p[2] AS r FROM (SELECT freq, string_split(trim(s), '  ') AS a FROM w{i}) WHERE len(a) > 1) GROUP BY l, r ORDER BY cnt DESC, l, r LIMIT 1)"
        )
        ctes.append(f"w{i + 1} AS MATERIALIZED (SELECT freq, replace(s, ' ' || l || '  ' || r || ' ', ' ' || l || r || ' ') AS s FROM w{i}, b{i})")
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(f"SELECT {i} AS rank, l AS \"left\", r AS \"right\", cnt FROM b{i}" for i in range(k))


_SQL_WORDS = f"WITH corpus AS ({_DOCS}), freq AS ({_SQL_FREQ}), words AS (SELECT tok, freq, regexp_extract_all(tok, '[\\s\\S]') AS a FROM freq)"
_SQL_PAIRS = "SELECT l AS \"left\", r AS \"right\", sum(freq)::BIGINT AS cnt FROM (SELECT freq, unnest(a[1:len(a) - 1]) AS l, unnest(a[2:]) AS r FROM words WHERE len(a) > 1) GROUP BY l, r"


@_add("bpe_alphabet", f"{_SQL_WORDS} SELECT DISTINCT ch FROM (SELECT unnest(a) AS ch FROM words)")
def bpe_alphabet(spark, sf_dir):
    return bpe.alphabet(bpe.sequences(_counts(spark, sf_dir)))


@_add("bpe_pair_freq", f"{_SQL_WORDS} {_SQL_PAIRS}")
def bpe_pair_freq(spark, sf_dir):
    return bpe.pair_counts(bpe.sequences(_counts(spark, sf_dir)))


@_add("bpe_best_pair", f"{_SQL_WORDS} SELECT * FROM ({_SQL_PAIRS}) ORDER BY cnt DESC, \"left\", \"right\" LIMIT 1")
def bpe_best_pair(spark, sf_dir):
    return bpe.best_pair(bpe_pair_freq(spark, sf_dir))


@_add("bpe_train_k", _sql_train(_K))
def bpe_train_k(spark, sf_dir):
    found = bpe.train_by_frames(_counts(spark, sf_dir), _K)
    return spark.createDataFrame([(k, *f) for k, f in enumerate(found)], "rank int, left string, right string, cnt long")


@_add("bpe_train")
def bpe_train(spark, sf_dir):
    """Token strings and rules of a vocabulary of 2,000 tokens."""
    return bpe.train(_counts(spark, sf_dir), 2000).tokens_frame(spark)


_VOCAB = fixed_vocabulary()
_SQL_LIST = "[" + ", ".join(map(_quoted, _VOCAB.tokens)) + "]"


def _sql_encoded(tok: str) -> str:
    """The list of token strings of a pre-token."""
    known = "[" + ", ".join(_quoted(c) for c in CHARS) + "]"
    s = f"' ' || array_to_string(list_transform(regexp_extract_all({tok}, '[\\s\\S]'), lambda c: CASE WHEN list_contains({known}, c) THEN c ELSE '[UNK]' END), '  ') || ' '"
    for left, right, _ in _VOCAB.rules:
        a, b = _VOCAB.tokens[left], _VOCAB.tokens[right]
        s = f"replace({s}, {_quoted(f' {a}  {b} ')}, {_quoted(f' {a}{b} ')})"
    return f"string_split(trim({s}), '  ')"


_SQL_IDS = f"list_transform({_sql_encoded('tok')}, lambda t: list_position({_SQL_LIST}, t) - 1)"


@_add("bpe_encode", f"WITH corpus AS ({_DOCS}), freq AS ({_SQL_FREQ}) SELECT tok, freq, array_to_string({_SQL_IDS}, ',') AS ids FROM freq")
def bpe_encode(spark, sf_dir):
    counts = _counts(spark, sf_dir)
    return counts.select("tok", "freq", F.array_join(bpe.encode_column(F.col("tok"), spark, _VOCAB).cast("array<string>"), ",").alias("ids"))


@_add("bpe_encode_native", f"WITH corpus AS ({_DOCS}), freq AS ({_SQL_FREQ}) SELECT tok, array_to_string({_sql_encoded('tok')}, '|') AS tokens FROM freq")
def bpe_encode_native(spark, sf_dir):
    return _counts(spark, sf_dir).select("tok", F.array_join(bpe.encode_native(F.col("tok"), _VOCAB), "|").alias("tokens"))


@_add("bpe_decode", f"WITH corpus AS ({_DOCS}), freq AS ({_SQL_FREQ}) SELECT tok, array_to_string({_sql_encoded('tok')}, '') || '[UNK]' AS text FROM freq")
def bpe_decode(spark, sf_dir):
    ids = _counts(spark, sf_dir).select("tok", F.concat(bpe.encode_column(F.col("tok"), spark, _VOCAB), F.array(F.lit(99_999))).alias("ids"))
    return bpe.decode(ids, _VOCAB).select("tok", "text")


@_add("vocab_lookup", f"WITH corpus AS ({_DOCS}), freq AS ({_SQL_FREQ}) SELECT tok, freq, coalesce(list_position({_SQL_LIST}, tok) - 1, 0)::INTEGER AS id FROM freq")
def vocab_lookup(spark, sf_dir):
    return bpe.lookup(_counts(spark, sf_dir), _VOCAB).select("tok", "freq", "id")


@_add("vocab_known", f"WITH corpus AS ({_DOCS}), freq AS ({_SQL_FREQ}) SELECT tok, freq, (list_position({_SQL_LIST}, tok) - 1)::INTEGER AS id FROM freq WHERE list_contains({_SQL_LIST}, tok)")
def vocab_known(spark, sf_dir):
    return bpe.lookup(_counts(spark, sf_dir), _VOCAB, "inner").select("tok", "freq", "id")


@_add("vocab_unknown", f"WITH corpus AS ({_DOCS}), freq AS ({_SQL_FREQ}) SELECT tok, freq FROM freq WHERE NOT list_contains({_SQL_LIST}, tok)")
def vocab_unknown(spark, sf_dir):
    return bpe.lookup(_counts(spark, sf_dir), _VOCAB, "anti").select("tok", "freq")


@_add("vocab_info", "SELECT * FROM (VALUES ('tokens', {}), ('rules', {})) AS v(what, n)".format(len(_VOCAB), len(_VOCAB.rules)))
def vocab_info(spark, sf_dir):
    counts = [_VOCAB.tokens_frame(spark).select(F.lit("tokens").alias("what")), _VOCAB.rules_frame(spark).select(F.lit("rules").alias("what"))]
    return counts[0].unionByName(counts[1]).groupBy("what").agg(F.count("*").cast("int").alias("n"))


@_add("vocab_roundtrip", f"SELECT id::INTEGER AS id, token FROM (SELECT unnest(range(0, {len(_VOCAB)})) AS id, unnest({_SQL_LIST}) AS token)")
def vocab_roundtrip(spark, sf_dir):
    return store.parse_vocabulary(store.dump_vocabulary(_VOCAB)).tokens_frame(spark)


# token streams: the turns of all conversations in order, as one document a turn

_SQL_STREAM = f"""WITH corpus AS (SELECT conv_id * 100000 + turn AS doc_id, text FROM conversations),
words AS (SELECT doc_id, unnest(t) AS tok, generate_subscripts(t, 1) AS k FROM (SELECT doc_id, {_SQL_TOKENS} AS t FROM corpus)),
coded AS (SELECT doc_id, k, {_SQL_IDS} AS ids FROM words),
each AS (SELECT doc_id, k, unnest(ids) AS token_id, generate_subscripts(ids, 1) AS m FROM coded),
stream AS (SELECT row_number() OVER (ORDER BY doc_id, k, m) - 1 AS pos, token_id::INTEGER AS token_id, doc_id FROM each)"""
_SQL_TABLE = f"""counts AS (SELECT v.id::INTEGER AS token_id, count(s.pos) AS n FROM (SELECT unnest(range(0, {len(_VOCAB)})) AS id) v LEFT JOIN stream s ON s.token_id = v.id GROUP BY v.id),
cums AS (SELECT token_id, sum(pow(n::DOUBLE, 0.75)) OVER (ORDER BY token_id) AS cum FROM counts),
his AS (SELECT token_id, CASE WHEN token_id = {len(_VOCAB) - 1} OR (SELECT max(cum) FROM cums) = 0 THEN {SLOTS - 1} ELSE least(floor(cum / (SELECT max(cum) FROM cums) * {SLOTS}), {SLOTS - 1}) END::BIGINT AS hi FROM cums),
slots AS (SELECT token_id, CASE WHEN token_id = 0 THEN 0 ELSE coalesce(lag(hi) OVER (ORDER BY token_id), 0) + 1 END::BIGINT AS first_slot, hi FROM his)"""
_SQL_NEAR = f"near AS (SELECT a.pos AS i, b.pos AS j, a.token_id AS center, b.token_id AS context FROM stream a JOIN stream b ON b.pos BETWEEN a.pos - {WINDOW} AND a.pos + {WINDOW} AND b.pos <> a.pos)"
_SQL_NEAR_EQUI = f"near AS (SELECT a.pos AS i, b.pos AS j, a.token_id AS center, b.token_id AS context FROM (SELECT *, pos + unnest([{', '.join(str(d) for d in range(-WINDOW, WINDOW + 1) if d)}]) AS other FROM stream) a JOIN stream b ON b.pos = a.other)"


def _stream(spark, sf_dir) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100_000 + F.col("turn")).alias("doc_id"), "text")
    return skipgram.positions(bpe.encode_texts(turns, _VOCAB))


@_add("corpus_token_ids", f"{_SQL_STREAM} SELECT * FROM stream")
def corpus_token_ids(spark, sf_dir):
    return _stream(spark, sf_dir)


@_add("neg_sampling_table", f"{_SQL_STREAM}, {_SQL_TABLE} SELECT token_id, first_slot, hi - first_slot + 1 AS n_slots FROM slots")
def neg_sampling_table(spark, sf_dir):
    return skipgram.negative_table(skipgram.unigram_counts(_stream(spark, sf_dir), len(_VOCAB)), SLOTS)


@_add("skipgram_pairs", f"{_SQL_STREAM}, {_SQL_NEAR_EQUI} SELECT center, context, count(*) AS n FROM near GROUP BY ALL")
def skipgram_pairs(spark, sf_dir):
    return skipgram.skipgram_pairs(_stream(spark, sf_dir), WINDOW).groupBy("center", "context").agg(F.count("*").alias("n"))


@_add(
    "negative_samples",
    f"""{_SQL_STREAM}, {_SQL_TABLE}, {_SQL_NEAR_EQUI}, picks AS (SELECT center, k, (7 * (i + 1) + 13 * (j + 1) + 17 * k) % {SLOTS} AS slot FROM (SELECT *, unnest([{', '.join(map(str, range(1, N_NEG + 1)))}]) AS k FROM near))
SELECT center, k, s.token_id AS neg_id, count(*) AS n FROM picks JOIN slots s ON slot BETWEEN first_slot AND hi GROUP BY ALL""",
)
def negative_samples(spark, sf_dir):
    tokens = _stream(spark, sf_dir)
    table = skipgram.negative_table(skipgram.unigram_counts(tokens, len(_VOCAB)), SLOTS)
    drawn = skipgram.negative_samples(skipgram.skipgram_pairs(tokens, WINDOW), table, N_NEG, SLOTS)
    return drawn.groupBy("center", "k", "neg_id").agg(F.count("*").alias("n"))


@_add("sgns_train")
def sgns_train(spark, sf_dir):
    """Loss of each epoch of training by partitions on all conversations."""
    tokens = _stream(spark, sf_dir)
    table = skipgram.negative_table(skipgram.unigram_counts(tokens, len(_VOCAB)), SLOTS)
    _, _, losses = sgns.train(tokens, table, len(_VOCAB), dim=16, window=WINDOW, n_neg=N_NEG, epochs=3, block=1 << 14)
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(losses)], "epoch int, loss double")


# vectors

_SQL_COS = "round(coalesce(list_cosine_similarity({a}, {b}), 0), 4) + 0.0"


def _vectors(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "embeddings")


@_add("sigmoid_scores", "SELECT vec_id, round(1 / (1 + exp(-greatest(-20, least(20, 30 * embedding[1]::DOUBLE)))), 6) AS p FROM embeddings")
def sigmoid_scores(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", F.round(arrays.sigmoid(30 * F.element_at("embedding", 1).cast("double")), 6).alias("p"))


@_add("embed_lookup", "SELECT vec_id, k::INTEGER AS k, x FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings WHERE vec_id = 7)")
def embed_lookup(spark, sf_dir):
    return vectors.embedding(_vectors(spark, sf_dir), 7, "vec_id", "embedding").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("k", "x"))


@_add(
    "cosine_topk",
    """SELECT a.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS similarity
FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE a.vec_id <> 0
ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, a.vec_id LIMIT 10""",
)
def cosine_topk(spark, sf_dir):
    return vectors.similar(_vectors(spark, sf_dir), 0, 10, "vec_id", "embedding").withColumn("similarity", F.round("similarity", 4))


@_add(
    "analogy_topk",
    """WITH q AS (SELECT list(x ORDER BY k) AS q FROM (SELECT k, sum(s * x) AS x FROM
 (SELECT generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS x, CASE WHEN vec_id = 2 THEN -1 ELSE 1 END AS s FROM embeddings WHERE vec_id IN (1, 2, 3)) GROUP BY k))
SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q), 4) AS similarity FROM embeddings, q
WHERE vec_id NOT IN (1, 2, 3) ORDER BY list_cosine_similarity(embedding::DOUBLE[], q) DESC, vec_id LIMIT 5""",
)
def analogy_topk(spark, sf_dir):
    return vectors.analogy(_vectors(spark, sf_dir), [(1, 1.0), (2, -1.0), (3, 1.0)], 5, "vec_id", "embedding").withColumn("similarity", F.round("similarity", 4))


@_add("array_sum", "SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 4) + 0.0 AS total FROM embeddings")
def array_sum(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", (F.round(arrays.array_sum(F.col("embedding").cast("array<double>")), 4) + F.lit(0.0)).alias("total"))


@_add("array_scale", "SELECT vec_id, k::INTEGER AS k, round(x::DOUBLE * 2.5, 4) + 0.0 AS x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings)")
def array_scale(spark, sf_dir):
    scaled = arrays.array_scale(F.col("embedding").cast("array<double>"), 2.5)
    return _vectors(spark, sf_dir).select("vec_id", F.posexplode(scaled).alias("k", "x")).withColumn("x", F.round("x", 4) + F.lit(0.0))


_SQL_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"


@_add(
    "sgns_pair_step",
    f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
t AS (SELECT a.vec_id, a.e AS c, b.e AS o FROM v a JOIN v b ON b.vec_id = a.vec_id + 1),
g AS (SELECT vec_id, c, o, {DIM_RATE} * (1 - 1 / (1 + exp(-greatest(-20, least(20, list_sum(list_transform(c, lambda x, k: x * o[k]))))))) AS g FROM t)
SELECT vec_id, round(list_sum(list_transform(c, lambda x, k: (x + g * o[k]) * k)), 4) + 0.0 AS center, round(list_sum(list_transform(o, lambda x, k: (x + g * c[k]) * k)), 4) + 0.0 AS target FROM g""",
)
def sgns_pair_step(spark, sf_dir):
    """One positive step of each vector as a center with the next one as its target; a weighted sum of each result."""
    own = _vectors(spark, sf_dir).select("vec_id", F.col("embedding").cast("array<double>").alias("c"))
    targets = own.select((F.col("vec_id") - 1).alias("vec_id"), F.col("c").alias("o"))
    step = own.join(targets, "vec_id").withColumn("g", (1 - arrays.sigmoid(arrays.dot(F.col("c"), F.col("o")))) * DIM_RATE)

    def mark(a, b):
        moved = F.transform(arrays.axpy(F.col("g"), b, a), lambda x, k: x * (k + 1))
        return F.round(arrays.array_sum(moved), 4) + F.lit(0.0)

    return step.select("vec_id", mark(F.col("c"), F.col("o")).alias("center"), mark(F.col("o"), F.col("c")).alias("target"))


@_add("model_roundtrip", "SELECT vec_id AS id, round(list_sum(embedding::DOUBLE[]), 4) + 0.0 AS total FROM embeddings")
def model_roundtrip(spark, sf_dir):
    """Every vector through the binary format, batch by batch; the sum of its components."""

    def through(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            w = np.array(batch.column(1).to_pylist(), np.float32).reshape(batch.num_rows, -1)
            w_in, w_out, _, _ = store.parse_model(store.dump_model(w, -w, 1, 0.025))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(((w_in - w_out) / 2).tolist(), pa.list_(pa.float32()))], names=["id", "w"])

    back = _vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "embedding").mapInArrow(through, "id long, w array<float>")
    return back.select("id", (F.round(arrays.array_sum(F.col("w").cast("array<double>")), 4) + F.lit(0.0)).alias("total"))


_NEG_SQL = "list_sum(list_transform({a}, lambda x, k: x * {b}[k]))"


@_add(
    "sgns_negative_steps",
    f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
t AS (SELECT a.vec_id, a.e AS c, b.e AS o, d.e AS n FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 JOIN v d ON d.vec_id = a.vec_id + 2),
g0 AS (SELECT *, {DIM_RATE} * (1 - 1 / (1 + exp(-greatest(-20, least(20, {_NEG_SQL.format(a='c', b='o')}))))) AS p FROM t),
g1 AS (SELECT *, -{DIM_RATE} / (1 + exp(-greatest(-20, least(20, {_NEG_SQL.format(a='c', b='n')})))) AS q FROM g0),
n1 AS (SELECT *, list_transform(n, lambda x, k: x + q * c[k]) AS m FROM g1),
g2 AS (SELECT *, -{DIM_RATE} / (1 + exp(-greatest(-20, least(20, {_NEG_SQL.format(a='c', b='m')})))) AS r FROM n1)
SELECT vec_id, round(list_sum(list_transform(c, lambda x, k: (x + p * o[k] + q * n[k] + r * m[k]) * k)), 3) + 0.0 AS center,
 round(list_sum(list_transform(m, lambda x, k: (x + r * c[k]) * k)), 3) + 0.0 AS negative FROM g2""",
)
def sgns_negative_steps(spark, sf_dir):
    """A positive target and one negative drawn twice, so its second step starts where the first left it."""
    own = _vectors(spark, sf_dir).select("vec_id", F.col("embedding").cast("array<double>").alias("c"))
    after = lambda n, name: own.select((F.col("vec_id") - n).alias("vec_id"), F.col("c").alias(name))
    step = own.join(after(1, "o"), "vec_id").join(after(2, "n"), "vec_id")
    step = step.withColumn("p", (1 - arrays.sigmoid(arrays.dot(F.col("c"), F.col("o")))) * DIM_RATE).withColumn("q", -arrays.sigmoid(arrays.dot(F.col("c"), F.col("n"))) * DIM_RATE)
    step = step.withColumn("m", arrays.axpy(F.col("q"), F.col("c"), F.col("n"))).withColumn("r", -arrays.sigmoid(arrays.dot(F.col("c"), F.col("m"))) * DIM_RATE)
    center = F.col("c")
    for g, x in (("p", "o"), ("q", "n"), ("r", "m")):
        center = arrays.axpy(F.col(g), F.col(x), center)
    total = lambda a: F.round(arrays.array_sum(F.transform(a, lambda x, k: x * (k + 1))), 3) + F.lit(0.0)
    return step.select("vec_id", total(center).alias("center"), total(arrays.axpy(F.col("r"), F.col("c"), F.col("m"))).alias("negative"))


WIKITEXT = [
    (1, "[[Harbour|the port]] and [[Quay]]", "the port and Quay"), (2, "before {{box {{inside}} x}}after", "before after"), (3, "== Ships ==", "Ships"), (4, "a '''bold''' and ''slanted'' word", "a bold and slanted word"),
    (5, "claim<ref name=\"n\"/> holds", "claim holds"), (6, "claim<ref>source</ref> holds", "claim holds"), (7, "plain words", "plain words"), (8, "", ""),
]


@_add("strip_wikitext_cases", f"SELECT * FROM (VALUES {', '.join('(%d, %s)' % (k, chr(39) + t.replace(chr(39), chr(39) * 2) + chr(39)) for k, _, t in WIKITEXT)}) AS v(id, text)")
def strip_wikitext_cases(spark, sf_dir):
    return spark.createDataFrame([(k, x) for k, x, _ in WIKITEXT], "id int, markup string").select("id", wiki.strip_wikitext(F.col("markup")).alias("text"))
