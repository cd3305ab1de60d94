"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import chat, decontaminate, language_model, ngram_join, one_bit_search, packing, pseudonyms, quality, suffix_array, suffix_tree

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_array_dedup(spark, sf_dir):
    return suffix_array.repeated_spans(_docs(spark, sf_dir), threshold=50)


QUERIES["op1_suffix_array_dedup"] = op1_suffix_array_dedup
ORACLE_SQL["op1_suffix_array_dedup"] = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(text, '[^\t-\r ]+') AS w
  FROM documents WHERE text IS NOT NULL),
windows AS (
  SELECT doc_id, k - 1 AS k, md5(array_to_string(w[k:k + 49], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM words WHERE len(w) >= 50)),
marked AS (
  SELECT doc_id, k, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY doc_id, k) AS nth
  FROM windows),
islands AS (
  SELECT doc_id, k, nth, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS island
  FROM marked WHERE n > 1)
SELECT doc_id, min(k) AS start_word, count(*) + 49 AS n_words, sum(CASE WHEN nth > 1 THEN 1 ELSE 0 END)::BIGINT AS n_later
FROM islands GROUP BY doc_id, island
"""


def op7_substring_dedup(spark, sf_dir):
    return suffix_tree.all_maximal_repeats(_docs(spark, sf_dir), threshold=50)


QUERIES["op7_substring_dedup"] = op7_substring_dedup


def op10_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.linked_documents(_docs(spark, sf_dir), n=3, least=0.5)


QUERIES["op10_ngram_jaccard_join"] = op10_ngram_jaccard_join
ORACLE_SQL["op10_ngram_jaccard_join"] = r"""
WITH RECURSIVE own AS (
  SELECT row_number() OVER () AS r, doc_id, w
  FROM (SELECT DISTINCT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\t-\r ]+') AS w FROM documents WHERE doc_id IS NOT NULL)),
grams AS (
  SELECT DISTINCT r, w[k:k + 2] AS g
  FROM (SELECT r, w, unnest(range(1, greatest(2, len(w) - 1))) AS k FROM own WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r),
counted AS (
  SELECT a.r AS x, b.r AS y, count(*) AS overlap
  FROM grams a JOIN grams b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
links AS (
  SELECT x, y FROM counted JOIN sizes p ON p.r = x JOIN sizes q ON q.r = y
  WHERE overlap / (p.n + q.n - overlap)::DOUBLE >= 0.5),
reached(r, other) AS (
  SELECT r, r FROM own UNION SELECT reached.r, links.y FROM reached JOIN links ON links.x = reached.other),
classes AS (SELECT reached.r, min(own.doc_id) AS class_id FROM reached JOIN own ON own.r = reached.other GROUP BY reached.r),
degrees AS (SELECT x AS r, count(*) AS n FROM links GROUP BY x)
SELECT doc_id, class_id, coalesce(n, 0)::BIGINT AS n_links
FROM own JOIN classes USING (r) LEFT JOIN degrees USING (r)
"""


def op8_quality_classifier(spark, sf_dir):
    return quality.scores(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES["op8_quality_classifier"] = op8_quality_classifier


def op3_benchmark_decontamination(spark, sf_dir):
    return decontaminate.matches(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), threshold=0.5)


QUERIES["op3_benchmark_decontamination"] = op3_benchmark_decontamination


def op6_pii_pseudonyms(spark, sf_dir):
    return pseudonyms.pseudonyms(_docs(spark, sf_dir).select("doc_id", "text"), pseudonyms.key_of(spark), count_col="n_replaced")


QUERIES["op6_pii_pseudonyms"] = op6_pii_pseudonyms


def op9_packing(spark, sf_dir):
    return packing.packed(_docs(spark, sf_dir))


QUERIES["op9_packing"] = op9_packing


def op2_chat_formatting(spark, sf_dir):
    return chat.formatted(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES["op2_chat_formatting"] = op2_chat_formatting


def op4_nearest_neighbours(spark, sf_dir):
    return one_bit_search.neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=10)


QUERIES["op4_nearest_neighbours"] = op4_nearest_neighbours


def op5_lm_scoring(spark, sf_dir):
    return language_model.scores(_docs(spark, sf_dir))


QUERIES["op5_lm_scoring"] = op5_lm_scoring
