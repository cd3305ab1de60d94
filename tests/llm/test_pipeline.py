"""The stages one after another: what each takes, keeps and changes."""

import glob
import os

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import catalog, decontaminate, ngram_join

SF = os.environ.get("GLYPHMILL_SF_DIR", "/root/testdata/sf0.001")


def test_stages_compose_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "pii", "packing"]
    sizes, last = [docs.count()], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        last = stage(spark, last, SF)
        assert last.columns == docs.columns
        last = spark.createDataFrame(last.toPandas(), docs.schema)
        sizes.append(last.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4]
    expected = corpus_pipeline.STAGES[-1][1](spark, last, SF)
    got = corpus_pipeline.run(spark, SF)
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(got) == key(expected)
    assert {k for r in got.collect() for k in r.doc_ids} == {r.doc_id for r in last.filter(F.length("text") > 0).collect()}


def test_nothing_within_reach_remains(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, SF)
        kept = spark.createDataFrame(kept.toPandas(), docs.schema)
    assert ngram_join.linked_documents(kept, 3, 0.5).filter("n_links > 0").count() == 0
    assert decontaminate.matches(kept, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0


def test_each_operator_has_its_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES)
    assert numbers == list(range(1, 11)) and set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", ["op1_suffix_array_dedup", "op10_ngram_jaccard_join"])
def test_sql_gives_the_same_rows(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = catalog.QUERIES[name](spark, SF)
    order = ", ".join(f'"{c}"' for c in df.columns)
    rows = con.execute(f"SELECT {order} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()) == sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows)
