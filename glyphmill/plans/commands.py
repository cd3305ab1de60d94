"""What the commands do, as functions of a session."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize, pretokenize
from ..operators import bpe, sgns, skipgram, vectors
from ..sources import store
from ..sources.text import read_text


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): the lines of a text file; doc_id rises in the order of the file."""
    return read_text(spark, path).select(F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("text"))


def bpe_train(spark: SparkSession, source: str, target: str, vocab_size: int = 10_000) -> bpe.Vocabulary:
    vocabulary = bpe.train(bpe.text_counts(corpus(spark, source)), vocab_size)
    store.save_vocabulary(vocabulary, target)
    return vocabulary


def train(spark: SparkSession, source: str, target: str, vocab: str | None = None, vocab_size: int = 50_000, dim: int = 100, window: int = 5, neg_samples: int = 5, lr: float = 0.025, epochs: int = 5, seed: int = 1, stop=lambda: False) -> dict:
    """Writes the model to `target` and its vocabulary, trained or given, beside it."""
    texts = corpus(spark, source)
    vocabulary = store.load_vocabulary(vocab) if vocab else bpe.train(bpe.text_counts(texts), vocab_size)
    store.save_vocabulary(vocabulary, f"{target}.vocab")
    tokens = skipgram.positions(bpe.encode_texts(texts, vocabulary))
    table = skipgram.negative_table(skipgram.unigram_counts(tokens, len(vocabulary)))
    w_in, w_out, losses = sgns.train(tokens, table, len(vocabulary), dim, window, neg_samples, lr, epochs, seed, stop=stop)
    store.save_model(target, w_in, w_out, len(losses), lr)
    return {"tokens": len(vocabulary), "losses": losses}


def bpe_encode(spark: SparkSession, vocab: str, text: str) -> DataFrame:
    """(pos, tok, ids) of one text."""
    row = spark.createDataFrame([(text,)], "text string")
    words = row.select(F.posexplode(pretokenize(normalize(F.col("text")))).alias("pos", "tok"))
    return words.withColumn("ids", bpe.encode_column(F.col("tok"), spark, store.load_vocabulary(vocab))).orderBy("pos")


def load(spark: SparkSession, model: str) -> tuple[bpe.Vocabulary, DataFrame]:
    w_in, w_out, _, _ = store.load_model(model)
    return store.load_vocabulary(f"{model}.vocab"), store.model_frame(spark, w_in, w_out)


def _named(spark: SparkSession, vocabulary: bpe.Vocabulary, found: DataFrame) -> DataFrame:
    tokens = vocabulary.tokens_frame(spark)
    return tokens.join(F.broadcast(found), "id").select("token", "similarity", "id").orderBy(F.desc("similarity"), "id")  # found has k rows


def similar(spark: SparkSession, model: str, word: str, topk: int = 10) -> DataFrame:
    vocabulary, frame = load(spark, model)
    [(id_, _)] = vectors.resolve([(word, 1.0)], vocabulary)
    return _named(spark, vocabulary, vectors.similar(frame, id_, topk))


def analogy(spark: SparkSession, model: str, query: str, topk: int = 5) -> DataFrame:
    vocabulary, frame = load(spark, model)
    terms = vectors.resolve(vectors.parse_analogy(query), vocabulary)
    if not terms:
        raise ValueError("an analogy needs words")
    return _named(spark, vocabulary, vectors.analogy(frame, terms, topk))


def embed(spark: SparkSession, model: str, word: str) -> np.ndarray:
    vocabulary, frame = load(spark, model)
    [(id_, _)] = vectors.resolve([(word, 1.0)], vocabulary)
    return np.array(vectors.embedding(frame, id_).first().w_in, np.float32)


def info(path: str) -> list[str]:
    """Lines on a vocabulary or a model file."""
    with open(path, "rb") as file:
        model = file.read(4) == store.MODEL_MAGIC
    if model:
        w_in, _, epoch, rate = store.load_model(path)
        return [f"Model: {path}", f"  Tokens: {len(w_in)}", f"  Dimension: {w_in.shape[1]}", f"  Epoch: {epoch}", f"  Learning rate: {rate:g}", f"  Bytes: {os.path.getsize(path)}"]
    vocabulary = store.load_vocabulary(path)
    shown = [(k, repr(t) if "\n" in t or "\r" in t else t) for k, t in list(vocabulary)[:10]]
    return [f"BPE Vocabulary: {path}", f"  Tokens: {len(vocabulary)}", f"  Merge rules: {len(vocabulary.rules)}", "", "  Sample tokens:", *[f"    {k:>4}: {t}" for k, t in shown]]
