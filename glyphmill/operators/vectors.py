"""Questions to a table of vectors: lookup, nearest by cosine, analogies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import cosine


class UnknownWord(LookupError):
    """A word that the vocabulary doesn't hold."""


def embedding(vectors: DataFrame, id_: int, id_col: str = "id", vector_col: str = "w_in") -> DataFrame:
    return vectors.filter(F.col(id_col) == id_).select(F.col(id_col), F.col(vector_col))


def combine(vectors: DataFrame, terms: list[tuple[int, float]], id_col: str = "id", vector_col: str = "w_in") -> DataFrame:
    """One row (q): the signed sum of the vectors of some ids; no row if there are no terms."""
    signs = F.create_map(*[F.lit(x) for k in dict.fromkeys(t[0] for t in terms) for x in (k, float(sum(s for i, s in terms if i == k)))])
    own = vectors.filter(F.col(id_col).isin([t[0] for t in terms])).select(F.posexplode(F.transform(vector_col, lambda x: x.cast("double") * F.element_at(signs, F.col(id_col).cast("int")))).alias("k", "x"))
    return own.groupBy("k").agg(F.sum("x").alias("x")).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda p: p["x"]).alias("q"))


def nearest(vectors: DataFrame, query: DataFrame, k: int, without: list[int], id_col: str = "id", vector_col: str = "w_in") -> DataFrame:
    """(id, similarity) of the k vectors of largest cosine to the one row of `query`; ties go to the lower id.

    One row is sent to all tasks, each keeps its own k best.
    """
    others = vectors.filter(~F.col(id_col).isin(without)) if without else vectors
    scored = others.crossJoin(F.broadcast(query)).select(F.col(id_col).alias("id"), cosine(F.col(vector_col), F.col("q")).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "id").limit(k)


def similar(vectors: DataFrame, id_: int, k: int = 10, id_col: str = "id", vector_col: str = "w_in") -> DataFrame:
    query = vectors.filter(F.col(id_col) == id_).select(F.col(vector_col).alias("q"))
    return nearest(vectors, query, k, [id_], id_col, vector_col)


def parse_analogy(query: str) -> list[tuple[str, float]]:
    """Signed words: a lone + or - is the sign of the next word, every other word is added."""
    out, sign = [], 1.0
    for part in query.split():
        if part in ("+", "-"):
            sign = 1.0 if part == "+" else -1.0
        else:
            out.append((part, sign))
            sign = 1.0
    return out


def analogy(vectors: DataFrame, terms: list[tuple[int, float]], k: int = 5, id_col: str = "id", vector_col: str = "w_in") -> DataFrame:
    return nearest(vectors, combine(vectors, terms, id_col, vector_col), k, [t[0] for t in terms], id_col, vector_col)


def resolve(words: list[tuple[str, float]], vocabulary) -> list[tuple[int, float]]:
    for word, _ in words:
        if word not in vocabulary:
            raise UnknownWord(f"Word '{word}' not in vocabulary")
    return [(vocabulary.ids[w], s) for w, s in words]
