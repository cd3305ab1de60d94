"""Byte-pair encoding over characters: counting, training, encoding, decoding.

The identity of a symbol is its string.  Where several pairs are most frequent the
one of the lowest (left, right) is merged, so training has one result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chars
from ..functions.text import normalize, normalized_pretoken, pretokenize, raw_pretokens
from ..scratch import Scratch, Shared, slots
from ..together import Together
from . import merges

SPECIALS = ("[UNK]", "[PAD]", "[BOS]", "[EOS]")
UNKNOWN = 0


@dataclass
class Vocabulary:
    """Tokens by id, merge rules (left, right, id) by rank."""

    tokens: list[str] = field(default_factory=lambda: list(SPECIALS))
    rules: list[tuple[int, int, int]] = field(default_factory=list)

    def __post_init__(self):
        self.ids = {t: k for k, t in reversed(list(enumerate(self.tokens)))}

    def __len__(self) -> int:
        return len(self.tokens)

    def __contains__(self, token: str) -> bool:
        return token in self.ids

    def __iter__(self):
        return iter(enumerate(self.tokens))

    def add(self, token: str) -> int:
        if token not in self.ids:
            self.ids[token] = len(self.tokens)
            self.tokens.append(token)
        return self.ids[token]

    def add_rule(self, left: str, right: str) -> None:
        self.rules.append((self.ids[left], self.ids[right], self.add(left + right)))

    def id_of(self, token: str) -> int:
        return self.ids.get(token, UNKNOWN)

    def tokens_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.tokens)), "id int, token string")

    def rules_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, *r) for k, r in enumerate(self.rules)], "rank int, left int, right int, id int")


# counting


def pretokens(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(tok), one row an occurrence."""
    return texts.select(F.explode(pretokenize(normalize(F.col(text_col)))).alias("tok"))


def pretoken_counts(tokens: DataFrame) -> DataFrame:
    """(tok, freq); counted before the shuffle."""
    return tokens.filter("tok <> ''").groupBy("tok").agg(F.count("*").alias("freq"))


def text_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """The pretoken_counts of the pretokens of texts: counted as they stand, so that only distinct ones are normalised."""
    raw = texts.select(F.explode(raw_pretokens(F.col(text_col))).alias("raw")).groupBy("raw").agg(F.count("*").alias("n"))
    times = F.when(F.col("raw") == chars.ELLIPSIS, 3).otherwise(1)
    return raw.groupBy(normalized_pretoken(F.col("raw")).alias("tok")).agg(F.sum(F.col("n") * times).alias("freq"))


def sequences(counts: DataFrame) -> DataFrame:
    """(tok, freq, seq): each word as its characters."""
    return counts.withColumn("seq", F.filter(F.split("tok", ""), lambda c: c != ""))


def alphabet(words: DataFrame) -> DataFrame:
    return words.select(F.explode("seq").alias("ch")).distinct()


def pair_counts(words: DataFrame) -> DataFrame:
    """(left, right, cnt): neighbours in all words, weighted by the words' counts; overlapping ones count."""
    n = F.size("seq")
    pairs = F.arrays_zip(F.slice("seq", 1, n - 1).alias("l"), F.slice("seq", 2, n - 1).alias("r"))
    each = words.filter(n > 1).select("freq", F.explode(pairs).alias("p"))
    return each.groupBy(F.col("p.l").alias("left"), F.col("p.r").alias("right")).agg(F.sum("freq").alias("cnt"))


def best_pair(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy(F.desc("cnt"), "left", "right").limit(1)


# merging: every symbol stands between two spaces, which no pre-token holds, so that a merge is one replacement


def spaced(seq: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(seq, "  "), F.lit(" "))


def unspaced(text: Column) -> Column:
    return F.split(F.trim(text), "  ")


def merged(text: Column, left: Column, right: Column) -> Column:
    """All occurrences of the pair become one symbol, from the left, without overlaps."""
    return F.replace(text, F.concat(F.lit(" "), left, F.lit("  "), right, F.lit(" ")), F.concat(F.lit(" "), left, right, F.lit(" ")))


def train_by_frames(counts: DataFrame, n_merges: int, every: int = 8) -> list[tuple[str, str, int]]:
    """(left, right, count) of the first merges, one job each: for vocabularies of words that no single task can hold.

    The words are written to the shared folder every few merges, which cuts the lineage.
    """
    scratch, words, out = Scratch(counts.sparkSession), None, []
    words = scratch.table(sequences(counts).select("tok", "freq", "seq"), "words0")
    for k in range(n_merges):
        best = best_pair(pair_counts(words)).first()
        if best is None:
            break
        out.append((best.left, best.right, best.cnt))
        words = words.withColumn("seq", unspaced(merged(spaced(F.col("seq")), F.lit(best.left), F.lit(best.right))))
        if (k + 1) % every == 0:
            words = scratch.table(words, f"words{k + 1}")
            scratch.drop(f"words{k + 1 - every}")
    return out


def train_words(words: list[str], freqs: list[int], target: int) -> Vocabulary:
    """Alphabet by code point, then merges until the vocabulary has `target` tokens or no pair is left."""
    vocabulary = Vocabulary()
    merges.loop(words, freqs, vocabulary, target)
    return vocabulary


def train(counts: DataFrame, target: int, part_chars: int = 1 << 21) -> Vocabulary:
    """Counting is distributed, and so is the merge loop over the distinct words: each of its tasks holds a part of them.

    The tasks tell each other how each round of merges changes the counts of pairs, so they run at the same time, a
    barrier stage.  There are as many as words of `part_chars` characters in each ask for, and no more than the cluster has slots.
    """
    spark, scratch = counts.sparkSession, Scratch(counts.sparkSession)
    words = scratch.table(counts.select("tok", "freq"), "counts", records=100_000)
    n_chars = words.agg(F.sum(F.length("tok"))).first()[0] or 0
    parts = min(n_chars // part_chars + 1, slots(spark))

    def run(batches):
        import numpy as np
        from pyspark import TaskContext

        own, freqs, v = [], [np.zeros(0, np.int64)], Vocabulary()
        for batch in batches:
            own += batch.column(0).to_pylist()
            freqs.append(batch.column(1).to_numpy())
        merges.loop(own, np.concatenate(freqs), v, target, *([Together().gather] if parts > 1 else []))
        if TaskContext.get().partitionId() == 0:
            for at in range(0, len(v.tokens), 10_000):
                yield pa.RecordBatch.from_pydict({"kind": ["t"] * len(x := v.tokens[at : at + 10_000]), "rank": list(range(at, at + len(x))), "token": x, "l": [0] * len(x), "r": [0] * len(x), "id": [0] * len(x)}, schema)
            for at in range(0, len(v.rules), 10_000):
                left, right, to = zip(*(x := v.rules[at : at + 10_000]))
                yield pa.RecordBatch.from_pydict({"kind": ["r"] * len(x), "rank": list(range(at, at + len(x))), "token": [""] * len(x), "l": left, "r": right, "id": to}, schema)

    schema = pa.schema([("kind", pa.string()), ("rank", pa.int32()), ("token", pa.string()), ("l", pa.int32()), ("r", pa.int32()), ("id", pa.int32())])
    placed = words.repartition(parts, "tok") if parts > 1 else words.repartition(1)
    found = placed.mapInArrow(run, "kind string, rank int, token string, l int, r int, id int", barrier=parts > 1).collect()
    scratch.drop("counts")
    found.sort(key=lambda r: r.rank)
    tokens, rules = [r.token for r in found if r.kind == "t"], [(r.l, r.r, r.id) for r in found if r.kind == "r"]
    return Vocabulary(tokens, rules) if tokens else Vocabulary()


# encoding and decoding


class Encoder:
    """Every rule once, in order of rank; only rules that apply are looked at."""

    def __init__(self, vocabulary: Vocabulary):
        self.ids, self.result, self.ranks = vocabulary.ids, [r[2] for r in vocabulary.rules], defaultdict(list)
        for rank, (left, right, _) in enumerate(vocabulary.rules):
            self.ranks[left, right].append(rank)

    def _next(self, pair: tuple[int, int], rank: int) -> int | None:
        ranks = self.ranks.get(pair)
        if ranks is None:
            return None
        at = bisect_left(ranks, rank)
        return ranks[at] if at < len(ranks) else None

    def encode(self, word: str) -> list[int]:
        seq, rank = [self.ids.get(c, UNKNOWN) for c in word], 0
        while len(seq) > 1:
            found = min((r for p in set(zip(seq, seq[1:])) if (r := self._next(p, rank)) is not None), default=None)
            if found is None:
                break
            pair = next(p for p in zip(seq, seq[1:]) if self._next(p, rank) == found)
            out, i = [], 0
            while i < len(seq):
                if i + 1 < len(seq) and (seq[i], seq[i + 1]) == pair:
                    out.append(self.result[found])
                    i += 2
                else:
                    out.append(seq[i])
                    i += 1
            seq, rank = out, found + 1
        return seq


def encode_column(tok: Column, spark: SparkSession, vocabulary: Vocabulary) -> Column:
    """array<int> of a pre-token; each worker batch encodes a distinct word once."""
    shared = Shared(spark, vocabulary)

    @F.pandas_udf("array<int>")
    def run(words: pd.Series) -> pd.Series:
        encoder, known = Encoder(shared.value), {}
        return words.map(lambda w: None if w is None else known[w] if w in known else known.setdefault(w, encoder.encode(w)), na_action="ignore")

    return run(tok)


def encode_native(tok: Column, vocabulary: Vocabulary) -> Column:
    """The same for small rule sets, as a fold of replacements inside Catalyst: an array of token strings."""
    text = spaced(F.filter(F.split(tok, ""), lambda c: c != ""))
    known = F.array(*[F.lit(t) for t in vocabulary.tokens])
    text = spaced(F.transform(unspaced(text), lambda c: F.when(F.array_contains(known, c), c).otherwise(SPECIALS[UNKNOWN])))
    for left, right, _ in vocabulary.rules:
        text = merged(text, F.lit(vocabulary.tokens[left]), F.lit(vocabulary.tokens[right]))
    return unspaced(text)


def encode_texts(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of each text in order, without a shuffle."""
    spark = docs.sparkSession
    shared = Shared(spark, vocabulary)

    @F.pandas_udf("array<int>")
    def run(lists: pd.Series) -> pd.Series:
        encoder, known = Encoder(shared.value), {}
        table = str.maketrans(chars.FROM, chars.TO)

        def each(words):
            out = []
            for w in words:
                if w not in known:
                    known[w] = encoder.encode(".") * 3 if w == chars.ELLIPSIS else encoder.encode(w.translate(table))
                out += known[w]
            return out

        return lists.map(each, na_action="ignore")

    return docs.select(F.col(id_col), run(raw_pretokens(F.coalesce(F.col(text_col), F.lit("")))).alias("ids"))


def decode(rows: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", to: str = "text") -> DataFrame:
    """Adds the text of ids; an id outside of the vocabulary reads [UNK].  The tokens travel as one row, so nothing is shuffled."""
    spark = rows.sparkSession
    one = spark.createDataFrame([(vocabulary.tokens,)], "__tokens array<string>")
    text = F.array_join(F.transform(ids_col, lambda k: F.coalesce(F.when(k >= 0, F.get("__tokens", k)), F.lit(SPECIALS[UNKNOWN]))), "")
    return rows.crossJoin(F.broadcast(one)).withColumn(to, text).drop("__tokens")


def lookup(tokens: DataFrame, vocabulary: Vocabulary, how: str = "left") -> DataFrame:
    """Adds the id of (tok): 0 where unknown (left), or only rows with an id (inner), rows without (anti)."""
    spark = tokens.sparkSession
    frame = vocabulary.tokens_frame(spark).withColumnRenamed("token", "tok")
    small = sum(len(t) for t in vocabulary.tokens) < 64 << 20
    joined = tokens.join(F.broadcast(frame) if small else frame, "tok", {"left": "left", "inner": "inner", "anti": "left_anti"}[how])
    return joined.withColumn("id", F.coalesce("id", F.lit(UNKNOWN))) if how == "left" else joined
