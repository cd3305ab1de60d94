"""Positions, context windows and negative samples of a token stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

SLOTS = 1_000_000
POWER = 0.75
BLOCK = 4096


def positions(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(pos, token_id, doc_id): dense positions from 0 over all texts in the order of their ids.

    Texts are range-partitioned by id and written with their partition; only the
    partitions' totals, a row each, are summed in one place.
    """
    spark = encoded.sparkSession
    texts = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    placed = Scratch(spark).table(texts.repartitionByRange("doc_id").select("*", F.spark_partition_id().alias("part"), F.size("ids").cast("long").alias("n")), "positions")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("part").agg(F.sum("n").alias("total")).select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("part").orderBy("doc_id", "ids").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.join(F.broadcast(offsets), "part").withColumn("start", F.col("offset") + F.coalesce(F.sum("n").over(within), F.lit(0)))  # a row a partition
    return starts.select("doc_id", "start", F.posexplode("ids").alias("k", "token_id")).select((F.col("start") + F.col("k")).alias("pos"), "token_id", "doc_id")


def unigram_counts(tokens: DataFrame, vocab_size: int) -> DataFrame:
    """(token_id, n) for every id of the vocabulary; other ids don't count."""
    spark = tokens.sparkSession
    seen = tokens.filter(F.col("token_id").between(0, vocab_size - 1)).groupBy("token_id").agg(F.count("*").alias("n"))
    return spark.range(vocab_size).select(F.col("id").cast("int").alias("token_id")).join(seen, "token_id", "left").select("token_id", F.coalesce("n", F.lit(0)).alias("n"))


def negative_table(counts: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(token_id, first_slot, n_slots): slots in proportion to count**0.75; the first slot is always that of id 0.

    The running sum is over the vocabulary, which one task holds.
    """
    by_id = Window.orderBy("token_id")
    run = by_id.rowsBetween(Window.unboundedPreceding, 0)
    weighed = counts.withColumn("cum", F.sum(F.pow(F.col("n").cast("double"), F.lit(POWER))).over(run))
    everything = Window.orderBy("token_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.max("cum").over(everything)
    last_id = F.max("token_id").over(everything)
    share = F.when(total > 0, F.least(F.floor(F.col("cum") / total * slots), F.lit(slots - 1))).otherwise(F.lit(slots - 1))
    hi = weighed.withColumn("hi", F.when(F.col("token_id") == last_id, slots - 1).otherwise(share).cast("long"))
    low = F.lag("hi").over(by_id)
    first = F.when(F.col("token_id") == 0, 0).otherwise(F.coalesce(low, F.lit(0)) + 1)
    return hi.select("token_id", first.cast("long").alias("first_slot"), (F.col("hi") - first + 1).cast("long").alias("n_slots"))


def expand_slots(table: DataFrame) -> DataFrame:
    """(slot, token_id), a row a slot."""
    return table.filter("n_slots > 0").select(F.explode(F.sequence("first_slot", F.col("first_slot") + F.col("n_slots") - 1)).alias("slot"), "token_id")


def negative_slot(i: Column, j: Column, k: Column, slots: int) -> Column:
    """The slot of the k-th sample for positions i and j, all counted from 1."""
    return F.pmod(7 * i.cast("long") + 13 * j.cast("long") + 17 * k.cast("long"), F.lit(slots))


def skipgram_pairs(tokens: DataFrame, window: int = 5, within_doc: bool = False) -> DataFrame:
    """(i, j, center, context): all pairs of positions at most `window` apart, each way.

    The stream is cut into blocks of positions, each with a margin of `window` tokens from
    both sides, so every token is shuffled once (and those in margins twice) whatever the
    window; pairs are made inside the blocks.
    """
    size = max(BLOCK, 2 * window)
    pos = F.col("pos")
    homes = F.array_distinct(F.array(F.floor((pos - window) / size), F.floor(pos / size), F.floor((pos + window) / size)))
    at_home = tokens.select(F.explode(homes).alias("block"), F.struct("pos", "token_id", F.col("doc_id") if within_doc else F.lit(0).alias("doc_id")).alias("t"))
    blocks = at_home.groupBy("block").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    centers = blocks.select("block", "ts", F.posexplode("ts").alias("k", "c")).filter(F.floor(F.col("c.pos") / size) == F.col("block"))
    near = F.slice("ts", F.greatest(F.col("k") + 1 - window, F.lit(1)), F.lit(2 * window + 1))
    pairs = centers.select("c", F.explode(near).alias("x")).filter((F.abs(F.col("x.pos") - F.col("c.pos")) <= window) & (F.col("x.pos") != F.col("c.pos")))
    if within_doc:
        pairs = pairs.filter(F.col("x.doc_id").eqNullSafe(F.col("c.doc_id")))
    return pairs.select(F.col("c.pos").alias("i"), F.col("x.pos").alias("j"), F.col("c.token_id").alias("center"), F.col("x.token_id").alias("context"))


def negative_samples(pairs: DataFrame, table: DataFrame, n_neg: int = 5, slots: int = SLOTS) -> DataFrame:
    """The pairs with k and neg_id, n_neg rows a pair."""
    drawn = pairs.select("*", F.explode(F.sequence(F.lit(1), F.lit(n_neg))).alias("k"))
    drawn = drawn.withColumn("slot", negative_slot(F.col("i") + 1, F.col("j") + 1, F.col("k"), slots))
    filled = expand_slots(table).withColumnRenamed("token_id", "neg_id")
    return drawn.join(F.broadcast(filled) if slots <= 4 * SLOTS else filled, "slot").drop("slot")  # a row a slot, whatever the corpus
