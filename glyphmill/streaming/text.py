"""Text streams: the normalisation and pre-tokenisation expressions hold no state and run on unbounded input as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import MAX_LINE_BYTES, cut_bytes, normalize, pretokenize


def read_text_stream(spark: SparkSession, folder: str, most: int = MAX_LINE_BYTES) -> DataFrame:
    """(value), a row a line of the files that appear in a folder."""
    raw = spark.readStream.option("lineSep", "\n").text(folder)
    return raw.select(cut_bytes(F.regexp_replace(F.make_valid_utf8("value"), r"\r\z", ""), most).alias("value"))


def pretoken_stream(lines: DataFrame, text_col: str = "value") -> DataFrame:
    return lines.select(F.explode(pretokenize(normalize(F.col(text_col)))).alias("tok"))


def pretoken_count_stream(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """(tok, freq), complete or update mode."""
    return pretoken_stream(lines, text_col).groupBy("tok").agg(F.count("*").alias("freq"))


def windowed_pretoken_counts(lines: DataFrame, time_col: str, text_col: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """(window, tok, freq) by event time; lines later than the watermark don't count."""
    each = lines.withWatermark(time_col, late).select(F.col(time_col), F.explode(pretokenize(normalize(F.col(text_col)))).alias("tok"))
    return each.groupBy(F.window(time_col, width), "tok").agg(F.count("*").alias("freq"))
