"""Plain text and HTML files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import strip_html
from ..functions.text import MAX_LINE_BYTES, cut_bytes, lines


def read_text(spark: SparkSession, path: str, most: int = MAX_LINE_BYTES) -> DataFrame:
    """(value), one row a line; invalid bytes become replacement characters."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(cut_bytes(F.regexp_replace(F.make_valid_utf8("value"), r"\r\z", ""), most).alias("value"))


def text_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_LINE_BYTES) -> DataFrame:
    """(doc_id, line_no, value) of the lines of a text column, numbered from 0."""
    return docs.select(F.col(id_col), F.posexplode(lines(F.col(text_col), most)).alias("line_no", "value"))


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """(path, text), one row a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), strip_html(F.make_valid_utf8("value")).alias("text"))
