"""Articles of a wiki dump.  The scan is split at page ends, so one dump is read by many tasks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.wiki import _SPACE, strip_wikitext

PAGE = "title string, namespace int, text string"


def _between(line: str, tag: str) -> str | None:
    start, end = line.find(f"<{tag}>") + len(tag) + 2, line.find(f"</{tag}>")
    return line[start:end] if start < end else None


def _number(text: str) -> int:
    digits = text[1:] if text[:1] in "+-" else text
    return int(text) if digits.isascii() and digits.isdigit() and abs(int(text)) < 1 << 31 else 0


def parse_page(chunk: str) -> tuple[str, int, str] | None:
    """Title, namespace and body of the lines up to a page's end; None if no page begins there.

    Lines are trimmed.  Only an opening tag <text> without attributes begins a body; the
    body's last line is joined without a newline, the others with one.
    """
    title, namespace, body, where = "", 0, "", None
    for raw in chunk.split("\n"):
        line = raw.strip(_SPACE)
        if where is None:
            if "<page>" in line:
                where, title, namespace, body = "page", "", 0, ""
        elif where == "page":
            if "<title>" in line:
                got = _between(line, "title")
                title, where = (got, "page") if got is not None else (title, "title")
            elif "<ns>" in line:
                got = _between(line, "ns")
                namespace = namespace if got is None else _number(got)
            elif "<text>" in line:
                content = line[line.find(">") + 1 :]
                body, closed, _ = content.partition("</text>")
                where = "page" if closed else "text"
        else:
            part, closed, _ = line.partition(f"</{where}>")
            if where == "title":
                title += part
            else:
                body += part if closed else "\n" + part
            where = "page" if closed else where
    return None if where is None else (title, namespace, body)


def _parse(chunks: pd.Series) -> pd.DataFrame:
    found = [parse_page(c) or (None, None, None) for c in chunks.fillna("")]
    return pd.DataFrame(found, columns=["title", "namespace", "text"]).astype({"namespace": "Int32"})


def parse_articles(chunks: DataFrame, main_only: bool = True, compat: bool = True) -> DataFrame:
    """(title, namespace, text) of page chunks (value).

    compat keeps the rules of parse_page; otherwise tags may have attributes and span
    lines, and XML entities are decoded.  The namespace is tested before markup is stripped.
    """
    chunks = chunks.filter(F.col("value").contains("<page>"))
    if compat:
        pages = chunks.select(F.pandas_udf(_parse, PAGE)("value").alias("p")).select("p.*").filter("title is not null")
    else:
        value = F.col("value")
        plain = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
        pages = chunks.select(
            plain(F.regexp_extract(value, r"(?s)<title[^>]*>(.*?)</title>", 1)).alias("title"),
            F.coalesce(F.regexp_extract(value, r"<ns>\s*([+-]?\d{1,9})\s*</ns>", 1).try_cast("int"), F.lit(0)).alias("namespace"),
            plain(F.regexp_extract(value, r"(?s)<text[^>]*>(.*?)</text>", 1)).alias("text"),
        )
    if main_only:
        pages = pages.filter("namespace = 0")
    return pages.withColumn("text", strip_wikitext(F.col("text")))


def read_articles(spark: SparkSession, path: str, main_only: bool = True, compat: bool = True) -> DataFrame:
    return parse_articles(spark.read.option("lineSep", "</page>").text(path).select(F.make_valid_utf8("value").alias("value")), main_only, compat)
