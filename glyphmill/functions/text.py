"""Normalisation, pre-tokenisation and script predicates, all inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chars

MAX_LINE_BYTES = 10 << 20


def squeeze(text: Column) -> Column:
    """Runs of Unicode white space become one space; none stays at the ends."""
    return F.trim(F.regexp_replace(text, f"[{chars.WHITESPACE}]+", " "))


def normalize(text: Column) -> Column:
    """Lower-case ASCII, German, French and Polish letters, plain quotes, dashes and dots, single spaces."""
    return squeeze(F.replace(F.translate(text, chars.FROM, chars.TO), F.lit(chars.ELLIPSIS), F.lit("...")))


def pretokenize(text: Column) -> Column:
    """array<string>: CJK characters and ASCII punctuation alone, everything else up to the next of these or white space."""
    return F.regexp_extract_all(text, F.lit(chars.quick_pretoken()), F.lit(0))


def raw_pretokens(text: Column) -> Column:
    """array<string>: the pre-tokens of a text that isn't normalised, each as it stands there; an ellipsis is one.

    normalize changes no character's class, so normalized_pretoken of each gives the pre-tokens of the normalised text.
    """
    return F.regexp_extract_all(text, F.lit(chars.RAW_PRETOKEN), F.lit(0))


def normalized_pretoken(raw: Column) -> Column:
    """Of an element of raw_pretokens; an ellipsis becomes one dot, of which there are three."""
    return F.translate(raw, chars.FROM + chars.ELLIPSIS, chars.TO + ".")


def has_class(text: Column, name: str) -> Column:
    """Whether any character belongs to a class of chars.CLASSES."""
    return text.rlike(f"[{chars.CLASSES[name]}]")


def is_class(char: Column, name: str) -> Column:
    """Whether the string is one character of the class."""
    return char.rlike(rf"\A[{chars.CLASSES[name]}]\z")


def count_class(text: Column, name: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{chars.CLASSES[name]}]+", ""))


def class_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(class, n_texts, n_chars): for each class the texts that hold one of its characters, and these characters.

    Letters and spaces of ASCII are most of a text and belong to no class but white space, so they are taken out once
    and spaces counted by themselves; runs go at once.  A partition sends one row.
    """
    text, left = F.col("text"), F.col("left")
    kept = texts.select(F.col(text_col).alias("text"), F.regexp_replace(F.col(text_col), "[ A-Za-z]+", "").alias("left"))
    kept = kept.select((F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).alias("spaces"), "left", F.regexp_replace(left, r"[\x00-\x{10FF}]+", "").alias("high"))

    def number(name: str) -> Column:
        if name == "whitespace":
            return F.col("spaces") + count_class(left, name)
        return count_class(left if name == "ascii_punctuation" else F.col("high"), name)

    counts = kept.select(*[number(k).alias(k) for k in chars.CLASSES])
    sums = counts.agg(*[F.struct(F.lit(k).alias("class"), F.count_if(F.col(k) > 0).alias("n_texts"), F.coalesce(F.sum(F.col(k).cast("long")), F.lit(0).cast("long")).alias("n_chars")).alias(k) for k in chars.CLASSES])
    return sums.select(F.inline(F.array(*chars.CLASSES)))


def cut_bytes(value: Column, most: int) -> Column:
    """The longest prefix of whole characters in `most` UTF-8 bytes."""
    raw = F.encode(value, "UTF-8")
    prefixes = [F.try_validate_utf8(F.substring(raw, 1, most - k).cast("string")) for k in range(min(4, most + 1))]
    return F.when(F.octet_length(value) <= most, value).otherwise(F.coalesce(*prefixes))


def lines(text: Column, most: int = MAX_LINE_BYTES) -> Column:
    """array<string> of the lines of a text: split at newlines only, one CR before a newline goes, nothing follows a final newline."""
    parts = F.split(text, "\n", -1)
    ended = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda line: F.regexp_replace(line, r"\r\z", ""))
    last = F.element_at(parts, -1)
    whole = F.when(last == "", ended).otherwise(F.concat(ended, F.array(last)))
    return F.transform(whole, lambda line: cut_bytes(line, most))
