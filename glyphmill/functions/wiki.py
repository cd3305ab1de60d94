"""Wiki markup to text.  Templates and links nest, so this is the one text function that regular expressions alone can't express."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


_MARK = re.compile(r"<!--|<ref|\{\{|\{\||\[\[|''+|=+")
_SPACE = "".join(chr(c) for c in [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
_HIDDEN = ("Category:", "File:", "Image:")


def _closing(text: str, at: int, mark: re.Pattern, opening: str) -> int | None:
    """Where the mark that closes the one before `at` begins."""
    depth = 1
    for m in mark.finditer(text, at):
        depth += 1 if m[0] == opening else -1
        if not depth:
            return m.start()
    return None


_BRACES, _BRACKETS = re.compile(r"\{\{|\}\}"), re.compile(r"\[\[|\]\]")


def strip(text: str) -> str:
    """The text without comments, references, templates, tables, emphasis and heading marks; links keep what they show."""
    out, at = [], 0
    while m := _MARK.search(text, at):
        i, mark = m.start(), m[0]
        out.append(text[at:i])
        at = m.end()
        if mark == "<!--":
            end = text.find("-->", i)
            if end < 0:
                out.append("<")
                at = i + 1
            else:
                at = end + 3
        elif mark == "<ref":
            for close in ("</ref>", "/>"):
                if (end := text.find(close, i)) >= 0:
                    at = end + len(close)
                    break
        elif mark == "{{":
            end = _closing(text, at, _BRACES, "{{")
            at = len(text) if end is None else end + 2
        elif mark == "{|":
            end = text.find("|}", i)
            if end < 0:
                out.append("{")
                at = i + 1
            else:
                at = end + 2
        elif mark == "[[":
            end = _closing(text, at, _BRACKETS, "[[")
            inner = text[at:end]
            at = len(text) if end is None else end + 2
            if "|" in inner:
                out.append(inner.rpartition("|")[2])
            elif not inner.startswith(_HIDDEN):
                out.append(inner)
        elif mark[0] == "=":
            if i == 0 or text[i - 1] == "\n":
                at += text.startswith(" ", at)
            elif mark == "=" and not text.startswith("\n", at):
                out.append("=")
    out.append(text[at:])
    return "".join(out).strip(_SPACE)


AT_ONCE = 64


def _strip(texts: pa.Array) -> pa.Array:
    """Of a batch, few texts at a time are Python strings, as those of a whole batch take several times its memory."""
    done = [pa.array([None if x is None else strip(x) for x in texts[a : a + AT_ONCE].to_pylist()], pa.string()) for a in range(0, len(texts), AT_ONCE)]
    return pa.concat_arrays(done) if done else pa.array([], pa.string())


def strip_wikitext(text: Column) -> Column:
    return F.arrow_udf(_strip, "string")(text)


def single_line_tag(line: Column, tag: str) -> Column:
    """What is between the first opening and the first closing tag of a line; null if that is nothing."""
    start, end = F.instr(line, f"<{tag}>") + len(tag) + 2, F.instr(line, f"</{tag}>")
    return F.when((F.instr(line, f"<{tag}>") > 0) & (end > start), F.substring(line, start, end - start))


