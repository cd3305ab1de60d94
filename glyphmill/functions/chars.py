"""Character classes and translation tables, as text that Spark's and DuckDB's regular expressions both read."""

from __future__ import annotations


def _class(*ranges: int | tuple[int, int]) -> str:
    return "".join(rf"\x{{{r:X}}}" if isinstance(r, int) else rf"\x{{{r[0]:X}}}-\x{{{r[1]:X}}}" for r in ranges)


CJK = _class(
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F),
    (0x2B820, 0x2CEAF), (0x2CEB0, 0x2EBEF), (0x2EBF0, 0x2EE5F), (0x2F800, 0x2FA1F), (0x30000, 0x3134F), (0x31350, 0x323AF),
)
HANGUL = _class((0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7AF), (0xD7B0, 0xD7FF))
HIRAGANA = _class((0x3040, 0x309F))
KATAKANA = _class((0x30A0, 0x30FF), (0x31F0, 0x31FF))
EAST_ASIAN = CJK + HANGUL + HIRAGANA + KATAKANA
WHITESPACE = _class((0x9, 0xD), 0x20, 0x85, 0xA0, 0x1680, (0x2000, 0x200A), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
ASCII_PUNCTUATION = _class((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
ALONE = _class((0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))  # all of it but the apostrophe

CLASSES = {"cjk": CJK, "hangul": HANGUL, "hiragana": HIRAGANA, "katakana": KATAKANA, "east_asian": EAST_ASIAN, "whitespace": WHITESPACE, "ascii_punctuation": ASCII_PUNCTUATION}
PRETOKEN = f"[{CJK}]|[{ALONE}]|[^{WHITESPACE}{CJK}{ALONE}]+"


def quick_pretoken(also_alone: str = "") -> str:
    """What PRETOKEN finds, for Java's regular expressions: ASCII letters and spaces are told by short tests, which those of long classes aren't."""
    inside = f"[^{WHITESPACE}{CJK}{ALONE}{also_alone}]"
    return f"(?! )(?:[A-Za-z]++{inside}*+|{inside}++|[{ALONE}{also_alone}]|[{CJK}])"


# German, French and Polish capitals are lowered besides ASCII; those of other alphabets stay.
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "ÄÖÜ" + "ÀÂÆÇÈÉÊËÎÏÔŒÙÛŸ" + "ĄĆĘŁŃÓŚŹŻ"
_SINGLE, _DOUBLE, _DASHES = ("".join(map(chr, range(a, b))) for a, b in ((0x2018, 0x201C), (0x201C, 0x2020), (0x2010, 0x2016)))
FROM = _CAPITALS + _SINGLE + _DOUBLE + _DASHES
TO = _CAPITALS.lower() + "'" * len(_SINGLE) + '"' * len(_DOUBLE) + "-" * len(_DASHES)
ELLIPSIS = "…"
RAW_PRETOKEN = quick_pretoken(_class((0x201C, 0x201F), (0x2010, 0x2015), ord(ELLIPSIS)))  # of texts that aren't normalised: what becomes punctuation stands alone
