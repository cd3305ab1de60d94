"""Format-preserving pseudonyms for personal data by keyed Feistel permutations.

Each kind of value is validated (Luhn, octets, calendar, IBAN check, ...), turned into
a number below the count of its format's values, permuted by a Feistel network with
cycle walking, and written in the same format with the same length.  Equal values get
equal pseudonyms in every document; other text stays as it is.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
import secrets

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import chunks, settle

ROUNDS = 8
EPOCH, DAYS = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal() - dt.date(1900, 1, 1).toordinal() + 1


def key_of(spark: SparkSession) -> bytes:
    """The key in the session's setting `spark.glyphmill.pseudonymKey`; without it a new one, kept in the session, so values are linked within its runs only."""
    key = spark.conf.get("spark.glyphmill.pseudonymKey", None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set("spark.glyphmill.pseudonymKey", key)
    return key.encode()


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size), or its inverse (see Inverse)."""
    if size < 2:
        return value
    half = (max(2, (size - 1).bit_length()) + 1) // 2
    mask, width = (1 << half) - 1, (half + 7) // 8

    def word(r, part):
        head, need, out = b"%d|" % r + tweak.encode() + b"|" + part.to_bytes(width, "big"), width + 1, b""
        while len(out) < need:  # a digest has at most 64 bytes
            out += hashlib.blake2b(head + (b"|%d" % len(out) if out else b""), key=key[:64], digest_size=min(64, max(8, need - len(out)))).digest()
        return int.from_bytes(out, "big") & mask

    while True:
        left, right = value >> half, value & mask
        if isinstance(key, Inverse):
            for r in reversed(range(ROUNDS)):
                left, right = right ^ word(r, left), left
        else:
            for r in range(ROUNDS):
                left, right = right, left ^ word(r, right)
        value = left << half | right
        if value < size:
            return value


class Inverse(bytes):
    """A key with which pseudonyms become the values again."""


def mixed(text: str, key: bytes, kind: str) -> str:
    """Letters among letters (case kept), digits among digits, all else in place."""
    value, size, shape = 0, 1, []
    for c in text:
        radix = 10 if "0" <= c <= "9" else 26 if c.isascii() and c.isalpha() else 1
        shape.append(radix)
        if radix > 1:
            value, size = value * radix + (ord(c) - 48 if radix == 10 else ord(c.lower()) - 97), size * radix
    value = permute(value, size, key, kind + ",".join(map(str, shape)))
    out = []
    for c, radix in zip(reversed(text), reversed(shape)):
        if radix > 1:
            value, d = divmod(value, radix)
            out.append(chr(48 + d) if radix == 10 else chr(97 + d).upper() if c.isupper() else chr(97 + d))
        else:
            out.append(c)
    return "".join(reversed(out))


def radices(values: list[int], sizes: list[int], key: bytes, kind: str) -> list[int]:
    """Several digits of different radix, permuted as one number."""
    number, size = 0, 1
    for v, s in zip(values, sizes):
        number, size = number * s + v, size * s
    number = permute(number, size, key, kind + ",".join(map(str, sizes)))
    out = []
    for s in reversed(sizes):
        number, v = divmod(number, s)
        out.append(v)
    return out[::-1]


def refill(text: str, digits: str) -> str:
    """The text with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in text)


def luhn(digits: str) -> int:
    """The check digit that makes the number valid."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _card(m, key):
    digits = re.sub(r"\D", "", m[0])
    if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    body = digits[0] + str(permute(int(digits[1:-1]), 10 ** (len(digits) - 2), key, f"card{len(digits)}{digits[0]}")).zfill(len(digits) - 2)
    return refill(m[0], body + str(luhn(body)))


def _phone(m, key):
    digits = re.sub(r"\D", "", m[0])
    country = ""
    if m[0].startswith("+") and digits[0] == "1" and len(digits) == 11 or len(digits) == 11 and digits[0] == "1":
        country, digits = "1", digits[1:]
    elif m[0].startswith("+"):
        n = 1 if digits[0] == "7" else 2 if digits[:2] in TWO_DIGITS else 3
        country, digits = digits[:n], digits[n:]
        if not 5 <= len(digits) <= 13:
            return None
        return refill(m[0], country + str(permute(int(digits), 10 ** len(digits), key, f"phone{country}")).zfill(len(digits)))
    if len(digits) != 10 or digits[0] in "01" and not m[0].startswith("+"):
        return None
    low = [0 if digits[k] in "01" else 200 for k in (0, 3)]  # codes that can be assigned stay such codes
    area, office, line = radices([int(digits[:3]) - low[0], int(digits[3:6]) - low[1], int(digits[6:])], [800 if low[0] else 200, 800 if low[1] else 200, 10_000], key, "phone1")
    return refill(m[0], country + f"{area + low[0]:03d}{office + low[1]:03d}{line:04d}")


#: country codes of two digits; 1 and 7 have one, all others three
TWO_DIGITS = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _address(m, key):
    parts = m[0].split(".")
    if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
        return None
    low, size = {1: 0, 2: 10, 3: 100}, {1: 10, 2: 90, 3: 156}
    new = radices([int(p) - low[len(p)] for p in parts], [size[len(p)] for p in parts], key, "ip")
    return ".".join(str(v + low[len(p)]) for v, p in zip(new, parts))


def _social(m, key):
    area, group, serial = map(int, m[0].split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    a, g, s = radices([area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999], key, "ssn")
    return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{s + 1:04d}"


def _is_date(year: int, month: int, day: int) -> bool:
    try:
        return 1900 <= dt.date(year, month, day).year <= 2099
    except ValueError:
        return False


def _date(m, key):
    """Year first: a day among all days."""
    if not _is_date(int(m[1]), int(m[3]), int(m[4])):
        return None
    day = dt.date(int(m[1]), int(m[3]), int(m[4])).toordinal() - EPOCH
    new = dt.date.fromordinal(permute(day, DAYS, key, "date") + EPOCH)
    return f"{new.year:04d}{m[2]}{new.month:02d}{m[2]}{new.day:02d}"


def _short_date(m, key):
    """Year last: a text among all texts that are a date of the separator's orders; dots are day first, dashes month first, strokes either."""
    orders = {".": "d", "-": "m", "/": "dm"}[m[2]]

    def valid(a, b, year):
        return "d" in orders and _is_date(year, b, a) or "m" in orders and _is_date(year, a, b)

    a, b, year = int(m[1]), int(m[3]), int(m[4])
    if not valid(a, b, year):
        return None
    size = 200 * 31 * 31
    number = (year - 1900) * 961 + (a - 1) * 31 + b - 1
    while True:  # cycle walking stays among the valid texts
        number = permute(number, size, key, "date" + m[2])
        year, a, b = number // 961 + 1900, number // 31 % 31 + 1, number % 31 + 1
        if valid(a, b, year):
            return f"{a:02d}{m[2]}{b:02d}{m[2]}{year:04d}"


def _iban(m, key):
    text = m[0]
    value = lambda t: int("".join(str(int(c, 36)) for c in t))
    if not 15 <= len(text) <= 34 or value(text[4:] + text[:4]) % 97 != 1:
        return None
    body = mixed(text[4:], key, "iban" + text[:2])
    return text[:2] + f"{98 - value(body + text[:2] + '00') % 97:02d}" + body


def _email(m, key):
    return mixed(m[1], key, "mail" + m[2].lower()) + "@" + m[2]


def _secret(m, key):
    return m[1] + mixed(m[2], key, "secret" + m[1])


def _hexadecimal(m, key):
    if m[0].isdigit() or m[0].isalpha():
        return None
    text = m[0].lower()
    new = f"{permute(int(text, 16), 16 ** len(text), key, 'hex'):0{len(text)}x}"
    return new.upper() if m[0].isupper() else new


RULES = [
    (re.compile(r"(?<![\w.+%-])([A-Za-z0-9_](?:[\w.+%-]*[\w%+-])?)@((?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})(?![\w])", re.A), _email),
    (re.compile(r"\b(AKIA|ASIA)([A-Z0-9]{16})\b", re.A), _secret),
    (re.compile(r"\b(ghp_|gho_|sk-|xox[bp]-)([A-Za-z0-9-]{16,})\b", re.A), _secret),
    (re.compile(r"(?i)\b((?:password|passwd|pwd|secret|token|api_?key)[=:] ?)([A-Za-z0-9]{6,})\b", re.A), _secret),
    (re.compile(r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", re.A), _iban),
    (re.compile(r"(?<![\w])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![\w])", re.A), _hexadecimal),
    (re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)", re.A), _address),
    (re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.A), _social),
    (re.compile(r"(?<![\w/.-])(\d{4})([-/.])(\d{2})\2(\d{2})(?![\w/-])", re.A), _date),
    (re.compile(r"(?<![\w/.-])(\d{2})([./-])(\d{2})\2(\d{4})(?![\w/-])", re.A), _short_date),
    (re.compile(r"(?<![\w+])\d(?:[ -]?\d){12,18}(?![\w])", re.A), _card),
    (re.compile(r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){1,5}(?:[ .-]\d{2,4})?(?![\w])", re.A), _phone),
    (re.compile(r"(?<![\w+.-])(?:1[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])", re.A), _phone),
]


def pseudonymise(text: str, key: bytes) -> tuple[str, int]:
    """The text with every valid value replaced, and how many were; where values overlap the earlier rule counts."""
    taken: list[tuple[int, int, str]] = []  # in the order of the text
    for pattern, rule in RULES:
        found, k = [], 0
        for m in pattern.finditer(text):  # matches and what is taken are both in order: one sweep
            while k < len(taken) and taken[k][1] <= m.start():
                k += 1
            if k < len(taken) and taken[k][0] < m.end():
                continue
            new = rule(m, key)
            if new is not None:
                found.append((m.start(), m.end(), new))
        if found:
            taken = sorted(taken + found)
    if not taken:
        return text, 0
    out, at = [], 0
    for a, b, new in taken:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), len(taken)


def replace_texts(column: pa.Array, key: bytes) -> tuple[pa.Array, np.ndarray]:
    """The column with pseudonyms, and how many values each text had."""
    settle()
    counts, changed, values = np.zeros(len(column), np.int64), np.zeros(len(column), bool), []
    for k, text in enumerate(column.to_pylist()):
        if text:
            new, counts[k] = pseudonymise(text, key)
            if counts[k]:
                changed[k] = True
                values.append(new)
    return pa.compute.replace_with_mask(column, pa.array(changed), pa.array(values, column.type)) if values else column, counts


def pseudonyms(docs: DataFrame, key: bytes, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """The documents with pseudonyms in their texts; optionally a column with the number of values replaced.

    `key` is the secret of the permutations; Inverse(key) gives the values back where rules don't overlap.
    Every pseudonym is as long as its value, so lengths and positions hold.  A null
    text stays null (0 values), an empty one empty; other columns and rows, repeated
    ones too, stay as they are; count_col must be a new name.
    """
    if not key:
        raise ValueError("the pseudonyms need a key")
    if count_col in docs.columns:
        raise ValueError(f"the documents have a column {count_col} of their own")
    at = docs.columns.index(text_col)
    plain = docs.withColumn(text_col, F.col(f"`{text_col}`").cast("string"))
    schema = plain.schema if count_col is None else plain.withColumn(count_col, F.lit(0).cast("long")).schema

    def run(batches):
        for batch in batches:
            for piece in chunks(batch, at):
                new, counts = replace_texts(piece.column(at), key)
                columns = [*piece.columns[:at], new, *piece.columns[at + 1 :]]
                names = list(piece.schema.names)
                if count_col is not None:
                    columns, names = [*columns, pa.array(counts)], [*names, count_col]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return plain.mapInArrow(run, schema)
