"""Chat formatting on tokens: segments are encoded one by one and reserved ids spliced between them.

A conversation is  BOS (START role SEP content END)*  over its turns in order.  The loss
mask is 1 on the content and END of trained roles, taken as a prefix sum of +1 where such a
span begins and -1 behind it.  Control strings in a role or content are escaped, so
they can neither be read as control tokens here nor by a tokenizer that knows them.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTROLS = ("<|endoftext|>", "<|im_start|>", "<|im_sep|>", "<|im_end|>")
_BLANKS = re.compile(r"[\t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000 ]{1000,}")  # what the pattern's \s matches
_NAMES = "|".join(re.escape(c[2:-2]) for c in CONTROLS)
_PLAIN, _ESCAPED = re.compile(rf"<(\\*)\|({_NAMES})\|>"), re.compile(rf"<\\(\\*)\|({_NAMES})\|>")


def escape(text: str) -> str:
    """One backslash more behind the < of each control string, escaped ones included; unescape undoes it."""
    return _PLAIN.sub(lambda m: f"<\\{m[1]}|{m[2]}|>", text) if "|>" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: f"<{m[1]}|{m[2]}|>", text)


def encoding(path: str = VOCABULARY):
    """The tokenizer of a rank file; its controls get the ids from its size on."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


def encoder(tokens):
    """The tokenizer's plain encoding for texts of any length.

    Its pattern recurses over a run of white space.  All of a run but its last character is one piece (all of
    it at the end of a text), so long runs are encoded as pieces and what lies between them as texts.
    """

    def encode(text: str) -> list[int]:
        out, at = [], 0
        for m in _BLANKS.finditer(text):
            stop = m.end() if m.end() == len(text) else m.end() - 1
            out += tokens.encode_ordinary(text[at : m.start()])
            out += tokens._core_bpe.encode_single_piece(text[m.start() : stop].encode())
            at = stop
        return out + tokens.encode_ordinary(text[at:])

    return encode


def assemble(roles: list[list], contents: list[list], encode, first: int, trained: frozenset[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ids and mask of each conversation; BOS, START, SEP and END are first ... first + 3."""
    bos, start, sep, end = range(first, first + 4)
    pieces, sizes, marks, total = [], [], [], 0
    for own_roles, own_contents in zip(roles, contents):
        begin, total = total, total + 1
        pieces.append([bos])
        for role, content in zip(own_roles, own_contents):
            head, body = encode(escape(role or "")), encode(escape(content or ""))
            pieces += [[start], head, [sep], body, [end]]
            total += 2 + len(head)
            if role in trained:
                marks.append((total, total + len(body) + 1))
            total += len(body) + 1
        sizes.append(total - begin)
    ids = np.fromiter((i for p in pieces for i in p), np.int32, total)
    step = np.zeros(total + 1, np.int32)
    if marks:
        a, b = np.array(marks).T
        np.add.at(step, a, 1)
        np.add.at(step, b, -1)
    mask = np.cumsum(step[:-1], dtype=np.int32)
    cut = np.cumsum(sizes)[:-1] if sizes else []
    return (np.split(ids, cut), np.split(mask, cut)) if sizes else ([], [])


def parse(ids, encoding_, first: int) -> list[tuple[str, str]]:
    """(role, content) of the turns of one conversation's ids: the inverse of assemble."""
    out, at = [], 1
    while at < len(ids):
        sep = next(k for k in range(at, len(ids)) if ids[k] == first + 2)
        end = next(k for k in range(sep, len(ids)) if ids[k] == first + 3)
        out.append(tuple(unescape(encoding_.decode(list(map(int, ids[a:b])))) for a, b in ((at + 1, sep), (sep + 1, end))))
        at = end + 1
    return out


def formatted(turns: DataFrame, vocabulary: str = VOCABULARY, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, n_turns, n_tokens, n_trained, input_ids, loss_mask), one row for each conversation.

    `vocabulary` is a rank file that every worker can read.

    Turns are ordered by (turn, role, text), nulls first.  A null or empty text is an
    empty content, a null role an empty one that isn't trained.  Each turn without conv_id
    is a conversation of its own with conv_id null.  Repeated rows are repeated turns.  Other
    columns are ignored; an empty table gives no rows.
    """
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).alias("t"))
    grouped = own.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    each = grouped.unionByName(own.filter("conv_id is null").select("conv_id", F.array("t").alias("t"))).select("conv_id", F.col("t.role").alias("roles"), F.col("t.text").alias("contents"))

    def run(batches):
        tokens, first = encoding(vocabulary)
        encode = encoder(tokens)
        for batch in batches:
            roles = batch.column(1).to_pylist()
            ids, mask = assemble(roles, batch.column(2).to_pylist(), encode, first, frozenset(trained))
            sizes = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat, marks = np.concatenate(ids), np.concatenate(mask)
            totals = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
            lists = [pa.ListArray.from_arrays(pa.array(sizes), pa.array(v)) for v in (flat, marks)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(r) for r in roles], pa.int64()), pa.array(np.diff(sizes).astype(np.int64)), pa.array(np.diff(totals[sizes])), *lists], names=["conv_id", "n_turns", "n_tokens", "n_trained", "input_ids", "loss_mask"]
            )

    return each.mapInArrow(run, "conv_id long, n_turns long, n_tokens long, n_trained long, input_ids array<int>, loss_mask array<int>")
