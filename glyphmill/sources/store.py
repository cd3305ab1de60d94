"""Vocabularies and models: Parquet, and the two binary formats."""

from __future__ import annotations

import struct
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..operators.bpe import Vocabulary

MOST_TOKEN_BYTES = 8 << 20
VOCABULARY_MAGIC, MODEL_MAGIC = b"BPE\0", b"WVCK"
MODEL_HEADER = "<4siiiif"
HEADER_BYTES = struct.calcsize(MODEL_HEADER)


class FormatError(ValueError):
    """A file that isn't of the format, or not of a version that is known."""


def dump_vocabulary(vocabulary: Vocabulary) -> bytes:
    out = [VOCABULARY_MAGIC, struct.pack("<3I", 1, len(vocabulary.tokens), len(vocabulary.rules))]
    for token in vocabulary.tokens:
        raw = token.encode()
        out += [struct.pack("<I", len(raw)), raw]
    out += [struct.pack("<3I", *rule) for rule in vocabulary.rules]
    return b"".join(out)


def parse_vocabulary(data: bytes) -> Vocabulary:
    if data[:4] != VOCABULARY_MAGIC:
        raise FormatError("invalid magic bytes")
    try:
        version, n_tokens, n_rules = struct.unpack_from("<3I", data, 4)
        if version != 1:
            raise FormatError(f"unsupported version: {version}")
        at, tokens = 16, {}
        for _ in range(n_tokens):
            (n,) = struct.unpack_from("<I", data, at)
            if n > MOST_TOKEN_BYTES:
                raise FormatError(f"token too long: {n} bytes")
            if at + 4 + n > len(data):
                raise FormatError("the file ends early")
            tokens.setdefault(data[at + 4 : at + 4 + n].decode(), len(tokens))
            at += 4 + n
        return Vocabulary(list(tokens), [struct.unpack_from("<3I", data, at + 12 * k) for k in range(n_rules)])
    except (struct.error, UnicodeDecodeError) as broken:
        raise FormatError(str(broken)) from broken


def _file(path: str):
    """A path with a scheme, and its file system in Spark's JVM."""
    context = SparkSession.active().sparkContext
    own = context._jvm.org.apache.hadoop.fs.Path(path)
    return context, own, own.getFileSystem(context._jsc.hadoopConfiguration())


def write_bytes(path: str, data: bytes) -> None:
    """To a local path, or to a URI that Hadoop knows."""
    if "://" not in path:
        Path(path).write_bytes(data)
        return
    _, own, files = _file(path)
    out = files.create(own, True)
    for k in range(0, len(data), 1 << 24):
        out.write(bytearray(data[k : k + (1 << 24)]))
    out.close()


def read_bytes(path: str) -> bytes:
    if "://" not in path:
        return Path(path).read_bytes()
    context, own, files = _file(path)
    if not files.exists(own):
        raise FileNotFoundError(path)
    stream = files.open(own)
    try:
        return bytes(context._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def save_vocabulary(vocabulary: Vocabulary, path: str) -> None:
    write_bytes(path, dump_vocabulary(vocabulary))


def load_vocabulary(path: str) -> Vocabulary:
    return parse_vocabulary(read_bytes(path))


def write_vocabulary(spark: SparkSession, vocabulary: Vocabulary, path: str) -> None:
    """Parquet tables tokens(id, token) and rules(rank, left, right, id)."""
    vocabulary.tokens_frame(spark).write.mode("overwrite").parquet(f"{path}/tokens")
    vocabulary.rules_frame(spark).write.mode("overwrite").parquet(f"{path}/rules")


def read_vocabulary(spark: SparkSession, path: str) -> Vocabulary:
    tokens = [r.token for r in spark.read.parquet(f"{path}/tokens").orderBy("id").collect()]
    return Vocabulary(tokens, [(r.left, r.right, r.id) for r in spark.read.parquet(f"{path}/rules").orderBy("rank").collect()])


def dump_model(w_in: np.ndarray, w_out: np.ndarray, epoch: int, rate: float) -> bytes:
    """Both matrices have one row a token."""
    return struct.pack(MODEL_HEADER, MODEL_MAGIC, 1, *w_in.shape, epoch, rate) + w_in.astype("<f4").tobytes() + w_out.astype("<f4").tobytes()


def parse_model(data: bytes) -> tuple[np.ndarray, np.ndarray, int, float]:
    if len(data) < HEADER_BYTES:
        raise FormatError("the file ends early")
    magic, version, size, dim, epoch, rate = struct.unpack_from(MODEL_HEADER, data)
    if magic != MODEL_MAGIC:
        raise FormatError("invalid magic bytes")
    if version != 1:
        raise FormatError(f"unsupported version: {version}")
    if size < 1 or dim < 1 or len(data) < HEADER_BYTES + 8 * size * dim:
        raise FormatError("the file ends early")
    both = np.frombuffer(data, "<f4", 2 * size * dim, HEADER_BYTES).reshape(2, size, dim)
    return both[0].copy(), both[1].copy(), epoch, rate


def save_model(path: str, w_in: np.ndarray, w_out: np.ndarray, epoch: int, rate: float) -> None:
    write_bytes(path, dump_model(w_in, w_out, epoch, rate))


def load_model(path: str) -> tuple[np.ndarray, np.ndarray, int, float]:
    return parse_model(read_bytes(path))


def write_model(model: DataFrame, path: str) -> None:
    """A model (id, w_in, w_out) as Parquet, by the executors that hold its rows."""
    model.select("id", "w_in", "w_out").write.mode("overwrite").parquet(path)


def read_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, w_in array<float>, w_out array<float>").parquet(path)


def model_frame(spark: SparkSession, w_in: np.ndarray, w_out: np.ndarray) -> DataFrame:
    """(id, w_in, w_out)"""
    import pyarrow as pa

    lists = [pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), w.shape[1]).cast(pa.list_(pa.float32())) for w in (w_in, w_out)]
    return spark.createDataFrame(pa.table({"id": pa.array(np.arange(len(w_in))), "w_in": lists[0], "w_out": lists[1]}))
