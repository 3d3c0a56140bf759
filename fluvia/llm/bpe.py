"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Texts are cut at safe boundaries (see `encoding.cut_byte_level`), so a long text never meets the library's regex
engine as one string; a batch's distinct pieces are encoded once. Decoding concatenates the raw bytes of the ids, so it
also restores texts whose ids cut characters apart.

Edge cases: a null text counts as empty (no ids, empty bytes); lone surrogates cannot occur in a Parquet string;
repeated rows and null ids of rows pass through as they are; other columns are kept and may have any name but
`ids` and `decoded`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.llm import common
from fluvia.llm.encoding import give_back, rank_encoder, rank_encoding, slices


def encode(texts: list[str], path: str, pattern: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers."""
    return rank_encoder(path, pattern).ids(texts)


def decode(ids: list[bytes], path: str, pattern: str) -> list[bytes]:
    """The bytes that the ids stand for."""
    e = rank_encoding(path, pattern)
    return [e.decode_bytes(np.frombuffer(x, dtype="<u4").tolist()) for x in ids]


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id_col, ids (binary, little-endian unsigned 32-bit)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for key, text in slices(batches, [id_col, text_col]):
            ids = encode([t or "" for t in text], path, pattern)
            yield pa.record_batch([pa.array(key, arrow_type), pa.array(ids, pa.binary())], names=[id_col, "ids"])

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_type = to_arrow_type(docs.schema[id_col].dataType)
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids binary")


def bpe_decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """Columns id_col, ids, decoded (binary)."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            ids = [x or b"" for x in b.column("ids").to_pylist()]
            yield pa.record_batch([b.column(id_col), pa.array(ids, pa.binary()), pa.array(decode(ids, path, pattern), pa.binary())], names=[id_col, "ids", "decoded"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, ids binary, decoded binary")


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes, decodes the ids, and digests both in one pass."""

    def run(batches):
        sha = lambda b: hashlib.sha256(b).hexdigest()
        try:
            for key, text in slices(batches, ["doc_id", "text"]):
                ids = encode([t or "" for t in text], path, pattern)
                back = decode(ids, path, pattern)
                yield pa.record_batch(
                    [
                        pa.array(key, pa.int64()),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([sha(" ".join(map(str, np.frombuffer(x, dtype="<u4").tolist())).encode()) for x in ids], pa.string()),
                        pa.array([sha(x) for x in back], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        finally:
            give_back(rank_encoder(path, pattern))

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers_dir

    return round_trip_digests(common.documents(spark, sf_dir), tokenizers_dir.path("byte_bpe_50k.tiktoken"), tokenizers_dir.PATTERN)
