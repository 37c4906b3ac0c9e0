"""Byte-level BPE encoding and decoding with a sentencepiece model serialised directly from the vocabulary.

Each token of the rank file becomes a piece whose characters stand for its bytes, scored by its negative rank; the model's
normalisation is the identity. sentencepiece then merges the pair with the lowest rank first, as byte-level BPE asks.
Null text counts as empty and has no ids. Repeated rows give repeated results; further columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .pretoken import Pieces, ranks

CHUNK = 2_000_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """For each byte a printable character: itself where it prints, else one from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: bytes | int | float | str) -> bytes:
    """One field of a protocol buffer message."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(vocabulary: dict[bytes, int]) -> bytes:
    """A sentencepiece model: pieces 1 (text 1, score 2, type 3), trainer 2 (BPE, size, ids), normaliser 3 (identity)."""
    names, out = byte_characters(), []
    for token, rank in sorted(vocabulary.items(), key=lambda x: x[1]):
        out.append(_field(1, _field(1, "".join(names[b] for b in token)) + _field(2, float(-rank))))
    out.append(_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(vocabulary) + 1) + _field(40, len(vocabulary)) + b"".join(_field(k, 2**64 - 1) for k in (41, 42, 43))
    normaliser = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes matches of the splitting pattern with sentencepiece; decodes ids by the inverse byte mapping."""

    def __init__(self, path: str):
        import sentencepiece

        vocabulary = ranks(path)
        if sorted(vocabulary.values()) != list(range(len(vocabulary))):
            raise ValueError("ranks must run from 0 without gaps")
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(vocabulary))
        self.names = dict(enumerate(byte_characters()))
        back = {c: b for b, c in self.names.items()}
        self.bytes_of = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(len(vocabulary))]
        self.pieces = Pieces(self._encode)

    def _encode(self, parts: list[str]) -> list[list[int]]:
        return self.model.encode([p.encode("utf-8", "replace").decode("latin-1").translate(self.names) for p in parts], num_threads=1)

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.pieces.ids(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I").tolist()))


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids: binary, the ids of the whole text as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in common.text_chunks(batch, "t", CHUNK):
                ids = c.encode([x or "" for x in part.column("t").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(ids, pa.binary())], ["k", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(common.lean(run), f"k {kind}, ids binary").withColumnRenamed("k", key)


def decode(df: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """df with key and ids, and decoded: binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = pa.array([c.decode(x) for x in part.column("ids").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, out], ["k", "ids", "decoded"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), "ids").mapInArrow(common.lean(run), f"k {kind}, ids binary, decoded binary").withColumnRenamed("k", key)


def id_array(ids: Column) -> Column:
    """The ids of a binary column as array<int>."""
    hexes = F.regexp_extract_all(F.hex(ids), F.lit("(..)(..)(..)(..)"), F.lit(0))
    return F.transform(hexes, lambda h: F.conv(F.concat(*(F.substring(h, k, 2) for k in (7, 5, 3, 1))), 16, 10).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of tokens and the digests of its ids and of the decoded bytes."""
    path = vocabulary_path()
    out = decode(encode(common.table(spark, sf_dir, "documents"), path), path)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
