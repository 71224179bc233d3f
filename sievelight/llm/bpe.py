"""Byte-level BPE by a sentencepiece model that is serialised straight from a rank file.

Byte b becomes the sign U+0100+b, so pieces are text; rank r is piece r+1 with the score -r, after the
unknown piece that the format asks for; normalisation is the identity.  The library then merges the pair
of the lowest rank first, the leftmost of equals, as byte-level BPE does.  Texts are split into pre-tokens
first, each distinct one is encoded once, and a pre-token that has a rank of its own is that one id.
Decoding maps ids back to bytes.

Empty table: empty result.  Null text counts as empty: no ids.  Repeated rows are encoded one by one.
Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pretokens import SLICE, PieceCoder, chunks, encoded, slices


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _bytes_field(number: int, value: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _int_field(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value & (1 << 64) - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def signs(data: bytes) -> str:
    return (np.frombuffer(data, np.uint8).astype("<u2") + 0x100).tobytes().decode("utf-16-le")


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """The model file: fields 1 pieces (1 piece, 2 score, 3 type), 2 trainer (3 kind: 2 is BPE, 4 size,
    40 to 43 ids of unknown, begin, end, padding), 3 normaliser (1 name, 3 dummy prefix, 4 extra spaces,
    5 escaped spaces)."""
    unknown = _bytes_field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _int_field(3, 2)
    out = [_bytes_field(1, unknown)]
    for piece, rank in sorted(ranks.items(), key=lambda x: x[1]):
        body = _bytes_field(1, signs(piece).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _int_field(3, 1)
        out.append(_bytes_field(1, body))
    trainer = _int_field(3, 2) + _int_field(4, len(ranks) + 1) + _int_field(40, 0)
    trainer += b"".join(_int_field(n, -1) for n in (41, 42, 43))
    normaliser = _bytes_field(1, b"identity") + b"".join(_int_field(n, 0) for n in (3, 4, 5))
    return b"".join([*out, _bytes_field(2, trainer), _bytes_field(3, normaliser)])


class Codec:
    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.ranks = read_ranks(path)
        ordered = sorted(self.ranks.items(), key=lambda x: x[1])
        self.rank_of = np.array([-1, *(r for _, r in ordered)], dtype=np.int64)
        self.bytes_of = {r: b for b, r in ordered}
        self.model = SentencePieceProcessor(model_proto=model_proto(self.ranks))
        self.coder = PieceCoder(self._encode_pieces, held=250_000)  # beside the model and the ranks

    def _encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        data = [p.encode() for p in pieces]
        out: list = [[r] if (r := self.ranks.get(d)) is not None else None for d in data]
        open_ = [i for i, x in enumerate(out) if x is None]
        mapped = signs(b"".join(data[i] for i in open_))
        texts, at = [], 0
        for i in open_:
            texts.append(mapped[at : at + len(data[i])])
            at += len(data[i])
        for i, ids in zip(open_, self.model.encode(texts, out_type=int, num_threads=1) if texts else [], strict=True):
            out[i] = self.rank_of[ids].tolist()
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out = []
        for ids, n in encoded(self.coder, texts, SLICE // 2):
            to = np.append(0, np.cumsum(n)).tolist()
            out += [ids[i:j] for i, j in zip(to[:-1], to[1:], strict=True)]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids of each row.  ranks: a rank file, at one place on all machines."""

    def run(batches):
        for b in slices(batches, 1):
            ids = codec(ranks).encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, ids array<int>").select(F.col("id").alias(id_col), "ids")


def decode(df: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and decoded bytes of each row; a null list gives no bytes."""

    def run(batches):
        for b in batches:
            own = codec(ranks)
            texts = [own.decode(np.array(x or [], dtype=np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary())], ["id", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), ids_col).mapInArrow(run, f"id {kind}, decoded binary").select(F.col("id").alias(id_col), "decoded")


def round_trip(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode each text in one pass: id, n_tokens and the hashes of ids and decoded bytes; the ids
    too if wanted."""

    def run(batches):
        for b in slices(batches, 1):
            own = codec(ranks)
            rows: list[tuple[int, str, str]] = []
            every: list[np.ndarray] = []
            texts = b.column(1).to_pylist()
            for i, j, _ in chunks(texts):
                for ids in own.encode(texts[i:j]):
                    listed = ids.tolist()
                    if with_ids:
                        every.append(ids)
                    rows.append((len(listed), hashlib.sha256(",".join(map(str, listed)).encode()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
            n, a, d = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string()), *([pa.array(every, pa.list_(pa.int32()))] if with_ids else [])],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("id", id_col)


def op4_sentencepiece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
