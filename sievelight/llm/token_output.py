"""Token ids as ORC: striped files in identifier order, read by stripes and pruned by their metadata.

Layout of a file: ``doc_id``, ``ids`` (integer run-length encoding), ``n_tokens``, ``part`` (number of the
file in order) and ``at`` (ids before the document in its file), in ascending doc_id order.  Row-group
indexes and a Bloom filter on doc_id let a lookup of single documents skip stripes and row groups;
readers of token counts never touch the ids.

The text is range-partitioned by identifier once and encoded on the way to the file, so ids are never
shuffled.  Strings of special tokens inside a text are ordinary text (the library's encode_special_tokens, as the
instructions beside the vocabulary files set it), so a document cannot forge an end of text.

Empty table: empty result.  Null text counts as empty: the end id alone.  A null identifier comes first.  Rows with
one identifier lie in one file, ordered by text.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pretokens import PieceCoder, encoded, slices
from .scratch import new_path

END_ID = 2
_coders: dict[str, PieceCoder] = {}


def byte_signs() -> np.ndarray:
    """The sign that stands for each byte in byte-level vocabularies: printable Latin-1 signs for themselves, the other
    bytes in order for U+0100 and on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = np.zeros(256, dtype="<u2")
    table[plain] = plain
    others = np.setdiff1d(np.arange(256), plain)
    table[others] = 0x100 + np.arange(len(others))
    return table


def coder(path: str) -> PieceCoder:
    """Pieces go to the library's model itself, with their bytes as signs: its whole pipeline would split them again."""
    if path not in _coders:
        from tokenizers import Tokenizer

        model, table = Tokenizer.from_file(path).model, byte_signs()

        def encode(pieces: list[str]) -> list[list[int]]:
            data = [p.encode() for p in pieces]
            signs = table[np.frombuffer(b"".join(data), np.uint8)].tobytes().decode("utf-16-le")
            out, at = [], 0
            for d in data:
                out.append([t.id for t in model.tokenize(signs[at : at + len(d)])])
                at += len(d)
            return out

        _coders[path] = PieceCoder(encode)
    return _coders[path]


def encode_texts(path: str, texts: list[str | None], end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """ids of all texts in turn, the end id after each; and the number of ids of each."""
    flat, counts = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
    for ids, n in encoded(coder(path), texts):
        flat.append(np.insert(ids, np.cumsum(n), end_id))
        counts.append(n + 1)
    return np.concatenate(flat), np.concatenate(counts)


def write_ids(
    docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = END_ID, stripe_bytes: int = 16 << 20, row_group: int = 1000,
) -> None:
    """Write docs' ids to path.  tokenizer: file of the tokenizers library, at one place on all machines."""

    def encode(batches):
        part, at = TaskContext.get().partitionId(), 0
        for b in slices(batches, 1):
            ids, n = encode_texts(tokenizer, b.column(1).to_pylist(), end_id)
            to = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(ids, pa.int32())),
                    pa.array(n, pa.int64()),
                    pa.array(np.full(len(n), part), pa.int32()),
                    pa.array(at + to[:-1], pa.int64()),
                ],
                ["doc_id", "ids", "n_tokens", "part", "at"],
            )
            at += int(to[-1])

    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    (
        rows.mapInArrow(encode, "doc_id long, ids array<int>, n_tokens long, part int, at long")
        .write.option("orc.stripe.size", stripe_bytes)
        .option("orc.row.index.stride", row_group)
        .option("orc.rows.between.memory.checks", row_group)  # so often a stripe's size is looked at
        .option("orc.bloom.filter.columns", "doc_id")
        .option("compression", "zstd")
        .orc(path)
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids, n_tokens and start: the ids of all documents before it."""
    rows = spark.read.orc(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each file: as many as the write had partitions
    before = parts.select("part", F.expr("sum(n) OVER (ORDER BY part) - n").alias("before"))
    return rows.join(F.broadcast(before), "part").select("doc_id", "ids", "n_tokens", (F.col("before") + F.col("at")).alias("start"))


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """ids of single documents; the filter reaches the files' indexes and Bloom filters."""
    return spark.read.orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def checked(batches):
    """Counts and checksums of the ids as read."""
    for b in batches:
        ids = b.column("ids")
        to = ids.offsets.to_numpy()
        flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        sums = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("start"), pa.array(np.diff(to), pa.int64()), pa.array(sums, pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def op2_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "ids")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_ids(spark, path).select("doc_id", "start", "ids").mapInArrow(
        checked, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
