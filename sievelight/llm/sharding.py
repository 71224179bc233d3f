"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Row i of the matrix says how many rows of input partition i go to each block; a shard consists of one or
more blocks, so no task holds a whole shard.  The matrix has the law that a uniform permutation of all rows
would give.  Each partition permutes its own rows and deals them by its row of the matrix; after the exchange
each block permutes again.  Every order of the rows is equally likely, and counts are exact.

Nobody holds the matrix.  A tree halves the partitions again and again; at each node the places of its blocks are
split between the halves by a multivariate hypergeometric draw whose seed follows from the node.  A task that has
partition i walks down to it and so gets row i, in memory of one number a block.  The driver sees the row and byte
counts of each partition only and sends the row counts to the tasks.  Blocks are bounded by rows and, in the mean, by
bytes.

The input is written to the shared folder first with each row's position, and a row's block follows from its
position alone, so a retried task deals alike.

Empty table: empty result.  Null text: size 8, checksum 0.  Repeated rows are dealt one by one.  Extra
columns stay, except those named ``shard`` or ``slot`` (or a name with the prefix ``_deal_``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import new_path, shared_dir

SHARDS = 24
ROWS_PER_BLOCK = 50_000
#: Bytes of a block in the mean; a block takes as many rows as fit by the mean width of all rows.
BYTES_PER_BLOCK = 16 << 20
SEED = 20_240_607


def block_sizes(rows: int, shards: int, rows_per_block: int) -> list[tuple[int, int, int]]:
    """(shard, first slot, rows) of each block; shard sizes differ by one at most."""
    out = []
    for s in range(shards):
        n = rows // shards + (s < rows % shards)
        k = max(1, -(-n // rows_per_block))
        at = 0
        for b in range(k):
            m = n // k + (b < n % k)
            out.append((s, at, m))
            at += m
    return out


def matrix_row(partition_rows: np.ndarray, block_rows: np.ndarray, i: int, seed: int = SEED) -> np.ndarray:
    """Row i of the matrix with the given row and column sums."""
    before = np.append(0, np.cumsum(partition_rows))
    left = np.array(block_rows, dtype=np.int64)
    lo, hi, node = 0, len(partition_rows), 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, 0, node])
        first = _hypergeometric(rng, left, int(before[mid] - before[lo]))
        if i < mid:
            left, hi, node = first, mid, 2 * node
        else:
            left, lo, node = left - first, mid, 2 * node + 1
    return left


def _hypergeometric(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """Multivariate draw by halves."""
    if len(left) == 1:
        return np.array([n], dtype=np.int64)
    if left.sum() < 1_000_000_000:
        return rng.multivariate_hypergeometric(left, n, method="marginals")
    half = len(left) // 2
    k = _univariate(rng, int(left[:half].sum()), int(left[half:].sum()), n)
    return np.concatenate([_hypergeometric(rng, left[:half], k), _hypergeometric(rng, left[half:], n - k)])


def _univariate(rng: np.random.Generator, a: int, b: int, n: int) -> int:
    """Draw by inversion beyond numpy's limit of 1e9: weights follow from their ratios, 40 standard
    deviations to each side of the mode."""
    mode = (n + 1) * (a + 1) // (a + b + 2)
    low, high = max(0, n - b), min(n, a)
    reach = 40 * int((n * (a / (a + b)) * (b / (a + b))) ** 0.5 + 1)
    lo, hi = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(lo, hi, dtype=np.float64)
    steps = np.log((a - k) * (n - k)) - np.log((k + 1) * (b - n + k + 1))
    w = np.concatenate([[0.0], np.cumsum(steps)])
    w = np.exp(w - w.max())
    return lo + int(np.searchsorted(np.cumsum(w), rng.random() * w.sum()))


def shuffle_shards(
    df: DataFrame, shards: int = SHARDS, rows_per_block: int = ROWS_PER_BLOCK, seed: int = SEED
) -> DataFrame:
    """df with the columns shard and slot, in a uniformly random order."""
    spark = df.sparkSession
    shared_dir(spark)
    df = df.drop("shard", "slot")
    cols = df.columns
    fixed = df.withColumn("_deal_pos", F.monotonically_increasing_id())
    path = new_path(spark, "deal")
    fixed.write.parquet(path)  # each task's file name carries its partition; order inside a file is kept
    fixed = spark.read.parquet(path)
    part = F.shiftright("_deal_pos", 33)
    wide = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    width = sum(wide, F.lit(8 * len(cols))).cast("long")
    found = fixed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("bytes")).collect()
    counts = sorted((r["p"], r["n"]) for r in found)
    parts = {p: i for i, (p, _) in enumerate(counts)}
    total = sum(n for _, n in counts)
    fit = BYTES_PER_BLOCK * total // max(1, sum(r["bytes"] for r in found))
    blocks = block_sizes(total, shards, max(1, min(rows_per_block, fit)))
    sizes = np.array([m for _, _, m in blocks], dtype=np.int64)
    starts = [(s, at) for s, at, _ in blocks]
    dealt = spark.sparkContext.broadcast((parts, np.array([n for _, n in counts], dtype=np.int64)))  # a number a partition

    def deal(batches):
        """Labels of a row are a function of its fixed position only: however scans split or merge the
        files, a row gets the same block."""
        where, rows = dealt.value
        labels: dict[int, np.ndarray] = {}
        for b in batches:
            pos = b.column("_deal_pos").to_numpy()
            p, k = pos >> 33, pos & ((1 << 33) - 1)
            block = np.empty(len(pos), dtype=np.int64)
            for x in np.unique(p):
                if int(x) not in labels:
                    labels.clear()
                    i = where[int(x)]
                    own = np.repeat(np.arange(len(sizes)), matrix_row(rows, sizes, i, seed))
                    np.random.default_rng([seed, 1, i]).shuffle(own)
                    labels[int(x)] = own
                m = p == x
                block[m] = labels[int(x)][k[m]]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(block)], [*b.schema.names, "_deal_block"])

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["_deal_block"].iloc[0])
        pdf = pdf.sort_values("_deal_pos", ignore_index=True)
        shard, at = starts[block]
        pdf["shard"] = np.int32(shard)
        pdf["slot"] = at + np.random.default_rng([seed, 2, block]).permutation(len(pdf))
        return pdf[[*cols, "shard", "slot"]]

    schema = T.StructType([*fixed.schema.fields, T.StructField("_deal_block", T.LongType())])
    out = T.StructType([*df.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    return fixed.mapInArrow(deal, schema).groupBy("_deal_block").applyInPandas(settle, out)


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Whole rows as one folder a shard, each in slot order within its files."""
    shuffle_shards(df, shards, seed=seed).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op6_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of all documents.  Whole documents are dealt; size and checksum are those of the dealt texts."""
    dealt = shuffle_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = F.coalesce("text", F.lit(""))
    size, crc = (F.octet_length(text) + 8).cast("long"), F.crc32(text.cast("binary"))
    return dealt.select(
        "doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
