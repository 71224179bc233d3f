"""A membership filter of fixed size: one hash bit per key, in rows of 4 KB.

It is broadcast whatever the input's size, as ``bits / 8`` bytes bound it (1 MB by default).  With more
keys it passes more rows, so the join behind it gets more work but never loses a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 23
_ROW = 1 << 15


def build(keys: DataFrame, key: Column, bits: int = BITS) -> DataFrame:
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    return (
        keys.where(key.isNotNull())
        .select(F.shiftright(at, 15).alias("bm_row"), at.bitwiseAND(F.lit(_ROW - 1)).alias("bm_bit"))
        .groupBy("bm_row")
        .agg(F.bitmap_construct_agg("bm_bit").alias("bm_map"))
    )


def build_each(keys: DataFrame, key: Column, run: str, runs: int, bits: int = BITS) -> DataFrame:
    """A bitmap for each of the runs 0, 1, ... that the column run tells: runs * bits / 8 bytes together."""
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    each = keys.select(F.col(run).alias("bm_run"), F.shiftright(at, 15).alias("bm_row"), at.bitwiseAND(F.lit(_ROW - 1)).alias("bm_bit"))
    each = each.groupBy("bm_run", "bm_row").agg(F.bitmap_construct_agg("bm_bit").alias("bm_map"))
    return each.groupBy("bm_row").agg(*(F.max(F.when(F.col("bm_run") == r, F.col("bm_map"))).alias(f"bm_map_{r}") for r in range(runs)))


def _bit_set(at: Column, name: str = "bm_map") -> Column:
    bit = at.bitwiseAND(F.lit(_ROW - 1))
    byte = F.conv(F.hex(F.substring(F.col(name), F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10)
    mask = F.call_function("shiftleft", F.lit(1), bit.bitwiseAND(F.lit(7)).cast("int"))
    return byte.cast("int").bitwiseAND(mask) != 0


def tag_others(df: DataFrame, key: Column, maps: DataFrame, run: str, runs: int, bits: int = BITS) -> DataFrame:
    """df with _possible: false where no other run than the row's own has the key."""
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    joined = df.withColumn("_bm_at", at).join(F.broadcast(maps), F.shiftright("_bm_at", 15) == F.col("bm_row"), "left")
    hit = F.lit(False)
    for r in range(runs):
        hit = hit | ((F.col(run) != r) & F.coalesce(_bit_set(F.col("_bm_at"), f"bm_map_{r}"), F.lit(False)))
    return joined.withColumn("_possible", hit).drop("_bm_at", "bm_row", *(f"bm_map_{r}" for r in range(runs)))


def keep_possible(df: DataFrame, key: Column, bitmap: DataFrame, bits: int = BITS) -> DataFrame:
    """Rows of df whose key may be among the bitmap's keys (all that are, and some that are not)."""
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    joined = df.withColumn("_bm_at", at).join(F.broadcast(bitmap), F.shiftright("_bm_at", 15) == F.col("bm_row"))
    return joined.where(_bit_set(F.col("_bm_at"))).drop("_bm_at", "bm_row", "bm_map")


def tag(df: DataFrame, key: Column, bitmap: DataFrame, bits: int = BITS) -> DataFrame:
    """df with _possible: false where the key is certainly not among the bitmap's keys."""
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    joined = df.withColumn("_bm_at", at).join(F.broadcast(bitmap), F.shiftright("_bm_at", 15) == F.col("bm_row"), "left")
    return joined.withColumn("_possible", F.coalesce(_bit_set(F.col("_bm_at")), F.lit(False))).drop("_bm_at", "bm_row", "bm_map")
