"""Exact dedup by a log-structured merge index [DataFrame operations only].

* Memtable: one scan split.  Its digests are sorted and flushed as one run of level 0, a Parquet file with
  page-level minima and maxima and a Bloom filter on the digest.  Each text is hashed once.
* Compaction: runs of level 0 merge into RUNS runs of level 1; of equal digests the smallest identifier stays,
  with a count.  Each run of level 1 has a filter.  A digest goes on into the merge to level 2 only if the
  filter of another run has it; the others are moved down as they are.  Partial aggregation runs before each
  shuffle, so a digest that a third of all rows share costs one row per split.
* Probe: digests that level 2 holds more than once are hits.  Only texts whose hash passes a bitmap of hits move;
  they are grouped by their bytes, not by digest.  Texts with equal digests and unequal bytes so separate.
* Rows find their group by digest.  Rows that are no hit do not move, and keys of very many rows are broadcast
  (joins.looked_up), so no task gets a large group.

Empty table: empty result.  Null text counts as empty text.  Rows that repeat an identifier count one by
one; a null identifier never wins against another one.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitmap
from .joins import looked_up
from .scratch import drop, stored

#: Runs of level 1; their filters are broadcast, 1 MB each.
RUNS = 4
#: Only runs of white space that are not one space already.
_TO_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
_FILTER = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.max.bytes": "262144"}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _TO_SPACE, " ")


def flush(docs: DataFrame, id_col: str, text_col: str, digest_bytes: int) -> DataFrame:
    """Level 0: rows (id, run, sha, digest, x) in sorted runs, one for each split of the scan."""
    body = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("body"))
    rows = body.select("id", F.unhex(F.sha2("body", 256)).alias("sha"), F.xxhash64("body").alias("x"))
    rows = rows.select("id", F.spark_partition_id().alias("run"), "sha", F.substring("sha", 1, digest_bytes).alias("digest"), "x")
    return stored(rows.sortWithinPartitions("digest", "id"), "runs", **_FILTER)


def merged(runs: DataFrame) -> DataFrame:
    """Level 1: (run, digest, keep, n), sorted by run and digest."""
    level = runs.groupBy(F.pmod("run", F.lit(RUNS)).alias("run"), "digest").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    return stored(level.sortWithinPartitions("run", "digest"), "level-1", **_FILTER)


def compacted(level: DataFrame) -> DataFrame:
    """Level 2: (digest, keep, n) of level 1.  Digests that no other run's filter has are moved down unmerged."""
    tagged = bitmap.tag_others(level, F.col("digest"), bitmap.build_each(level, F.col("digest"), "run", RUNS), "run", RUNS)
    alone = tagged.where("not _possible").select("digest", "keep", "n")
    met = tagged.where("_possible").groupBy("digest").agg(F.min("keep").alias("keep"), F.sum("n").alias("n"))
    return stored(alone.unionByName(met), "level-2", **_FILTER)


def found(runs: DataFrame, digests: list[bytes]) -> DataFrame:
    """Rows of a level with one of the digests: the predicate reaches the runs' statistics and Bloom filters."""
    return runs.where(F.col("digest").isin([F.lit(d) for d in digests]))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32) -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256.  digest_bytes under 32 only serves tests of
    colliding digests; results are the same."""
    runs = flush(docs, id_col, text_col, digest_bytes)
    first = merged(runs)
    second = compacted(first)
    hits = stored(second.where("n > 1").select("digest"), "hits")
    maybe = bitmap.build(hits, F.col("digest"))

    # Byte verification of hits: the whole text is the grouping key.
    seen = bitmap.keep_possible(runs.select("digest", "x"), F.col("digest"), maybe)
    text = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("body"))
    text = text.select("id", "body", F.xxhash64("body").alias("x"))
    some = bitmap.keep_possible(text, F.col("x"), bitmap.build(seen, F.col("x"))).drop("x")
    bodies = some.groupBy("body").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    bodies = stored(bodies.select(F.unhex(F.sha2("body", 256)).alias("sha"), "keep", "n"), "verified")
    groups = bodies.groupBy(F.substring("sha", 1, digest_bytes).alias("digest")).agg(
        F.min("keep").alias("keep"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("bodies")
    )
    groups = stored(groups, "groups")
    drop(first, second)

    rows = bitmap.tag(runs.select("id", "sha", "digest"), F.col("digest"), maybe)
    none = [F.lit(None).cast(docs.schema[id_col].dataType).alias("keep"), F.lit(None).cast("long").alias("n")]
    out = rows.where("not _possible").select("id", "sha", *none)
    known = looked_up(rows.where("_possible").select("id", "sha", "digest"), groups, ["digest"], "n", docs.count())
    out = out.unionByName(known.where("bodies is null or bodies = 1").select("id", "sha", "keep", "n"))
    clash = groups.where("bodies > 1").select("digest")
    if not clash.isEmpty():  # texts of one digest: they are told apart by their bytes
        own = some.select("id", "body", F.unhex(F.sha2("body", 256)).alias("sha"))
        own = own.withColumn("digest", F.substring("sha", 1, digest_bytes)).join(clash, "digest", "left_semi")
        by_body = own.groupBy("body").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("n"))
        out = out.unionByName(own.select("id", "sha", "body").join(by_body, "body").select("id", "sha", "keep", "n"))
    single = F.coalesce(F.col("n"), F.lit(1)) == 1
    keep = F.when(single, F.col("id")).otherwise(F.col("keep"))
    return out.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""
