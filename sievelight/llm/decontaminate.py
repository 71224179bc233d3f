"""Benchmark decontamination by size-partitioned MinHash containment search [DataFrame operations only].

An item (short) is in a document (long) if the document has at least THRESHOLD of the item's distinct
shingles.  Words are runs of letters and numbers, lower-cased; a shingle is five words in a row, or the
whole sequence of a shorter text.

* Items of equal shingle sets are one set.  Sets are partitioned by size, in classes up to 2^c shingles.
* A set's sketch is its k smallest shingles under a permutation (MinHash): those that fewer sets have come
  first, then by hash.  Of n shingles a document must have ceil(4n/5), so of any n - ceil(4n/5) + 1 it has one;
  k is that number for the largest size of the class.  So no item is missed, in documents of any length, and a
  shingle common to all items (a prompt's first words) makes no candidates as long as there are others.
* A shingle of a document that is in a sketch makes text and set candidates.
* Candidates are verified by the shingles themselves, read again from the whole texts, once for each text.

Sketches are broadcast up to BROADCAST_ROWS rows; beyond, shingles that pass a bitmap of fixed size meet them
in a shuffle join.  Only texts that pass a bitmap of fixed size move.

Empty tables: empty result, or every document clean.  Null texts and texts without words have no shingles
and are in no pair.  Rows with one identifier are judged one by one and reported as one, with the largest
count; a null identifier is reported as such.  Columns of any name pass through, but for those that contained()
adds itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitmap
from .joins import looked_up
from .scratch import drop, stored

WORDS = 5
THRESHOLD = (4, 5)
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _bound(value: Column, use) -> Column:
    """use(value) with value computed once a row, also where use is a lambda over an array."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _each_shingle(words: Column, size: int, use) -> Column:
    def run(w: Column) -> Column:
        n = F.size(w)
        at = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: use(F.concat_ws(" ", F.slice(w, i, F.lit(size)))))

    return _bound(words, run)


def shingles(words: Column, size: int = WORDS) -> Column:
    """Shingles in order; none for no words."""
    return _each_shingle(words, size, lambda s: s)


def needed(n: Column) -> Column:
    """So many of n shingles make an item contained."""
    return F.ceil(n * THRESHOLD[0] / THRESHOLD[1])


def item_sets(items: DataFrame, item_id: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """(set, s) for each distinct set of shingles; (set, item_id) for each item with words."""
    own = items.select(F.col(item_id).alias("item_id"), F.sort_array(F.array_distinct(shingles(words_of(F.col(item_text))))).alias("s"))
    own = stored(own.where(F.size("s") > 0).distinct(), "items")
    sets = stored(own.select("s").distinct().select(F.monotonically_increasing_id().alias("set"), "s"), "item-sets")
    owners = stored(own.join(sets, "s").select("set", "item_id"), "item-owners")
    drop(own)
    return sets, owners


def sketches(sets: DataFrame) -> DataFrame:
    """(hash, set): the sketch of each set (set, s)."""
    each = sets.select("set", F.size("s").alias("n"), F.explode("s").alias("x"))
    rarity = each.groupBy("x").agg(F.count(F.lit(1)).alias("f"))
    ranked = each.join(rarity, "x").groupBy("set", "n").agg(F.sort_array(F.collect_list(F.struct("f", F.xxhash64("x").alias("h")))).alias("r"))
    largest = F.pow(F.lit(2.0), F.ceil(F.log2("n"))).cast("int")
    k = (largest - needed(largest) + 1).cast("int")
    return ranked.select("set", F.explode(F.transform(F.slice("r", F.lit(1), k), lambda x: x["h"])).alias("hash"))


def candidates(bodies: DataFrame, sets: DataFrame) -> DataFrame:
    """(tk, set): texts (tk, body) that share a shingle with a set's sketch."""
    index = stored(sketches(sets), "sketches")
    own = bodies.select("tk", F.explode(_each_shingle(words_of(F.col("body")), WORDS, F.xxhash64)).alias("hash"))
    if index.count() <= BROADCAST_ROWS:
        index = F.broadcast(index)
    else:
        own = bitmap.keep_possible(own, F.col("hash"), bitmap.build(index, F.col("hash")))
    return own.join(index, "hash").select("tk", "set").distinct()


def _verified(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(tk, bk, n, held) of each text of rows (tk, body) that holds a set: its SHA-256, rows, and sets with counts."""
    pairs = stored(candidates(rows.select("tk", "body"), sets), "candidates")
    some = bitmap.keep_possible(rows.select("tk", "body"), F.col("tk"), bitmap.build(pairs, F.col("tk")))
    texts = some.groupBy("tk", "body").agg(F.count(F.lit(1)).alias("n"))
    own = texts.select("tk", _text_key(F.col("body")).alias("bk"), "n", F.array_distinct(shingles(words_of(F.col("body")))).alias("own"))
    found = own.join(pairs, "tk").join(sets, "set").select("tk", "bk", "n", "set", F.size("s").alias("size"), F.size(F.array_intersect("s", "own")).alias("shared"))
    found = found.where(F.col("shared") >= needed(F.col("size")))
    found = found.groupBy("tk", "bk", "n").agg(F.collect_list(F.struct("set", "shared", F.col("size").alias("n_shingles"))).alias("held"))  # as many as sets at most
    out = stored(found, "leaks")
    drop(pairs)
    return out


def _text_key(body: Column) -> Column:
    return F.unhex(F.sha2(body, 256))


def _rows(docs: DataFrame, text_col: str) -> DataFrame:
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.struct(*docs.columns).alias("row"), body.alias("body"), F.xxhash64(body).alias("tk"))


def contained(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs' rows that hold an item, once for each item: docs' columns, then item_id, shared, n_shingles (which
    replace columns of these names)."""
    docs = docs.drop("item_id", "shared", "n_shingles")
    sets, owners = item_sets(items, item_id, item_text)
    rows = _rows(docs, text_col)
    held = _verified(rows, sets)
    some = bitmap.keep_possible(rows, F.col("tk"), bitmap.build(held, F.col("tk"))).select("row", _text_key(F.col("body")).alias("bk"))
    some = looked_up(some, held.select("bk", "n", "held"), ["bk"], "n", docs.count()).select("row", F.explode("held").alias("h")).select("row", "h.*")
    return some.join(owners, "set").select("row.*", "item_id", F.col("shared").cast("long"), F.col("n_shingles").cast("long"))


def clean_documents(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the rows that hold an item."""
    rows = _rows(docs, text_col)
    held = _verified(rows, item_sets(items, "item_id", "text")[0])
    tagged = bitmap.tag(rows, F.col("tk"), bitmap.build(held, F.col("tk")))
    stay = tagged.where("not _possible").select("row.*")
    some = tagged.where("_possible").select("row", _text_key(F.col("body")).alias("bk"))
    move = looked_up(some, held.select("bk", "n"), ["bk"], "n", docs.count()).where("n is null").select("row.*")
    return stay.unionByName(move)


def op3_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of document and benchmark item that it holds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contained(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    best = found.groupBy("doc_id", "item_id", "n_shingles").agg(F.max("shared").alias("shared"))
    return best.select("doc_id", "item_id", "shared", "n_shingles", F.round(F.col("shared") / F.col("n_shingles"), 6).alias("containment"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\pL\pN]+'), lambda x: x <> '') AS w FROM documents
), i AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\pL\pN]+'), lambda x: x <> '') AS w FROM benchmark
), ds AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: array_to_string(w[k:k + 4], ' '))) AS s
  FROM d WHERE len(w) > 0
), bs AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: array_to_string(w[k:k + 4], ' '))) AS s
  FROM i WHERE len(w) > 0
), n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id),
shared AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, shared, n_shingles, round(shared / n_shingles, 6) AS containment
FROM shared JOIN n USING (item_id) WHERE 5 * shared >= 4 * n_shingles
"""
