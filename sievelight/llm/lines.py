"""Line dedup by a sharded minimal perfect hash over distinct line keys.

1. Each text gives its line keys (stripped, A-Z lower-cased, at least 10 code points) as 128-bit hashes;
   partial aggregation counts documents and takes the smallest identifier per key.
2. Each shard of keys builds a minimal perfect hash (cascading bit arrays: a key alone on its place in a
   level stays there, the others go on to the next level), which numbers its keys without gaps.  Arrays
   under these numbers hold a 64-bit fingerprint, a saturating document count and the smallest document.
3. Documents' probes (hash, row, line number) go to the shard, look their number up, compare the
   fingerprint and read count and smallest document.  No line text moves and lines are not joined.  A task
   reads a shard's arrays first and then its probes in batches, so it holds one shard and one batch.
4. Keys with more than a part in HOT of all lines, fewer than HOT of them, make a shard of their own, which goes
   to all tasks: their probes are answered where they are.  Of the rest no key loads a task.
5. Rows that lose lines are found by a bitmap of fixed size; only their texts move.

Empty table: empty result.  Null and empty text: one empty line, which stays.  Rows with the same
identifier count as one document: none of its lines is a copy of another row's of it.  Rows with a null
identifier are one document too, which comes last.  Columns of any name pass through drop_lines().
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bitmap
from .frames import apart, together
from .pretokens import slices
from .scratch import drop, stored

MIN_CHARS = 10
KEYS_PER_SHARD = 2048
HOT = 10_000
_GAMMA = 1.5
_STRIP = " \t\n\x0b\x0c\r"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def key_of(line: str) -> bytes | None:
    """128-bit hash of a line's key; None for short ones."""
    key = line.strip(_STRIP)
    return hashlib.md5(key.encode().translate(_LOWER), usedforsecurity=False).digest() if len(key) >= MIN_CHARS else None


# ---- minimal perfect hash ------------------------------------------------------------------------------


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (1 << 64) - 1)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


def build_mph(h: np.ndarray) -> list[np.ndarray]:
    """Bit arrays of the levels, as bytes of 0 and 1, for distinct 64-bit hashes."""
    levels, left = [], h
    while len(left):
        size = max(8, int(_GAMMA * len(left)))
        at = (_mixed(left, len(levels)) % np.uint64(size)).astype(np.int64)
        taken = np.bincount(at, minlength=size)
        levels.append((taken == 1).astype(np.uint8))
        left = left[taken[at] != 1]
    return levels


def number(levels: list[np.ndarray], h: np.ndarray) -> np.ndarray:
    """The gapless number of each hash; -1 for some that were not among the keys."""
    out = np.full(len(h), -1, dtype=np.int64)
    open_, before = np.arange(len(h)), 0
    for k, bits in enumerate(levels):
        if not len(open_):
            break
        rank = np.cumsum(bits)
        at = (_mixed(h[open_], k) % np.uint64(len(bits))).astype(np.int64)
        hit = bits[at] == 1
        out[open_[hit]] = before + rank[at[hit]] - 1
        before += int(rank[-1])
        open_ = open_[~hit]
    return out


_ARRAYS = ["sizes", "bits", "fp", "count", "min_doc"]


def _pack(hi: np.ndarray, lo: np.ndarray, docs: np.ndarray, first: np.ndarray) -> list[bytes]:
    """The arrays of distinct hi under their numbers."""
    h = hi.view(np.uint64)
    levels = build_mph(h)
    n = number(levels, h)
    fp, count, least = np.zeros(len(h), np.int64), np.zeros(len(h), np.uint8), np.zeros(len(h), np.int64)
    fp[n], count[n], least[n] = lo, np.minimum(docs, 255), first
    return [
        np.array([len(x) for x in levels], np.int64).tobytes(), b"".join(np.packbits(x).tobytes() for x in levels),
        fp.tobytes(), count.tobytes(), least.tobytes(),
    ]


def packed(hi: np.ndarray, lo: np.ndarray, docs: np.ndarray, first: np.ndarray) -> list[list[bytes]]:
    """Arrays of a shard's keys; of keys with one hi the later ones go into arrays of their own."""
    order = np.lexsort((lo, hi))
    hi, lo, docs, first = hi[order], lo[order], docs[order], first[order]
    start = np.append(0, np.flatnonzero(np.diff(hi)) + 1)
    turn = np.arange(len(hi)) - np.repeat(start, np.diff(np.append(start, len(hi))))
    return [_pack(*(x[turn == t] for x in (hi, lo, docs, first))) for t in range(int(turn.max(initial=-1)) + 1)]


class Shard:
    """Packed arrays, ready for probes."""

    def __init__(self, arrays: list[bytes]) -> None:
        sizes, bits, fp, count, least = arrays
        self.levels, at = [], 0
        for size in np.frombuffer(sizes, np.int64).tolist():
            n = -(-size // 8)
            self.levels.append(np.unpackbits(np.frombuffer(bits[at : at + n], np.uint8))[:size])
            at += n
        self.fp, self.count, self.least = np.frombuffer(fp, np.int64), np.frombuffer(count, np.uint8), np.frombuffer(least, np.int64)

    def probe(self, hi: np.ndarray, lo: np.ndarray, own: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is here, and whether it is a copy of a line of another, smaller document (known: own is no null)."""
        n = number(self.levels, hi.view(np.uint64))
        here = n >= 0
        here[here] &= self.fp[n[here]] == lo[here]
        gone = here.copy()
        gone[here] &= (self.count[n[here]] >= 2) & ~(known[here] & (self.least[n[here]] == own[here]))
        return here, gone


# ---- stages --------------------------------------------------------------------------------------------


def _keys(batches):
    """rk, id, and per text its keyed lines: number, hi and lo of the hash."""
    for b in slices(batches, 2):
        n, at, his = [0], [], []
        for t in b.column(2).to_pylist():
            for i, line in enumerate((t or "").split("\n")):
                d = key_of(line)
                if d:
                    at.append(i)
                    his.append(d)
            n.append(len(at))
        raw = np.frombuffer(b"".join(his), dtype="<i8").reshape(-1, 2)
        to = pa.array(n, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), *(pa.ListArray.from_arrays(to, pa.array(x)) for x in (np.array(at, np.int32), raw[:, 0], raw[:, 1]))],
            ["rk", "id", "line", "hi", "lo"],
        )


def shards_for(keys: int) -> int:
    return max(1, 1 << math.ceil(math.log2(max(1, keys / KEYS_PER_SHARD))))


def _by_shard(rows: DataFrame, *order: str) -> DataFrame:
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "shard").sortWithinPartitions("shard", *order)


def _runs(shard: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    edge = np.flatnonzero(np.diff(shard)) + 1
    return list(zip([0, *edge.tolist()], [*edge.tolist(), len(shard)], strict=True)) if len(shard) else []


def build_index(keys: DataFrame, shards: int) -> DataFrame:
    """A row of packed arrays per shard from rows (hi, lo, docs, first)."""

    def pack(batches):
        held: list[np.ndarray] | None = None

        def rows(cols):
            each = [(int(cols[0][i]), a) for i, j in _runs(cols[0]) for a in packed(*(x[i:j] for x in cols[1:]))]
            arrays = [pa.array([a[k] for _, a in each], pa.binary()) for k in range(len(_ARRAYS))]
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in each], pa.int32()), *arrays], ["shard", *_ARRAYS])

        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            held = cols if held is None else [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
            cut = _runs(held[0])[-1][0] if len(held[0]) else 0
            if cut:
                yield rows([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield rows(held)

    own = keys.select(F.pmod("hi", F.lit(shards)).cast("int").alias("shard"), "hi", "lo", F.col("docs").cast("long").alias("docs"), F.coalesce("first", F.lit(0)).alias("first"))
    return _by_shard(own).mapInArrow(pack, "shard int, " + ", ".join(f"{a} binary" for a in _ARRAYS))


_PROBE = "shard int, rk binary, id long, line int, hi long, lo long"


def _split_probes(batches, hot: Shard | None, shards: int, answered: bool):
    """Lines from rows of _keys.  answered: those that the hot shard tells to lose; else probes of the others."""
    for b in batches:
        lists = b.column(2)
        count = np.diff(lists.offsets.to_numpy())
        row = pa.array(np.repeat(np.arange(b.num_rows), count))
        line, hi, lo = (c.flatten().to_numpy() for c in (lists, b.column(3), b.column(4)))
        ids = b.column(1).take(row)
        if hot is None:
            here = gone = np.zeros(len(hi), bool)
        else:
            here, gone = hot.probe(hi, lo, ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False))
        pick = pa.array(gone if answered else ~here)
        cols = [b.column(0).take(row), pa.array(line, pa.int32())]
        if not answered:
            shard = pa.array((hi % shards).astype(np.int32))
            cols = [shard, cols[0], ids, cols[1], pa.array(hi), pa.array(lo)]
        yield pa.RecordBatch.from_arrays([c.filter(pick) for c in cols], ["rk", "line"] if answered else ["shard", "rk", "id", "line", "hi", "lo"])


def _probe(batches):
    """rk and line of probes that lose their line; a shard's arrays stand before its probes."""
    at, own = None, []
    for b in batches:
        shard = b.column("shard").to_numpy()
        for i, j in _runs(shard):
            if shard[i] != at:
                at, own = shard[i], []
            part = b.slice(i, j - i)
            known = part.column("rk").is_valid().to_numpy(zero_copy_only=False)
            arrays = int((~known).sum())
            own += [Shard([part.column(a)[k].as_py() for a in _ARRAYS]) for k in range(arrays)]
            part = part.slice(arrays)
            if not part.num_rows:
                continue
            ids = part.column("id")
            hi, lo, valid = part.column("hi").to_numpy(), part.column("lo").to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
            drop = np.zeros(part.num_rows, bool)
            for s in own:
                drop |= s.probe(hi, lo, ids.fill_null(0).to_numpy(), valid)[1]
            pick = pa.array(drop)
            yield pa.RecordBatch.from_arrays([part.column("rk").filter(pick), part.column("line").filter(pick)], ["rk", "line"])


def copied_lines(rows: DataFrame) -> DataFrame:
    """(rk, line): lines to lose, from rows (rk, id, text)."""
    keyed = stored(rows.mapInArrow(_keys, "rk binary, id long, line array<int>, hi array<long>, lo array<long>"), "keyed")
    each = keyed.select("id", F.explode(F.arrays_zip("hi", "lo")).alias("k")).select("id", "k.hi", "k.lo")
    # rows of one identifier may hold a key twice: count documents by their extremes, and saturate
    several = (F.min("id") != F.max("id")) | (F.max(F.col("id").isNull()) & F.min("id").isNotNull())
    counts = each.groupBy("hi", "lo").agg(
        F.when(several, F.least(F.count(F.lit(1)), F.lit(255))).otherwise(F.lit(1)).alias("docs"), F.min("id").alias("first"), F.count(F.lit(1)).alias("n")
    )
    counts = stored(counts, "line-keys")
    sums = counts.agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("lines")).first()
    shards = shards_for(sums["keys"])
    limit = max(KEYS_PER_SHARD, (sums["lines"] or 0) // HOT)
    often = counts.where(F.col("n") > limit).select("hi", "lo", "docs", F.coalesce("first", F.lit(0)).alias("first")).toPandas()  # fewer than HOT rows
    hot = None
    if len(often):
        arrays = packed(*(often[c].to_numpy(np.int64) for c in ("hi", "lo", "docs", "first")))
        hot = rows.sparkSession.sparkContext.broadcast(arrays)
    index = stored(build_index(counts.where(F.col("n") <= limit), shards), "line-index")
    drop(counts)

    def split(batches, answered):
        own = [Shard(a) for a in hot.value] if hot else [None]
        for b in batches:
            # two keys with one hi lie in arrays of their own; that is so rare that a second pass does not matter
            if len(own) == 1:
                yield from _split_probes([b], own[0], shards, answered)
            else:
                yield from _split_probes([b], _Several(own), shards, answered)

    gone = keyed.mapInArrow(lambda it: split(it, True), "rk binary, line int") if hot else None
    probes = keyed.mapInArrow(lambda it: split(it, False), _PROBE)
    for a in _ARRAYS:
        probes = probes.withColumn(a, F.lit(None).cast("binary"))
    arrays = index.select("shard", *(F.lit(None).cast(t).alias(c) for c, t in (("rk", "binary"), ("id", "long"), ("line", "int"), ("hi", "long"), ("lo", "long"))), *_ARRAYS)
    both = probes.unionByName(arrays).withColumn("turn", F.col("rk").isNotNull())
    lost = _by_shard(both, "turn").drop("turn").mapInArrow(_probe, "rk binary, line int")
    return lost.unionByName(gone) if gone is not None else lost


class _Several:
    """Several arrays of one shard as one."""

    def __init__(self, shards: list[Shard]) -> None:
        self.shards = shards

    def probe(self, *args):
        here, gone = zip(*(s.probe(*args) for s in self.shards), strict=True)
        return np.logical_or.reduce(here), np.logical_or.reduce(gone)


def _cut(batches):
    """Texts (column 1) without the lines listed in column 2; then lines before, lines lost."""
    for b in slices(batches, 1):
        out, before, gone = [], [], []
        for t, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            lines, lost = (t or "").split("\n"), set(x or ())
            out.append("\n".join(s for i, s in enumerate(lines) if i not in lost) if lost else t)
            before.append(len(lines))
            gone.append(len(lost))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(out, pa.string()), pa.array(before, pa.int64()), pa.array(gone, pa.int64())], ["row", "text", "n_lines", "n_dropped"]
        )


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = True) -> DataFrame:
    """All columns of docs, the text without copied lines; then (counts) n_lines and n_dropped, which replace
    columns of these names."""
    if counts:
        docs = docs.drop("n_lines", "n_dropped")
    text = F.col(text_col).cast("string")
    # rows are known by identifier and text: rows alike in both lose the same lines
    whole = F.concat_ws("\n", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    key = F.substring(F.unhex(F.sha2(whole, 256)), 1, 16)
    rows = apart(docs, text_col, id=F.col(id_col).cast("long"), rk=key)
    lost = copied_lines(rows.select("rk", "id", "text")).groupBy("rk").agg(F.collect_set("line").alias("lost"))
    lost = stored(lost, "lines-lost")
    tagged = bitmap.tag(rows.select("row", "text", "rk"), F.col("rk"), bitmap.build(lost, F.col("rk")))
    body = F.coalesce("text", F.lit(""))
    n = (F.octet_length(body) - F.octet_length(F.replace(body, F.lit("\n"), F.lit(""))) + 1).cast("long")
    stay = tagged.where("not _possible").select("row", "text", n.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    move = tagged.where("_possible").join(lost, "rk", "left").select("row", "text", "lost")
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    out = stay.unionByName(move.mapInArrow(_cut, schema))
    return out.select(*together(docs.columns, text_col), *(["n_lines", "n_dropped"] if counts else []))


def op7_mph_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH split AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM split
), copied AS (
  SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT keyed.*, coalesce(doc_id <> first, false) AS gone FROM keyed LEFT JOIN copied USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
