"""SimHash near-dedup with bit-sliced comparison.

* Fingerprints: 64 majority bits of shingle hashes.  Rows of one fingerprint (or of one set of shingles) are one
  class, so copies cost nothing further.
* Candidates: classes share a bucket of a table if they agree in some bits.  Tables over blocks of the bits miss
  no pair within the radius: cut into radius + g blocks, two fingerprints within it agree in g blocks at least.
  With more classes keys get longer, so that a bucket keeps some ROWS_PER_KEY classes at most by chance.
* Comparison: a task's bit planes are stored vertically, 64 classes a word.  Shifted planes compare every
  class with its d-th neighbour at once; carry-save adders update all distances, and words in which no pair
  can still be within the radius are abandoned.
* Two passes.  The first takes a few tables, cuts buckets of over BUCKET classes into chunks and compares inside
  chunks only; its components are labels.  The second takes all tables, leaves out buckets of one label, and
  tells links between labels only.  In a bucket of over BUCKET classes those of the most frequent label need
  no comparison with each other: they are dealt once for each chunk of the other classes.  So a group of n
  copies gives in the order of n links and rows, and no pair of different labels is left out.
* Components: smallest labels spread along links, with pointer jumping; each round is a written table.

Empty table: empty result.  Null text counts as empty.  A text without words has the fingerprint zero and is
linked like any other.  Rows with a null identifier get a fingerprint and are links between others; a component
is null if none of its rows has an identifier.  Repeated rows share a class.  Extra columns are ignored;
one_of_each() keeps them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from . import bitmap
from .joins import looked_up
from .pretokens import chunks, slices
from .scratch import drop, same, stored

#: Classes of a bucket that one task compares; a larger bucket is cut into chunks.
BUCKET = 1024
#: A row in a further table costs about as much as so many comparisons, so buckets are to hold no more by chance.
ROWS_PER_KEY = 1024
#: Sets of shingles that one task compares; a larger group is cut into chunks.
CHUNK = 256
#: Tables of the first pass.
EARLY = 3
SLAB = 1 << 15
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_U = np.uint64


# ---- hashing -------------------------------------------------------------------------------------------

_P1, _P2, _P3, _P4, _P5 = map(_U, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return x << _U(r) | x >> _U(64 - r)


def _round(lane: np.ndarray) -> np.ndarray:
    return _rotl(lane * _P2, 31) * _P1


def xxh64(data: bytes, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of data[start : start + length] for all pairs; equal lengths are hashed together."""
    padded = data + bytes(8)
    u8 = np.frombuffer(padded, np.uint8)
    u32 = np.ndarray((len(data) + 4,), "<u4", padded, strides=(1,))
    u64 = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = np.empty(len(start), np.uint64)
    order = np.argsort(length.astype(np.uint16) if len(length) and length.max() < 1 << 16 else length, kind="stable")
    sizes, at = np.unique(length[order], return_index=True)
    s = _U(seed)
    with np.errstate(over="ignore"):
        for n, own in zip(sizes.tolist(), np.split(order, at[1:]), strict=True):
            p = start[own]
            k = 0
            if n >= 32:
                v = [np.full(len(p), x, np.uint64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
                while n - k >= 32:
                    for i in range(4):
                        v[i] = _rotl(v[i] + u64[p + (k + 8 * i)] * _P2, 31) * _P1
                    k += 32
                h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
                for x in v:
                    h = (h ^ _round(x)) * _P1 + _P4
            else:
                h = np.full(len(p), s + _P5, np.uint64)
            h = h + _U(n)
            while n - k >= 8:
                h = _rotl(h ^ _round(u64[p + k]), 27) * _P1 + _P4
                k += 8
            if n - k >= 4:
                h = _rotl(h ^ u32[p + k].astype(np.uint64) * _P1, 23) * _P2 + _P3
                k += 4
            while k < n:
                h = _rotl(h ^ u8[p + k].astype(np.uint64) * _P5, 11) * _P1
                k += 1
            h = (h ^ h >> _U(33)) * _P2
            h = (h ^ h >> _U(29)) * _P3
            out[own] = h ^ h >> _U(32)
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h + _U(0x9E3779B97F4A7C15)
        x = (x ^ x >> _U(30)) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ x >> _U(27)) * _U(0x94D049BB133111EB)
        return x ^ x >> _U(31)


def _shingles(part: list[str], words: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every shingle, repeats included, the index of its text, and the number of shingles of each text."""
    tokens = [t.encode().translate(_LOWER).split() for t in part]
    n = np.fromiter(map(len, tokens), np.int64, len(tokens))
    data = b" ".join(w for t in tokens for w in t)
    at = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    begin, end = np.append(0, at + 1), np.append(at, len(data))
    doc_at = np.cumsum(n) - n
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    total = int(count.sum())
    doc = np.repeat(np.arange(len(n)), count)
    first = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + doc_at[doc]
    last = first + np.minimum(n, words)[doc] - 1
    h = np.empty(total, np.uint64)
    for i in range(0, total, 1 << 16):
        a, b = first[i : i + (1 << 16)], last[i : i + (1 << 16)]
        h[i : i + (1 << 16)] = xxh64(data, begin[a], end[b] - begin[a], seed)
    return h, doc, count


def shingle_fingerprints(texts: list[str | None], words: int = 4, seed: int = 42) -> np.ndarray:
    """Majority bits over all shingles, repeats included, of each text."""
    out = [np.zeros(0, np.uint64)]
    for _, _, part in chunks(texts):
        hashes, doc, count = _shingles(part, words, seed)
        ones = np.zeros((len(part), 64), np.int64)
        for i in range(0, len(hashes), 1 << 16):
            h, d = hashes[i : i + (1 << 16)], doc[i : i + (1 << 16)]
            bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little")
            edge = np.append(0, np.flatnonzero(np.diff(d)) + 1)
            ones[d[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int32)
        major = (2 * ones > count[:, None]).astype(np.uint8)
        out.append(np.packbits(major, axis=1, bitorder="little").view("<u8")[:, 0])
    return np.concatenate(out)


def shingle_sets(texts: list[str | None], words: int = 5, seed: int = 42) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles."""
    out = []
    for _, _, part in chunks(texts):
        h, _, count = _shingles(part, words, seed)
        out += [np.unique(x) for x in np.split(h, np.cumsum(count)[:-1])]
    return out


def set_fingerprints(sets: list[np.ndarray], bands: int) -> np.ndarray:
    """Majority bits of each set of hashes: a column for each 64 bits, each from hashes mixed anew."""
    out = np.zeros((len(sets), bands), np.uint64)
    salt = _mixed(np.arange(1, bands + 1, dtype=np.uint64))
    for k, h in enumerate(sets):
        ones = np.zeros(64 * bands, np.int64)
        for i in range(0, len(h), 255):  # so many fit the sums of one byte
            each = _mixed(h[i : i + 255, None] ^ salt)
            bits = np.unpackbits(each.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little")
            ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
        out[k] = np.packbits(2 * ones > len(h), bitorder="little").view("<u8")
    return out


# ---- bit-sliced comparison -----------------------------------------------------------------------------


def _planes(fp: np.ndarray) -> np.ndarray:
    """64 rows of words; bit i % 64 of word i // 64 of row p is bit p of fingerprint i."""
    padded = np.zeros(-(-len(fp) // 64) * 64, np.uint64)
    padded[: len(fp)] = fp
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def _add(a, b, c):
    """Full adder over words: sum and carry."""
    x = a ^ b
    return x ^ c, a & b | x & c


def neighbours(fp: np.ndarray, group: np.ndarray, radius: int):
    """For d = 1, 2, ...: indices i such that i and i + d are of one group and within the radius (at most 63)."""
    n = len(fp)
    planes = _planes(fp)
    width = planes.shape[1]
    planes = np.concatenate([planes, np.zeros((64, 1), np.uint64)], axis=1)
    d = 0
    while True:
        d += 1
        same = group[:-d] == group[d:] if d < n else np.zeros(0, bool)
        if not same.any():
            return
        bits = np.zeros(width * 64, np.uint8)
        bits[: n - d] = same
        open_ = np.packbits(bits, bitorder="little").view("<u8")
        at = np.flatnonzero(open_)
        live = open_[at]
        q, r = divmod(d, 64)
        zero = np.zeros(len(at), np.uint64)
        c0, c1, c2, over = zero, zero, zero, zero
        high = [zero] * max(0, radius.bit_length() - 3)  # eights and more
        for p in range(0, 64, 8):
            lo = np.minimum(at + q, width)
            own, near = planes[p : p + 8, at], planes[p : p + 8, lo] >> _U(r)
            if r:
                near |= planes[p : p + 8, np.minimum(at + q + 1, width)] << _U(64 - r)
            x = own ^ near
            c0, a = _add(c0, x[0], x[1])
            c0, b = _add(c0, x[2], x[3])
            c1, e = _add(c1, a, b)
            c0, a = _add(c0, x[4], x[5])
            c0, b = _add(c0, x[6], x[7])
            c1, f = _add(c1, a, b)
            c2, g = _add(c2, e, f)
            for i, c in enumerate(high):
                high[i], g = c ^ g, c & g
            over = over | g
            far = over | _above([c0, c1, c2, *high], radius)
            left = (live & ~far) != 0
            if not left.all():  # abandon words without a pair that may still be near
                at, live, c0, c1, c2, over = at[left], live[left], c0[left], c1[left], c2[left], over[left]
                high = [c[left] for c in high]
                if not len(at):
                    break
        if len(at):
            near = live & ~(over | _above([c0, c1, c2, *high], radius))
            lanes = np.unpackbits(near.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            w, lane = np.nonzero(lanes)
            if len(w):
                yield d, at[w] * 64 + lane


def _above(count: list[np.ndarray], radius: int):
    """Lanes whose count, in bits from the lowest, is above the radius."""
    out = np.zeros_like(count[0])
    equal = ~out
    for k in reversed(range(len(count))):
        c = count[k]
        if radius >> k & 1:
            equal = equal & c
        else:
            out = out | equal & c
            equal = equal & ~c
    return out


def _joined(fp: np.ndarray, group: np.ndarray, side: np.ndarray, label: np.ndarray, radius: int, counts) -> np.ndarray:
    """Pairs (i, j) within the radius that join labels; pairs of labels joined already are left out.

    side is 0 in a group of one chunk; in one of two chunks it tells them apart (1 and 2), and only pairs
    between them count.  counts(i, j): further conditions, or None."""
    _, first, own = np.unique(label, return_index=True, return_inverse=True)
    parent = first[own]
    out = []
    for d, i in neighbours(fp, group, radius):
        j = i + d
        ok = (parent[i] != parent[j]) & ((side[i] == 0) | (side[i] != side[j]))
        i, j = i[ok], j[ok]
        if counts is not None and len(i):
            ok = counts(i, j)
            i, j = i[ok], j[ok]
        if not len(i):
            continue
        out.append(np.stack([i, j], axis=1))
        a, b = parent[i], parent[j]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


# ---- plan ----------------------------------------------------------------------------------------------


def block_plan(classes: int, radius: int) -> tuple[int, int]:
    """(blocks, agreeing): keys over so many agreeing blocks keep buckets under ROWS_PER_KEY by chance."""
    agree = 2
    while agree < 6 and ROWS_PER_KEY << (64 * agree // (radius + agree)) < classes:
        agree += 1
    return radius + agree, agree


def block_masks(blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of the blocks of 64 bits."""
    ends = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _bucket_keys(fp: Column, blocks: int, agree: int) -> list[Column]:
    masks = block_masks(blocks)
    parts = [F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in masks]
    out = []
    for t, which in enumerate(combinations(range(blocks), agree)):
        key = F.lit(t << 48)
        at = 0
        for i in which:
            key = key.bitwiseOR(F.call_function("shiftleft", parts[i], F.lit(at)))
            at += masks[i][1]
        out.append(key)
    return out


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _place(a: Column, b: Column, side: Column | int) -> Column:
    return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), (F.lit(side) if isinstance(side, int) else side).alias("side"))


def _crossed(rows: DataFrame, key: str, most: int) -> DataFrame:
    """rows (key, id, label, ...) of large groups dealt to tasks (a, b) with a side, so that any two rows of
    different labels meet.

    Rows of a group's most frequent label are cut into chunks and meet the chunks of the others only."""
    per = stored(rows.groupBy(key, "label").agg(F.count(F.lit(1)).alias("c")), "label-sizes")
    top = F.max(F.struct("c", "label")).alias("top")
    half = most // 2
    shape = per.groupBy(key).agg(top, F.sum("c").alias("n")).where("n > top.c").select(
        key, F.col("top.label").alias("resident"), F.ceil(F.col("top.c") / half).cast("int").alias("cr"), F.ceil((F.col("n") - F.col("top.c")) / half).cast("int").alias("cv")
    )
    big = rows.join(stored(shape, "large-groups"), key)
    h = F.xxhash64("id", F.lit(2))
    mine = F.pmod(h, F.when(F.col("label") == F.col("resident"), F.col("cr")).otherwise(F.col("cv"))).cast("int")
    others = F.sequence(F.lit(0), F.col("cv") - 1)
    resident = F.transform(others, lambda j: _place(-1 - mine, j, 2))
    visitor = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("cr") - 1), lambda r: _place(-1 - r, mine, 1)),
        F.transform(others, lambda j: _place(F.least(j, mine), F.greatest(j, mine), F.when(j == mine, 0).when(mine < j, 1).otherwise(2))),
    )
    dealt = big.withColumn("t", F.explode(F.when(F.col("label") == F.col("resident"), resident).otherwise(visitor)))
    return dealt.select(*rows.columns, "t.a", "t.b", "t.side")


def _sorted(dealt: DataFrame, key: str) -> DataFrame:
    return dealt.repartition(_tasks(dealt), key, "a", "b").sortWithinPartitions(key, "a", "b", "side", "label")


def _slabs(batches) -> Iterator[list[np.ndarray]]:
    """Columns of whole groups (the first three columns), some SLAB rows together."""
    held = None
    for b in batches:
        cols = [c.to_numpy() for c in b.columns]
        held = cols if held is None else [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
        if len(held[0]) >= SLAB:
            change = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0) | (np.diff(held[2]) != 0))
            if len(change):
                cut = int(change[-1]) + 1
                yield [x[:cut] for x in held]
                held = [x[cut:] for x in held]
    if held is not None and len(held[0]):
        yield held


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _compared(dealt: DataFrame, prints: list[str], radius: int, judge) -> DataFrame:
    """(a, b): pairs of labels that a pair of rows (k, a, b, side, label, prints) of one task joins; rows of a
    task stand together, in order.

    The first of the prints differ in at most radius bits; judge(prints, i, j) may ask for more."""

    def run(batches):
        for k, a, b, side, label, *cols in _slabs(batches):
            edge = (np.diff(k) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)
            several = ~(np.append(True, edge) & np.append(edge, True))  # rows alone in their group are left out
            group = np.cumsum(np.append(0, edge))[several]
            own = [x.view(np.uint64)[several] for x in cols]
            label = label[several]
            at = _joined(own[0], group, side[several], label, radius, judge and (lambda i, j, own=own: judge(own, i, j)))
            yield _pairs(label[at[:, 0]], label[at[:, 1]])

    return dealt.select("k", "a", "b", "side", "label", *prints).mapInArrow(run, "a long, b long")


def _large(rows: DataFrame) -> DataFrame:
    return stored(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET), "large-buckets")


def linked(classes: DataFrame, prints: list[str], radius: int, judge: Callable | None = None) -> DataFrame:
    """(id, component) of the classes (id, prints, keys: a bucket of each table) that have a link.

    Classes are linked if they share a bucket, differ in at most radius bits of the first print, and judge
    (if any) agrees.  A component is the smallest identifier of its classes."""
    rows = classes.select("id", F.col("id").alias("label"), *prints, F.explode(F.slice("keys", 1, EARLY)).alias("k"))
    large = _large(rows)
    chunk = F.coalesce(F.pmod(F.xxhash64("id", "k"), F.ceil(F.col("n") / BUCKET)), F.lit(0)).cast("int")
    dealt = rows.join(large, "k", "left").select("k", chunk.alias("a"), F.lit(0).alias("b"), F.lit(0).alias("side"), "label", *prints)
    early = components(_compared(_sorted(dealt, "k"), prints, radius, judge).distinct())
    label = F.coalesce("component", "id").alias("label")
    named = stored(classes.join(early, "id", "left").select("id", label, *prints, "keys"), "labelled")
    drop(large, early)

    rows = named.select("id", "label", *prints, F.explode("keys").alias("k"))
    large = _large(rows)
    dealt = rows.select("k", "label", *prints).repartition(_tasks(rows), "k")
    hot = not large.isEmpty()
    if hot:
        dealt = dealt.join(large.select("k"), "k", "left_anti")
    zero = F.lit(0)
    dealt = dealt.sortWithinPartitions("k", "label").select("k", zero.alias("a"), zero.alias("b"), zero.alias("side"), "label", *prints)
    edges = _compared(dealt, prints, radius, judge)
    if hot:
        edges = edges.unionByName(_compared(_sorted(_crossed(rows.join(large.select("k"), "k"), "k", BUCKET), "k"), prints, radius, judge))
    late = components(edges.distinct())
    out = _after(named.select("id", "label"), late)
    drop(large, late, named)
    return out


def _after(named: DataFrame, late: DataFrame) -> DataFrame:
    """(id, component) of named (id, label) once labels are joined further; those of one row are left out."""
    final = named.join(late.select(F.col("id").alias("label"), "component"), "label", "left").select("id", F.coalesce("component", "label").alias("component"))
    final = stored(final, "components")
    many = final.where("id != component").select("component").distinct()
    return stored(final.join(many, "component", "left_semi"), "components")


def alike(sets: list[np.ndarray], side: np.ndarray, label: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs (i, j) of sets with a Jaccard similarity of at least least that join labels; pairs of labels joined
    already are left out.  Sides as in _joined, in order."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.append(0, np.cumsum(n))
    seen = np.zeros(int(flat.max()) + 1 if len(flat) else 1, np.int32)
    full = np.flatnonzero(n)  # sums over slices need at least one element each
    _, parent = np.unique(label, return_inverse=True)
    second = int(np.searchsorted(side, 2))
    out = []
    for i in range(len(sets) - 1):
        lo = max(i + 1, second) if side[i] == 1 else i + 1
        if side[i] == 2 or not n[i]:
            continue
        first = int(np.searchsorted(full, lo))
        j = full[first:]
        if not len(j) or not (parent[j] != parent[i]).any():
            continue
        own = flat[start[i] : start[i + 1]]
        seen[own] = 1
        both = np.add.reduceat(seen[flat[start[j[0]] :]], start[j] - start[j[0]])
        seen[own] = 0
        for k in j[(both >= least * (n[i] + n[j] - both) - 1e-9) & (parent[j] != parent[i])].tolist():
            if parent[k] != parent[i]:
                out.append((i, k))
                parent[parent == parent[k]] = parent[i]
    return out


def _judged(dealt: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs of labels that a pair of sets (g, a, b, side, label, s) of one task joins."""

    def run(batches):
        key, labels, side, own = None, [], [], []

        def found():
            at = alike([np.frombuffer(x, np.uint64) for x in own], np.array(side), np.array(labels), least) if len(own) > 1 else []
            if at:
                yield _pairs(*(np.array([labels[x[k]] for x in at], np.int64) for k in (0, 1)))

        for batch in batches:
            for g, a, b, sd, label, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (g, a, b) != key:
                    yield from found()
                    key, labels, side, own = (g, a, b), [], [], []
                labels.append(label)
                side.append(sd)
                own.append(x)
        yield from found()

    return _sorted(dealt, "g").select("g", "a", "b", "side", "label", "s").mapInArrow(run, "a long, b long").distinct()


def verified(members: DataFrame, least: float) -> DataFrame:
    """(id, component) of the members (g, id, s: sorted hashes of a set) that have a link inside their group g.

    Members are linked if their sets agree in least at the least (Jaccard, exact).  All pairs of a group are
    judged: a group of up to CHUNK at once, a larger one in chunks that share the member whose identifier is
    the group's, and then between what is not joined so far."""
    sizes = stored(members.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK), "large-groups")
    many = F.ceil(F.col("n") / CHUNK).cast("int")
    chunk = F.when(F.col("n").isNull(), F.array(F.lit(0))).when(F.col("id") == F.col("g"), F.sequence(F.lit(0), many - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("id"), many).cast("int"))
    )
    rows = members.select("g", "id", "s")
    dealt = rows.join(sizes, "g", "left").select("g", F.explode(chunk).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("side"), F.col("id").alias("label"), "s")
    early = components(_judged(dealt, least))
    named = stored(members.select("g", "id").join(early, "id", "left").select("g", "id", F.coalesce("component", "id").alias("label")), "labelled")
    if sizes.isEmpty():
        return early
    large = rows.join(sizes.select("g"), "g").join(named.select("id", "label"), "id").select("g", "id", "label", "s")
    late = components(_judged(_crossed(large, "g", CHUNK), least))
    out = _after(named.select("id", "label"), late)
    drop(sizes, early, late, named)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(id, component): smallest identifier that each linked one reaches.

    A round takes the smallest label among neighbours and then the label's label; rounds end when no label
    changes.  Tables are written between rounds, and joins are plain, so a hub's rows can be split."""
    edges = stored(edges, "links")
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links2")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        seen = labels.select(F.col("id").alias("b"), "component")
        least = both.join(seen, "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        least = stored(least, "least")
        own = labels.join(least, "id", "left").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        own = stored(own, "labels")
        jump = own.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = own.join(jump, "component", "left").select("id", "old", F.least("component", F.coalesce("further", "component")).alias("component"))
        new = stored(new, "labels")
        drop(labels, least, own)
        changed = not new.where("component != old").isEmpty()
        if not changed:
            drop(edges, both)
            return same(new, new.select("id", "component"))
        labels = new


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp) of each row."""

    def run(batches):
        for b in slices(batches, 1):
            fp = shingle_fingerprints(b.column(1).to_pylist(), words, seed)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def grouped(signed: DataFrame, radius: int) -> DataFrame:
    """Stored rows (id, fp) with component_id: the smallest identifier among fingerprints linked to the row's."""
    classes = stored(signed.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "classes")
    sizes = classes.agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("rows")).first()
    keys = F.array(*_bucket_keys(F.col("fp"), *block_plan(sizes["classes"], radius)))
    total = sizes["rows"] or 0
    label = linked(classes.select(F.col("fp").alias("id"), "fp", keys.alias("keys")), ["fp"], radius)
    named = classes.join(label.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "n", "first", F.coalesce("component", "fp").alias("root"))
    named = stored(named, "named")
    several = named.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("m"))
    table = stored(looked_up(named, several, ["root"], "m", sizes["classes"]).select("fp", "n", "component_id"), "named")
    drop(classes, named, label)
    return looked_up(signed, table, ["fp"], "n", total).drop("n")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """A row per document: id, fingerprint, component_id."""
    signed = stored(fingerprints(docs, id_col, text_col, words), "fingerprints")
    return grouped(signed, radius).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Chance that a bit of two fingerprints is equal where a fifth of the union of two sets is not shared.
SAME_BIT = 0.848


def table_plan(rows: int, miss: float = 0.003) -> tuple[int, int]:
    """(bits, tables): keys of 16 bits, or of more where buckets would hold over ROWS_PER_KEY rows by chance; and
    so many tables that a pair at the limit has no common bucket with a chance of miss at most."""
    bits = min(40, max(16, math.ceil(math.log2(max(1, rows) / ROWS_PER_KEY))))
    return bits, math.ceil(math.log(miss) / math.log1p(-(SAME_BIT**bits)))


def _table_keys(prints: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """A key of so many bits from each row's prints for each table, in 32 bits if it fits."""
    flags = np.unpackbits(np.ascontiguousarray(prints).astype("<u8").view(np.uint8), axis=1, bitorder="little")
    flags = flags[:, : bits * tables].reshape(len(prints), tables, bits).astype(np.float32 if bits <= 24 else np.float64)
    keys = (flags @ (2 ** np.arange(bits)).astype(flags.dtype)).astype(np.int64) | np.arange(tables, dtype=np.int64) << bits
    return keys.astype(np.int32) if bits + tables.bit_length() < 32 else keys


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 23, shingle_bits: int = 38, least: float = 0.8, words: int = 5
) -> DataFrame:
    """docs with one document of each group of near-duplicates: that with the smallest identifier (a null one
    comes last; then the smallest hash of identifier and text).

    Near-duplicates agree in least of their distinct five-word shingles, or are linked by such pairs.
    Fingerprints over distinct shingles only find groups of candidates, so it does not matter whether words
    were changed, inserted or appended: at the limit of 0.8 a bit differs with a probability of 0.152 at most.
    A table's bits are its own (table_plan).  In a bucket candidates are those within radius of 64 bits (9.7 in
    the mean, with a deviation of 2.9) and shingle_bits of 128 (19.5, 4.1; 64 without common shingles).  Then all
    pairs of a group are judged by their shingles.  Texts of equal shingle sets are one class.  Rows that repeat
    an identifier and its text stay or go together.  Columns of any name pass through."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    key = F.unhex(F.sha2(F.concat_ws("\n", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(text, F.lit(""))), 256))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), key.alias("rk"), text.alias("text"))
    total = docs.count()
    bits, tables = table_plan(total)
    bands = -(-bits * tables // 64)

    def run(batches):
        for b in slices(batches, 2):
            sets = shingle_sets(b.column(2).to_pylist(), words)
            same = [xxh3_128_digest(x.tobytes()) for x in sets]
            s = set_fingerprints(sets, 2 + bands)
            keys = _table_keys(s[:, 2:], bits, tables)
            keys = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, tables, dtype=np.int32), keys.ravel())
            prints = (pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (s[:, 0], s[:, 1]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same, pa.binary()), *prints, keys], ["id", "rk", "ck", "s0", "s1", "keys"])

    def judge(prints, i, j):
        return sum(np.bitwise_count(x[i] ^ x[j]).astype(np.int64) for x in prints) <= shingle_bits

    schema = f"id long, rk binary, ck binary, s0 long, s1 long, keys array<{'int' if bits + tables.bit_length() < 32 else 'long'}>"
    signed = stored(rows.select("id", "rk", "text").mapInArrow(run, schema), "fingerprints")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "rk")
    found = signed.groupBy("ck").agg(F.min(F.struct(rank.alias("rank"), "s0", "s1", "keys")).alias("v"), F.count(F.lit(1)).alias("n"))
    classes = stored(found.select(F.monotonically_increasing_id().alias("id"), "ck", "v.rank", "n", "v.s0", "v.s1", "v.keys"), "classes")
    loose = linked(classes.select("id", "s0", "s1", "keys"), ["s0", "s1"], radius, judge)
    members = stored(loose.join(classes.select("id", F.col("rank.rk").alias("rk")), "id").select("id", "rk", F.col("component").alias("g")), "members")

    def hashed(batches):
        for b in slices(batches, 2):
            s = [x.tobytes() for x in shingle_sets(b.column(2).to_pylist(), words)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.binary())], ["g", "id", "s"])

    some = bitmap.keep_possible(rows.select("rk", "text"), F.col("rk"), bitmap.build(members, F.col("rk")))
    some = some.join(members, "rk").dropDuplicates(["rk"]).select("g", "id", "text").mapInArrow(hashed, "g long, id long, s binary")
    sets = stored(some, "sets")
    label = verified(sets, least)
    named = stored(classes.join(label, "id", "left").select("ck", "n", "rank", F.coalesce("component", "id").alias("root")), "named")
    first = named.groupBy("root").agg(F.min("rank").alias("keep"), F.count(F.lit(1)).alias("m"))
    table = stored(looked_up(named, first, ["root"], "m", total).select("ck", "n", F.col("keep.rk").alias("keep")), "named")
    later = looked_up(signed.select("rk", "ck"), table, ["ck"], "n", total).where("rk != keep").select("rk")
    later = stored(later.distinct(), "later-copies")
    drop(signed, classes, loose, members, sets, label, named, table)
    tagged = bitmap.tag(rows.select("row", "rk"), F.col("rk"), bitmap.build(later, F.col("rk")))
    stay = tagged.where("not _possible").select("row.*")
    move = tagged.where("_possible").join(later, "rk", "left_anti").select("row.*")
    return stay.unionByName(move)


def op10_simhash_bitsliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
