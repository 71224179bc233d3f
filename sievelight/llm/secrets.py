"""Secret scan with corpus-wide ownership frequency.

Each text gives base spans (assignments, access keys, long hexadecimal runs) and candidates: the values of
base spans and other long tokens that look random.  A candidate's hash is counted over distinct
repositories and owners of the whole corpus.  A value that several owners have, or very many repositories of
one, is a copied example; what is in few repositories of one owner alone belongs to it.  A candidate that looks
live adds a span ``live`` if it is its owner's, and ``copied`` if it is an example.  Base spans always stay.

Counting goes by (hash, owner, repository), then (hash, owner), then hash, each with partial sums before
its shuffle, so a value in a third of all rows costs one row per split.  Values leave a task only as hashes.

Empty table: empty result.  Null text counts as empty: no spans.  A null owner or repository is one owner
or repository of its own.  Rows are told apart by position, so repeated or null identifiers keep their own
spans.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import looked_up
from .scratch import stored

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Texts without any of these have no span; it may pass more texts than have one.
_MAY_HOLD = r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=])|AKIA[A-Z0-9]{16}|[A-Za-z0-9+/_=-]{20}"""
KINDS = ("assign", "access", "hex", "live", "copied")
MIN_ENTROPY = 3.0
_EXAMPLE = re.compile(r"example|sample|changeme|placeholder|xxxx|1234567|abcdef|dummy", re.I)


def entropy(s: str) -> float:
    n = len(s)
    return -sum(k / n * math.log2(k / n) for k in (s.count(c) for c in set(s)))


def looks_live(value: str) -> bool:
    return len(value) >= 16 and entropy(value) >= MIN_ENTROPY and not _EXAMPLE.search(value)


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[bytes, int, int, bool]]]:
    """Base spans (start, kind, end) in order; candidates (hash, start, end, looks live)."""
    text = text or ""
    spans, values = [], set()
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 6:
            spans.append((m.start(), 0, m.end()))
            values.add((m.start(2), m.end(2)))
    for kind, pattern in ((1, ACCESS), (2, HEX)):
        for m in pattern.finditer(text):
            spans.append((m.start(), kind, m.end()))
            values.add(m.span())
    for m in TOKEN.finditer(text):
        v = m.group()
        if any("0" <= c <= "9" for c in v) and any(c.isalpha() for c in v):
            values.add(m.span())
    found = []
    for i, j in sorted(values):
        v = text[i:j]
        found.append((hashlib.blake2b(v.encode(), digest_size=16).digest(), i, j, looks_live(v)))
    return sorted(spans), found


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{i}:{j}" for i, k, j in spans)


_CANDIDATES = "array<struct<hash:binary,start:int,end:int,live:boolean>>"
_SCANNED = f"row long, doc_id long, owner string, repo string, n_assign long, n_access long, n_hex long, base_sha256 string, base string, candidates {_CANDIDATES}"
_NONE = hashlib.sha256(b"").hexdigest()


def _scan_batches(batches):
    kind = pa.list_(pa.struct([("hash", pa.binary()), ("start", pa.int32()), ("end", pa.int32()), ("live", pa.bool_())]))
    for b in batches:
        texts = b.column(4)
        may = pc.fill_null(pc.match_substring_regex(texts, _MAY_HOLD), False).to_pylist()
        n = [[0] * len(may) for _ in range(3)]
        sums, base, found = [_NONE] * len(may), [""] * len(may), [[] for _ in may]
        for i, yes in enumerate(may):
            if yes:
                spans, values = scan(texts[i].as_py())
                for _, k, _ in spans:
                    n[k][i] += 1
                base[i] = written(spans)
                sums[i] = hashlib.sha256(base[i].encode()).hexdigest()
                found[i] = [{"hash": h, "start": s, "end": e, "live": v} for h, s, e, v in values]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), b.column(2), b.column(3), *(pa.array(x, pa.int64()) for x in n), pa.array(sums), pa.array(base), pa.array(found, kind)],
            ["row", "doc_id", "owner", "repo", "n_assign", "n_access", "n_hex", "base_sha256", "base", "candidates"],
        )


def ownership(candidates: DataFrame) -> DataFrame:
    """hash, owners, repos, uses of rows (hash, owner, repo)."""
    a = candidates.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    b = a.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return b.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("uses"))


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None,
    repo: Column | None = None, copied_owners: int = 2, copied_repos: int = 20,
) -> tuple[DataFrame, DataFrame]:
    """(documents, values).  documents: a row per input row with counts and all spans.  values: a row per
    candidate hash with owners, repos, uses and whether it is a copied example.

    owner and repo default to the columns of these names; so many owners, or so many repositories (of one owner
    or several), make a value an example."""
    owner = F.col("owner") if owner is None else owner
    repo = F.col("repo") if repo is None else repo
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
        owner.cast("string").alias("owner"), repo.cast("string").alias("repo"), F.col(text_col).alias("text"),
    )
    scanned = stored(rows.mapInArrow(_scan_batches, _SCANNED), "scanned")
    each = scanned.select("row", "owner", "repo", F.explode("candidates").alias("c")).select("row", "owner", "repo", "c.*")
    copied = (F.col("owners") >= copied_owners) | (F.col("repos") >= copied_repos)
    values = stored(ownership(each).withColumn("copied", copied), "values")
    kind = F.when(F.col("copied"), 5).otherwise(4).alias("kind")
    total = values.agg(F.sum("uses")).first()[0] or 0
    judged = looked_up(each.where("live").select("row", "hash", "start", "end"), values.select("hash", "uses", "copied"), ["hash"], "uses", total).groupBy("row").agg(
        F.collect_list(F.struct("start", kind, "end")).alias("extra")
    )
    names = F.array(*map(F.lit, KINDS))
    base = F.transform(
        F.filter(F.split("base", ","), lambda s: s != ""),
        lambda s: F.struct(
            F.split(s, ":")[1].cast("int").alias("start"),
            F.array_position(names, F.split(s, ":")[0]).cast("int").alias("kind"),
            F.split(s, ":")[2].cast("int").alias("end"),
        ),
    )
    extra = F.coalesce("extra", F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    every = F.sort_array(F.concat(base, extra))
    spans = F.array_join(
        F.transform(every, lambda s: F.concat_ws(":", F.element_at(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )

    def of(kind: int) -> Column:
        return F.size(F.filter(extra, lambda s: s["kind"] == kind)).cast("long")

    out = scanned.drop("candidates").join(judged, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"), of(4).alias("n_live"), of(5).alias("n_copied")
    )
    return out, values


def op5_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source stands for the owner, source and language for the repository."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan_secrets(docs, owner=F.col("source"), repo=F.concat_ws("/", "source", "lang"))[0]
