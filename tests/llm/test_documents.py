"""Operators against brute force over all rows of a small table, and over an empty one."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import prose
from pyspark.sql import functions as F

from sievelight.llm import bpe, decontaminate, exact_dedup, langid, lines, pretokens, secrets, sharding, simhash, token_output

tokens = pytest.importorskip("public_tokenizers")


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- exact dedup ---------------------------------------------------------------------------------------


def exact_expected(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t, _ in rows]
    groups = defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    out = []
    for i, t in norm:
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_dedup(docs, rows, digest_bytes):
    """Also with digests so short that unequal texts collide: bytes decide."""
    assert collected(exact_dedup.dedup(docs, digest_bytes=digest_bytes)) == exact_expected(rows)


def test_exact_dedup_levels(spark, docs, rows):
    """Runs are sorted; filters let through what merges; level 2 is the whole index, however runs are cut."""
    want = Counter(re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, _ in rows)
    for parts in (1, 3, 11):
        runs = exact_dedup.flush(docs.repartition(parts), "doc_id", "text", 32)
        for part in runs.select("digest").rdd.glom().collect():
            assert [bytes(x[0]) for x in part] == sorted(bytes(x[0]) for x in part) or parts > 1
        first = exact_dedup.merged(runs)
        assert first.groupBy("run", "digest").count().where("count > 1").isEmpty()
        second = {bytes(r["digest"]): r["n"] for r in exact_dedup.compacted(first).collect()}
        assert second == {hashlib.sha256(t.encode()).digest(): n for t, n in want.items()}
        one = next(iter(second))
        assert exact_dedup.found(runs, [one]).count() == second[one]


def test_exact_dedup_probes_filters(spark):
    """The lookup's predicate reaches the runs: a digest that no run has is looked up without reading a row, though
    it lies between a run's least and largest."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    runs = exact_dedup.flush(docs.repartition(2), "doc_id", "text", 32)

    def looked_up(text):
        frame = exact_dedup.found(runs, [hashlib.sha256(text).digest()])
        got = [r["id"] for r in frame.collect()]
        leaf = frame._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        return got, leaf.metrics().apply("numOutputRows").value()

    assert looked_up(b"no such text") == ([], 0)
    got, read = looked_up(b"text 77")
    assert got == [77] and 0 < read <= 12_000


def test_exact_dedup_empty(none):
    assert exact_dedup.dedup(none).count() == 0


# ---- token files ---------------------------------------------------------------------------------------


def test_token_files(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    path, name = str(tmp_path / "ids"), tokens.path("byte_bpe_50k.json")
    token_output.write_ids(docs, path, name, row_group=1000)
    got = {(r["doc_id"], tuple(r["ids"])): r for r in token_output.read_ids(spark, path).collect()}
    own = Tokenizer.from_file(name)
    own.encode_special_tokens = True
    start = 0
    for i, t, _ in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or "")):
        ids = (*own.encode(t or "", add_special_tokens=False).ids, 2)
        r = got[i, ids]
        assert r["n_tokens"] == len(ids)
        assert r["start"] == start or (i, ids) == (28, ids)  # repeated rows share a key here
        start += len(ids)
    assert [tuple(r) for r in token_output.lookup(spark, path, [29]).collect()] == [(29, own.encode("short").ids + [2])]


def test_token_query_like_library(spark, tmp_path):
    """The query against the library, text by text: special tokens' strings, odd signs, nulls, a null identifier."""
    from tokenizers import Tokenizer

    r = random.Random(6)
    parts = ["<|endoftext|>", "<|", "endoftext|>", " ", "\n", "'s", "a", "É", "中", "😀", "9", "ing", "\x00", "\xa0", "the "]
    data = [(k, "".join(r.choice(parts) for _ in range(r.randint(0, 30)))) for k in range(300)] + [(300, None), (301, "a <|endoftext|> b"), (302, "<|endoftext|>")]
    spark.createDataFrame(data, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    own = Tokenizer.from_file(tokens.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    want, start = [], 0
    for k, t in data:
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_output.op2_orc_token_ids(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert collected(got) == sorted(want, key=repr)


def test_token_files_are_pruned(spark, tmp_path):
    """Files have stripes, row groups and Bloom filters; a lookup reads a row group at most, or nothing."""
    from pyarrow import orc

    path = str(tmp_path / "ids")
    docs = spark.range(0, 24_000, 2).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    token_output.write_ids(docs, path, tokens.path("byte_bpe_50k.json"), stripe_bytes=64 << 10, row_group=1000)
    files = [f.split("file:")[-1] for f in spark.read.orc(path).inputFiles()]
    assert max(orc.ORCFile(f).nstripes for f in files) > 1

    def read(doc_id):
        frame = token_output.lookup(spark, path, [doc_id])
        n = len(frame.collect())
        return n, frame._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()

    n, rows = read(5000)
    assert n == 1 and rows <= 1000
    assert sum(read(i)[1] for i in range(5001, 5021, 2)) <= 2000  # ten absent ones between others: filters let few through


def test_long_texts(spark):
    """Texts over a slice are cut where pieces end; runs without such a place stay whole."""
    import tiktoken

    name = tokens.path("byte_bpe_multi_50k.tiktoken")
    own = bpe.Codec(name)
    other = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    r = random.Random(9)
    parts = ["word", " ", "  ", "\n", "'s", "'", "é", "12", "!", "\t ", "\xa0"]
    for text in ("".join(r.choice(parts) for _ in range(3000)), "ab " * 400, "x" * 900, " " * 900, "x" * 300 + " " * 300 + "y" * 300):
        assert "".join(pretokens.cut(text, 64)) == text
        ids = [x for part, _ in pretokens.encoded(own.coder, [text], 64) for x in part.tolist()]
        assert ids == other.encode_ordinary(text)
    assert max(map(len, pretokens.cut("ab " * 400, 64))) <= 67


def test_pieces_are_compared(monkeypatch):
    """Pieces whose hashes are equal though they differ get their own ids."""
    own = bpe.Codec(tokens.path("byte_bpe_multi_50k.tiktoken"))
    texts = [prose(3, 200), "other words entirely 12 !!", prose(4, 50)]
    want = [x.tolist() for x in own.encode(texts)]
    for mix in (np.uint64(0), np.uint64(1)):
        weak = bpe.Codec(tokens.path("byte_bpe_multi_50k.tiktoken"))
        weak.coder.mix = np.full(0x110000, mix, dtype=np.uint64)  # all pieces (of a length) collide
        assert [x.tolist() for x in weak.encode(texts)] == want


def test_token_checksums(docs, rows, spark, tmp_path):
    path = str(tmp_path / "ids")
    token_output.write_ids(docs, path, tokens.path("byte_bpe_50k.json"))
    out = token_output.read_ids(spark, path).select("doc_id", "start", "ids").mapInArrow(token_output.checked, "doc_id long, start long, n_tokens long, ids_crc32 long")
    by = {r["doc_id"]: r for r in out.collect()}
    assert len(by) == len({i for i, _, _ in rows})
    assert by[21]["ids_crc32"] == zlib.crc32((2).to_bytes(4, "little")) and by[21]["n_tokens"] == 1


def test_token_files_empty(spark, none, tmp_path):
    token_output.write_ids(none, str(tmp_path / "ids"), tokens.path("byte_bpe_50k.json"))
    assert token_output.read_ids(spark, str(tmp_path / "ids")).count() == 0


# ---- BPE -----------------------------------------------------------------------------------------------


def test_bpe_like_tiktoken():
    import tiktoken

    name = tokens.path("byte_bpe_multi_50k.tiktoken")
    own = bpe.Codec(name)
    other = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    r = random.Random(3)
    parts = ["'", "s", "t", "re", "ll", " ", "  ", "\n", "\t", "a", "É", "9", "٣", "!", "-", "\x1c", "\x85", "中", "😀", "<|endoftext|>", "\xa0", "ing", "\r\n", "\x00"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(1500)] + ["a" * 3000, " " * 700 + "b", None, ""]
    got = own.encode(texts)
    assert [g.tolist() for g in got] == [other.encode_ordinary(t or "") for t in texts]
    assert all(own.decode(g) == (t or "").encode() for g, t in zip(got, texts, strict=True))


def test_bpe_frames(docs, rows):
    import tiktoken

    name = tokens.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.round_trip(docs, name)
    other = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=bpe.read_ranks(name), special_tokens={})
    want = []
    for i, t, _ in rows:
        ids = other.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert collected(out) == sorted(want, key=repr)
    assert Counter(r["decoded_sha256"] for r in out.collect()) == Counter(hashlib.sha256((t or "").encode()).hexdigest() for _, t, _ in rows)
    back = bpe.decode(bpe.encode(docs, name), name)
    assert Counter(bytes(r["decoded"]) for r in back.collect()) == Counter((t or "").encode() for _, t, _ in rows)


def test_bpe_empty(none):
    assert bpe.round_trip(none, tokens.path("byte_bpe_multi_50k.tiktoken"), with_ids=True).count() == 0


# ---- secrets -------------------------------------------------------------------------------------------


def base_spans(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    for k, p, n in ((1, r"AKIA[A-Z0-9]+", 20), (2, r"[0-9a-f]+", 24)):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text) if m.end() - m.start() >= n]
    return sorted(out)


def test_secrets_base(docs, rows):
    out, _ = secrets.scan_secrets(docs, owner=F.col("source"), repo=F.col("source"))
    want = []
    for i, t, _ in rows:
        s = base_spans(t)
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in s)
        want.append((i, *(sum(k == n for _, k, _ in s) for n in range(3)), hashlib.sha256(text.encode()).hexdigest()))
    got = out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    assert collected(got) == sorted(want, key=repr)
    for r in out.collect():
        spans = r["spans"].split(",") if r["spans"] else []
        assert sum(not s.startswith(("live", "copied")) for s in spans) == r["n_assign"] + r["n_access"] + r["n_hex"]
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)


def test_secrets_ownership(spark):
    shared, own, vendored = "q8Zr1mPw7Lx2Vb6Nk4Ty", "c9Dt5hJs3Gf0Yw8Kb2Xe", "m3Kq9vRb1Zt7Xc5Pd8Wh"
    data = [(i, f"token = {shared}", f"o{i}", "r") for i in range(4)] + [(9, f"key {own} and {own}", "o1", "r"), (10, f"see {own}", "o1", "r")]
    data += [(20 + i, f"see {vendored}", "o1", f"r{i}") for i in range(3)]
    frame = spark.createDataFrame(data, "doc_id long, text string, owner string, repo string")
    out, values = secrets.scan_secrets(frame, copied_repos=3)
    got = {r["doc_id"]: r["spans"] for r in out.collect()}
    assert got[0] == "assign:0:28,copied:8:28"
    assert got[9] == "live:4:24,live:29:49" and got[10] == "live:4:24"
    assert got[20] == "copied:4:24"  # one owner, but in many of its repositories
    assert {r["spans"] for r in secrets.scan_secrets(frame, copied_repos=4)[0].where("doc_id >= 20").collect()} == {"live:4:24"}
    assert sorted((r["owners"], r["repos"], r["uses"], r["copied"]) for r in values.collect()) == [(1, 1, 3, False), (1, 3, 3, True), (4, 4, 4, True)]


def test_secrets_against_brute_force(spark):
    """All spans of random texts, with null owners and repositories: each value judged by counting its places."""
    r = random.Random(8)
    values = ["".join(r.choice("abcdefghijkABCDEFGHIJK0123456789") for _ in range(r.randint(18, 40))) for _ in range(25)]
    values += ["AKIA" + "".join(r.choice("ABCDEFGHJK23456789") for _ in range(16)) for _ in range(4)] + ["0123456789abcdef" * 2, "EXAMPLEexample123456789"]
    data = []
    for i in range(140):
        v = [r.choice(values) for _ in range(r.randint(0, 3))]
        text = " ".join(r.choice(("{}", "token = {}", "password:'{}'", "see {},")).format(x) for x in v)
        data.append((i if i % 9 else None, text if i % 13 else None, r.choice(["a", "a", "a", None, f"o{i}"]), r.choice(["r1", "r2", None, f"q{i}"])))
    places = defaultdict(lambda: (set(), set()))
    rows = []
    for i, t, owner, repo in data:
        t = t or ""
        spans = [(a, k, b) for a, k, b in base_spans(t)]
        found = {(m.start(2), m.end(2)) for m in secrets.ASSIGN.finditer(t) if m.end(2) - m.start(2) >= 6} | {(a, b) for a, k, b in spans if k}
        found |= {m.span() for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", t) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])}
        for a, b in found:
            places[t[a:b]][0].add(owner)
            places[t[a:b]][1].add((owner, repo))
        rows.append((i, t, spans, found))
    want = []
    for i, t, spans, found in rows:
        for a, b in found:
            if secrets.looks_live(t[a:b]):
                owners, repos = places[t[a:b]]
                spans.append((a, 4 if len(owners) >= 2 or len(repos) >= 5 else 3, b))
        want.append((i, ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))))
    out, _ = secrets.scan_secrets(spark.createDataFrame(data, "doc_id long, text string, owner string, repo string").repartition(5), copied_repos=5)
    assert collected(out.select("doc_id", "spans")) == sorted(want, key=repr)
    kinds = Counter(x.split(":")[0] for _, s in want for x in s.split(",") if x)
    assert kinds["live"] > 5 and kinds["copied"] > 20


def test_secrets_empty(none):
    out, values = secrets.scan_secrets(none, owner=F.col("source"), repo=F.col("source"))
    assert out.count() == 0 and values.count() == 0


# ---- sharding ------------------------------------------------------------------------------------------


def test_shards(docs, rows):
    out = sharding.shuffle_shards(docs, shards=5, rows_per_block=3).collect()
    assert len(out) == len(rows)
    assert Counter(r["text"] for r in out) == Counter(t for _, t, _ in rows)
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    sizes = [len(v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 1 and len(by) == 5
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shards_deal_whole_documents(spark, rows, docs, tmp_path, monkeypatch):
    """The query's exchange carries the texts, in blocks bounded by bytes; digests are those of the dealt rows."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    dealt, cut = [], []
    whole, sizes = sharding.shuffle_shards, sharding.block_sizes
    monkeypatch.setattr(sharding, "shuffle_shards", lambda df, *a, **b: dealt.append(df.columns) or whole(df, *a, **b))
    monkeypatch.setattr(sharding, "block_sizes", lambda *a: cut.append(sizes(*a)) or cut[-1])
    monkeypatch.setattr(sharding, "BYTES_PER_BLOCK", 2000)
    out = sharding.op6_hypergeometric_shards(spark, str(tmp_path)).collect()
    assert set(dealt[0]) >= set(docs.columns) - {"shard"}
    assert len(cut[0]) > sharding.SHARDS
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want


def test_shards_empty(none):
    assert sharding.shuffle_shards(none).count() == 0


def test_matrix_law():
    """Sums are exact; a cell's mean and variance are those of a uniform permutation (brute force)."""
    parts, blocks = [30, 50, 20, 7], [25, 25, 40, 17]
    n, runs = sum(parts), 1500
    owner, place = np.repeat(np.arange(4), parts), np.repeat(np.arange(4), blocks)
    r = np.random.default_rng(0)
    drawn, brute = [], []
    for s in range(runs):
        m = np.stack([sharding.matrix_row(np.array(parts), np.array(blocks), i, s) for i in range(4)])
        assert (m >= 0).all() and m.sum(1).tolist() == parts and m.sum(0).tolist() == blocks
        drawn.append(m)
        brute.append(np.bincount(owner * 4 + place[r.permutation(n)], minlength=16).reshape(4, 4))
    drawn, brute = np.array(drawn), np.array(brute)
    assert np.allclose(drawn.mean(0), np.outer(parts, blocks) / n, rtol=0.06, atol=0.12)
    assert np.allclose(drawn.mean(0), brute.mean(0), rtol=0.08, atol=0.2) and np.allclose(drawn.var(0), brute.var(0), rtol=0.3)


def test_order_is_uniform(spark):
    """Every row is about equally likely in every shard, and in every part of one, wherever it was."""
    hits = np.zeros((4, 4))
    for seed in range(12):
        out = sharding.shuffle_shards(spark.range(160).repartition(4, "id"), shards=2, rows_per_block=30, seed=seed).collect()
        at = np.array([(r["id"] // 40, r["shard"] * 2 + (r["slot"] >= 40)) for r in out])
        assert sorted((r["shard"], r["slot"]) for r in out) == [(s, k) for s in range(2) for k in range(80)]
        np.add.at(hits, (at[:, 0], at[:, 1]), 1)
    assert np.abs(hits / 12 - 10).max() < 2.5


def test_write_shards(spark, docs, rows, tmp_path):
    path = str(tmp_path / "shards")
    sharding.write_shards(docs.drop("shard"), path, shards=3)
    back = spark.read.parquet(path)
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((i, t) for i, t, _ in rows)
    for part in sorted({f.split("file:")[-1] for f in back.inputFiles()}):
        slots = [r["slot"] for r in spark.read.parquet(part).collect()]
        assert slots == sorted(slots)


def test_large_draws():
    rng = np.random.default_rng(1)
    x = [sharding._univariate(rng, 3_000_000_000, 1_000_000_000, 10_000) for _ in range(300)]
    assert abs(np.mean(x) - 7500) < 15 and 30 < np.std(x) < 60
    assert sharding._hypergeometric(rng, np.array([2_000_000_000] * 3), 999).sum() == 999


# ---- line dedup ----------------------------------------------------------------------------------------


def lines_expected(rows):
    first, many = {}, defaultdict(set)
    split = [(i, (t or "").split("\n")) for i, t, _ in rows]

    def key(s):
        k = s.strip(" \t\n\x0b\x0c\r")
        return re.sub("[A-Z]", lambda m: m[0].lower(), k) if len(k) >= 10 else None

    def rank(i):
        return i is None, i or 0

    for i, ls in split:
        for s in ls:
            if key(s):
                many[key(s)].add(i)
                first[key(s)] = min(first.get(key(s), rank(i)), rank(i))
    out = []
    for i, ls in split:
        keep = [s for s in ls if not (key(s) and len(many[key(s)]) > 1 and first[key(s)] != rank(i))]
        out.append((i, len(ls), len(ls) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [10_000, 20])
def test_lines(spark, docs, rows, monkeypatch, hot):
    """In many shards, with and without a shard of hot keys; the largest identifier is not that of null ones."""
    monkeypatch.setattr(lines, "KEYS_PER_SHARD", 3)
    monkeypatch.setattr(lines, "HOT", hot)
    more = [(None, "a line of rows without identifier", "en"), (None, "a line of rows without identifier\nx", "en"), ((1 << 63) - 1, "A line of rows without identifier", "en")]
    more += [(100 + k, f"the hot line of many documents\nown {k}", "en") for k in range(30)]
    rows = rows + more
    docs = docs.unionByName(spark.createDataFrame([(i, t, c, "s", 1, "x", 1, "y") for i, t, c in more], docs.schema))
    out = lines.drop_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    got = out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256))
    assert collected(got) == lines_expected(rows)


def test_lines_keep_columns(docs):
    """Columns whose names the operator uses itself come back as they were."""
    names = ["_id", "_row", "_lost", "row", "rk", "lost", "shard", "tk", "id", "n_lines", "n_dropped", "_possible", "line"]
    wide = docs.select("doc_id", "text", *(F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in names))
    out = lines.drop_lines(wide, counts=False)
    assert out.columns == wide.columns
    assert all(r[n] == f"{n}{'-' if r['doc_id'] is None else r['doc_id']}" for r in out.collect() for n in names)
    assert collected(out.select("doc_id", "text")) == collected(lines.drop_lines(docs).select("doc_id", "text"))
    assert lines.drop_lines(docs.select("doc_id", "text"), "doc_id").columns == ["doc_id", "text", "n_lines", "n_dropped"]


def test_lines_empty(none):
    assert lines.drop_lines(none).count() == 0


def test_perfect_hash():
    h = np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64)
    levels = lines.build_mph(h)
    assert sorted(lines.number(levels, h).tolist()) == list(range(5000))
    assert lines.number(levels, np.zeros(0, np.uint64)).tolist() == []
    hi, lo = np.array([5, 9, 5, 7]), np.array([1, 2, 3, 4])  # two keys share a half of their hash
    own = lines._Several([lines.Shard(a) for a in lines.packed(hi, lo, np.array([2, 1, 3, 2]), np.array([10, 11, 12, 13]))])
    here, gone = own.probe(np.array([5, 5, 5, 9, 7]), np.array([1, 3, 4, 2, 4]), np.array([10, 10, 0, 0, 13]), np.array([True, True, True, True, False]))
    assert here.tolist() == [True, True, False, True, True] and gone.tolist() == [False, True, False, False, True]


# ---- language ------------------------------------------------------------------------------------------


def test_language(spark):
    alphabets = {"aa": "klmno", "bb": "pqrst", "cc": "uvwxy"}
    r = random.Random(5)
    data = []
    for i in range(240):
        lang = "abc"[i % 3] * 2
        data.append((i, " ".join("".join(r.choice(alphabets[lang]) for _ in range(5)) for _ in range(r.randint(3, 60))), lang if i % 7 else None))
    data += [(900, None, "aa"), (901, "", "aa"), (902, "123 !! ²", None), (903, "klmno " * 400_000, None), (None, "pqrst", "bb")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))), F.col("text"), F.col("lang"), F.col("doc_id"))
    out = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    hits = [out[i]["lang_pred"] == "abc"[i % 3] * 2 for i in range(240)]
    assert np.mean(hits) > 0.98
    assert [out[i]["lang_pred"] for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "aa", "bb"]
    assert all(0 <= r["score"] <= 1 for r in out.values())
    # a slice-wise sum of a long text is that of the whole
    assert (model.table != 0).mean() < 0.9


def test_language_features():
    """Hashed n-grams against single characters, one by one."""
    def slow(text):
        c = [32] + [ord(x) if x.isalpha() else 32 for x in text.lower()]
        m32 = (1 << 32) - 1

        def place(x):
            x ^= x >> 15
            x = x * 0x2C1B3C6D & m32
            return (x ^ x >> 13) & langid.DIM - 1

        out = []
        for k in range(len(c)):
            one = c[k] * 0x9E3779B1 & m32
            two = (one + c[k - 1] * 0x85EBCA77 & m32) ^ 0x2545F491 if k else one
            three = (one + c[k - 1] * 0xC2B2AE3D + c[k - 2] * 0x27D4EB2F & m32) ^ 0x165667B1 if k > 1 else two
            out.append((place(one), place(two), place(three)))
        return out

    texts = ["Hello, wörld 12", "x", "", "ΑΒΓ straße"]
    got, at = langid.features(texts)
    ends = [*at[1:].tolist(), got.shape[1]]
    for t, i, j in zip(texts, at.tolist(), ends, strict=True):
        assert [tuple(x) for x in got[:, i:j].T.tolist()] == slow(t)
    places, tf = langid.vector("Hello, wörld 12")
    count = Counter(x for g in slow("Hello, wörld 12") for x in g)
    assert dict(zip(places.tolist(), tf.tolist(), strict=True)) == pytest.approx({k: v / 48 for k, v in count.items()})


def test_leader_against_scalars():
    """Follow the regularised leader, one coordinate at a time; the L1 penalty leaves weights at zero."""
    r = np.random.default_rng(2)
    rows = [(np.sort(r.choice(12, 4, replace=False)), r.random(4), int(r.integers(3))) for _ in range(30)]
    alpha, beta, l1, l2 = 0.5, 1.0, 0.3, 0.1
    w, bias = langid.ftrl(rows, 3, epochs=2, alpha=alpha, beta=beta, l1=l1, l2=l2, seed=5)
    z, n = defaultdict(float), defaultdict(float)

    def weight(i, k):
        if abs(z[i, k]) <= l1:
            return 0.0
        return -(z[i, k] - np.sign(z[i, k]) * l1) / ((beta + n[i, k] ** 0.5) / alpha + l2)

    order = np.random.default_rng(5)
    for _ in range(2):
        for t in order.permutation(len(rows)):
            at, x, y = rows[t]
            at, x = [*at.tolist(), langid.DIM], [*x.tolist(), 1.0]
            own = [[weight(i, k) for k in range(3)] for i in at]
            s = [sum(v * o[k] for v, o in zip(x, own, strict=True)) for k in range(3)]
            e = [np.exp(v - max(s)) for v in s]
            for i, v, o in zip(at, x, own, strict=True):
                for k in range(3):
                    g = v * (e[k] / sum(e) - (k == y))
                    z[i, k] += g - ((n[i, k] + g * g) ** 0.5 - n[i, k] ** 0.5) / alpha * o[k]
                    n[i, k] += g * g
    assert np.allclose(w[:12], [[weight(i, k) for k in range(3)] for i in range(12)]) and np.allclose(bias, [weight(langid.DIM, k) for k in range(3)])
    assert 0 < (w[:12] == 0).sum() < 36


def test_temperature_against_grid():
    r = np.random.default_rng(1)
    y = r.integers(0, 3, 400)
    scores = r.normal(size=(400, 3))
    scores[np.arange(400), y] += 1.0
    scores *= 6  # far too sure

    def loss(t):
        s = scores / t
        return float(np.mean(np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(400), y]))

    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 4000))
    assert langid.temperature(scores, y) == pytest.approx(min(grid, key=loss), rel=0.01)
    assert langid.temperature(np.zeros((0, 3)), np.zeros(0, np.int64)) == 1.0


def test_language_bounds(spark, monkeypatch):
    """Labels beyond the bound are not learned, the most frequent ones are; the sample follows its bound."""
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    monkeypatch.setattr(langid, "SAMPLE", 40)
    taught = []
    monkeypatch.setattr(langid, "ftrl", lambda rows, classes, f=langid.ftrl: taught.append(len(rows)) or f(rows, classes))
    data = [(i, {0: "aaa bbb", 1: "ccc ddd"}.get(i % 3, "eee"), {0: "x", 1: "y"}.get(i % 3, f"rare{i}")) for i in range(600)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.col("text"), F.col("lang"), F.col("doc_id"))
    assert model.languages == ["x", "y"] and 5 < taught[0] < 60


def test_language_keeps_columns(docs):
    model = langid.fit(docs, F.col("text"), F.col("lang"), F.col("doc_id"))
    wide = docs.select("doc_id", "text", F.col("lang").alias("row"), F.lit("mine").alias("score"), F.lit("mine").alias("lang_pred"))
    out = langid.scored(wide, model)
    assert {r["score"] for r in out.select("row.score").collect()} == {"mine"}
    assert langid.predict(wide, model).columns == ["doc_id", "text", "row", "lang_pred", "score"]


def test_language_without_training(none, docs):
    model = langid.fit(none, F.col("text"), F.col("lang"), F.col("doc_id"))
    assert {tuple(r) for r in langid.predict(docs, model).select("lang_pred", "score").collect()} == {("und", 0.0)}
    assert langid.predict(none, model).count() == 0


# ---- SimHash -------------------------------------------------------------------------------------------


def test_xxh64():
    from xxhash import xxh64_intdigest

    r = random.Random(1)
    data = bytes(r.randrange(256) for _ in range(3000))
    at, n = np.array([r.randrange(2000) for _ in range(800)]), np.array([r.randrange(200) for _ in range(800)])
    assert simhash.xxh64(data, at, n).tolist() == [xxh64_intdigest(data[i : i + k], 42) for i, k in zip(at, n, strict=True)]


def fingerprint(text):
    from xxhash import xxh64_intdigest

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    g = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(ids, prints, radius):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= radius:
                parent[root(a)] = root(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [least.get(root(k)) for k in range(len(ids))]


def test_near_duplicates(docs, rows):
    prints = [fingerprint(t) for _, t, _ in rows]
    want = sorted(((i, f"{p:016x}", c) for (i, _, _), p, c in zip(rows, prints, grouped([i for i, _, _ in rows], prints, 4), strict=True)), key=repr)
    assert collected(simhash.near_duplicates(docs)) == want


def test_rows_without_identifier_link_others(spark):
    """A null identifier is a bridge like any other row; alone it has no component."""
    prints = [0b1111, 0b1, 1 ^ 0b11110000, (1 << 63) - 1]
    signed = spark.createDataFrame(list(zip([1, None, 7, None], prints, strict=True)), "id long, fp long")
    got = {(r["id"], r["fp"]): r["component_id"] for r in simhash.grouped(signed, 4).collect()}
    assert list(got.values()).count(1) == 3 and got[None, prints[3]] is None


@pytest.mark.parametrize("bucket", [1024, 64])
def test_links_chain_and_hot_bucket(spark, monkeypatch, bucket):
    """Chains that need several rounds, and buckets far over the chunk size."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    r = random.Random(2)
    chain, x = [], r.getrandbits(64)
    for _ in range(40):
        chain.append(x)
        for b in r.sample(range(64), 4):
            x ^= 1 << b
    hot, base = [], r.getrandbits(64)
    for _ in range(700):
        hot.append(base ^ sum(1 << b for b in r.sample(range(24), 3)))
    prints = [*chain, *hot, *(r.getrandbits(64) for _ in range(200))]
    signed = [(k, int(np.uint64(p).astype(np.int64))) for k, p in enumerate(prints)]
    out = simhash.grouped(spark.createDataFrame(signed, "id long, fp long"), 4)
    assert [r["component_id"] for r in out.orderBy("id").collect()] == grouped(list(range(len(prints))), prints, 4)


def test_near_duplicates_empty(none):
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.one_of_each(none).count() == 0


def test_one_of_each(docs, rows):
    kept = Counter(r["doc_id"] for r in simhash.one_of_each(docs).collect())
    assert 23 not in kept and 24 not in kept and 25 not in kept  # copies of 3, a near copy of 5
    assert None not in kept  # a near copy of 7: a null identifier comes last
    assert all(i in kept for i in range(20)) and 34 in kept


def test_one_of_each_keeps_columns(spark, docs, rows):
    """Columns whose names the operator uses itself come back as they were; rows that repeat one stay together."""
    names = ["tk", "s", "_tk", "_id", "id", "rk", "row", "n", "k", "label", "component", "_possible", "n_lines"]
    wide = docs.select("doc_id", "text", *(F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in names))
    out = simhash.one_of_each(wide)
    assert out.columns == wide.columns
    got = out.collect()
    assert all(r[n] == f"{n}{r['doc_id']}" for r in got for n in names)
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in simhash.one_of_each(docs).collect())
    assert Counter(r["doc_id"] for r in got)[28] == 2
    alone = spark.createDataFrame([(None, "some words that nobody else has here"), (None, "some words that nobody else has here")], "doc_id long, text string")
    assert simhash.one_of_each(alone).count() == 2


def test_one_of_each_in_chunks(spark, monkeypatch):
    """A group of near copies of which few pairs are alike, over many chunks: links against brute force."""
    monkeypatch.setattr(simhash, "CHUNK", 16)
    monkeypatch.setattr(simhash, "BUCKET", 32)
    r = random.Random(11)
    base = prose(70, 90).split()
    texts = [" ".join(base)]
    for k in range(220):
        own = list(texts[r.randrange(len(texts))].split()) if k % 3 else list(base)
        for at in r.sample(range(len(own)), 1 + k % 3):
            own[at] = f"w{k}x{at}"
        texts.append(" ".join(own))
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if five_word_jaccard(texts[a], texts[b]) >= 0.8:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    out = simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    want = {k for k in range(len(texts)) if root(k) == k}
    assert 10 < len(want) < 200 and {x["doc_id"] for x in out.collect()} == want


def test_table_plan():
    """The keys' length follows the rows, and the chance to miss a pair at the limit does not."""
    assert simhash.table_plan(1) == simhash.table_plan(10_000_000) == (16, 79)
    for n in (10**8, 10**9, 10**11):
        bits, tables = simhash.table_plan(n)
        assert simhash.ROWS_PER_KEY << bits >= n and (1 - simhash.SAME_BIT**bits) ** tables <= 0.003
    assert [simhash.block_plan(n, 4) for n in (1, 10**9, 10**11)] == [(6, 2), (6, 2), (7, 3)]
    prints = np.random.default_rng(3).integers(0, 1 << 63, (5, 2), dtype=np.uint64)
    for bits, tables in ((16, 8), (20, 6), (40, 3)):
        whole = [int(a) | int(b) << 64 for a, b in prints]
        want = [[(x >> bits * t) & (1 << bits) - 1 | t << bits for t in range(tables)] for x in whole]
        assert simhash._table_keys(prints, bits, tables).tolist() == want


def five_word_jaccard(a, b):
    x, y = (set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in (a, b))
    return len(x & y) / len(x | y)


def test_one_of_each_keeps_below_limit(spark):
    """Copies with a shingle similarity under 0.8 stay; a large group is judged in pairs of chunks."""
    base = prose(7, 120).split()
    texts = [" ".join(base)]
    for k in range(300):
        own = list(base)
        for at in ((30, 60) if k % 2 else (20, 50, 90)):
            own[at] = f"own{k}"
        texts.append(" ".join(own))
    out = simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    want = {0, *(k + 1 for k in range(300) if five_word_jaccard(texts[0], texts[k + 1]) < 0.8)}
    near = set(range(301)) - want
    assert near and not any(five_word_jaccard(texts[i], texts[j]) >= 0.8 for i in want for j in near if i and j)
    assert {r["doc_id"] for r in out.collect()} == want


def test_one_of_each_finds_insertions(spark):
    """Appended and inserted words, and short texts: pairs found against brute force."""
    texts = []
    for k in range(240):
        own = prose(1000 + k, (13, 110, 400)[k % 3]).split()
        more = prose(5000 + k, len(own) // 5).split()
        if k % 3 == 0:
            other = [*own[:-1], f"last{k}"]
        elif k % 2:
            other = own + more
        else:
            other = [*own[:30], *more[: len(own) // 6], *own[30:]]
        texts += [" ".join(own), " ".join(other)]
    near = {k for k in range(1, 480, 2) if five_word_jaccard(texts[k - 1], texts[k]) >= 0.8}
    got = {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    lost = set(range(480)) - got
    assert len(near) >= 200 and lost <= near and len(near - lost) <= 4


def test_neighbours_of_any_radius():
    r = np.random.default_rng(5)
    fp = r.integers(0, 1 << 63, 150, dtype=np.uint64)
    fp[75:] = fp[:75] ^ np.uint64(0xFFFF) >> r.integers(0, 16, 75, dtype=np.uint64)
    group = np.zeros(150, np.int64)
    for radius in (3, 7, 8, 23, 31, 40):
        got = {(int(i), int(i) + d) for d, at in simhash.neighbours(fp, group, radius) for i in at}
        assert got == {(i, j) for i in range(150) for j in range(i + 1, 150) if int(fp[i] ^ fp[j]).bit_count() <= radius}


# ---- decontamination -----------------------------------------------------------------------------------


def shingles(text):
    w = [x for x in re.split(r"[^\w]+|_+", (text or "").lower()) if x]
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_contained(spark, docs, rows):
    texts = {i: t for i, t, _ in rows}
    one = texts[8].split()
    items = [
        (0, " ".join(one[5:30])), (1, " ".join(one[40:60]).upper() + "!!"), (2, " ".join([*one[:14], "other", *one[15:60]])), (3, "words that no document holds at all"),
        (4, None), (5, ""), (6, "short"), (7, " ".join(texts[22].split()[4000:4030])), (7, " ".join(texts[22].split()[4000:4030])), (8, " ".join(one[:8] + ["q"] * 8)),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, t, _ in rows:
        d = shingles(t)
        for k, s in items:
            s = shingles(s)
            if s and 5 * len(d & s) >= 4 * len(s):
                want.add((i, k, len(d & s), len(s)))
    found = decontaminate.contained(docs, bench)
    assert {tuple(r) for r in found.select("doc_id", "item_id", F.col("shared"), "n_shingles").collect()} == want
    assert {(8, 0), (8, 1), (8, 2), (22, 7), (29, 6)} <= {w[:2] for w in want}
    kept = [r["doc_id"] for r in decontaminate.clean_documents(docs, bench).collect()]
    assert sorted(map(repr, kept)) == sorted(repr(i) for i, _, _ in rows if i not in {w[0] for w in want})


def test_contained_empty(spark, none, docs, rows):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contained(docs, bench).count() == 0
    assert decontaminate.clean_documents(docs, bench).count() == len(rows)
    assert decontaminate.contained(none, docs.select(F.col("doc_id").alias("item_id"), "text")).count() == 0


def test_sketch_misses_nothing(spark):
    """Any document that has four fifths of an item's shingles shares one with its sketch; of items with a
    common beginning the sketches hold what tells them apart."""
    r = random.Random(4)
    common = prose(900, 12)
    items = [(k, f"{common} {prose(901 + k, n)}" if n else common) for k, n in enumerate((0, 1, 2, 5, 9, 17, 33, 60, 60))] + [(50, f"{common} {prose(907, 33)}")]
    sets, owners = decontaminate.item_sets(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text")
    own = {x["set"]: x["s"] for x in sets.collect()}
    assert len(own) == 9 and owners.count() == 10
    by = defaultdict(set)
    for x in decontaminate.sketches(sets).select("set", "hash").collect():
        by[x["set"]].add(x["hash"])
    hashed = {x["v"]: x["h"] for x in spark.createDataFrame([(v,) for s in own.values() for v in s], "v string").select("v", F.xxhash64("v").alias("h")).collect()}
    shared = [h for v, h in hashed.items() if sum(v in s for s in own.values()) > 4]
    for k, s in own.items():
        need = -(-4 * len(s) // 5)
        for _ in range(50):
            assert by[k] & {hashed[v] for v in r.sample(s, need)}
        if len(s) > 20:
            assert not by[k] & set(shared)


def test_contained_keeps_columns(spark, docs):
    """Columns whose names the operators use themselves come back as they were."""
    names = ["tk", "s", "_tk", "set", "row", "body", "bk", "n", "held", "h", "own", "size", "hash"]
    wide = docs.select("doc_id", "text", *(F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in names))
    one = next(r["text"] for r in docs.where("doc_id = 8").collect()).split()
    bench = spark.createDataFrame([(1, " ".join(one[5:30]))], "item_id long, text string")
    found, clean = decontaminate.contained(wide, bench), decontaminate.clean_documents(wide, bench)
    assert found.columns == [*wide.columns, "item_id", "shared", "n_shingles"] and clean.columns == wide.columns
    rows = found.collect() + clean.collect()
    assert len(rows) == docs.count() and found.count() == 1
    assert all(x[n] == f"{n}{'-' if x['doc_id'] is None else x['doc_id']}" for x in rows for n in names)


def test_contained_by_shuffle(spark, docs, monkeypatch):
    one = next(r["text"] for r in docs.where("doc_id = 8").collect()).split()
    bench = spark.createDataFrame([(k, " ".join(one[k : k + 25])) for k in range(9)], "item_id long, text string")
    want = collected(decontaminate.contained(docs.select("doc_id", "text"), bench))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert collected(decontaminate.contained(docs.select("doc_id", "text"), bench)) == want and len(want) == 9
