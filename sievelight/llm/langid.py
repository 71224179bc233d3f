"""Language ID: sparse multinomial logistic regression on TF-IDF of character n-grams.

* Features: n-grams of one to three characters of the lower-cased text (signs that are no letters become
  blanks), hashed into DIM places; a feature's value is its relative frequency times its IDF.
* Document frequencies cover every training document, summed on the executors.
* Weights come from follow-the-regularised-leader (proximal, per coordinate) with L1 and L2 penalties on a
  sample chosen by a hash of the identifier; whole texts.  The L1 penalty leaves many weights zero.
* Bounds of the fit: the LANGUAGES most frequent labels, about PER_LANGUAGE documents of each and SAMPLE in all.
* Temperature: on the part of the sample kept from the fit, the temperature that gives the smallest
  negative log-likelihood.
* Prediction is a segment sum of weight rows over all n-grams of a text, in slices of bounded size.

Empty table, or no labelled training document: every prediction is ``und`` with score 0.  Null text, or text
without a letter: ``und`` with score 0.  A null identifier counts as the text '' for the split.  Repeated rows
are predicted one by one.  Ties go to the language first in alphabetical order.  Columns of any name pass through
predict(), but for lang_pred and score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import apart, together
from .pretokens import chunks, slices

DIM = 1 << 15
LANGUAGES = 256
PER_LANGUAGE = 1200
SAMPLE = 20_000
_U = np.uint64
_tables: dict[str, np.ndarray] = {}


def _signs() -> np.ndarray:
    """Code point to itself for letters, to a blank for others."""
    if "signs" not in _tables:
        t = np.arange(0x110000, dtype=np.uint32)
        t[[i for i in range(0x110000) if not chr(i).isalpha()]] = 32
        _tables["signs"] = t
    return _tables["signs"]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts in turn (as rows of 1- to 3-grams that end at a character) and where each
    text begins; a blank stands before each text."""
    lowered = [" " + t.lower() for t in texts]
    codes = _signs()[np.frombuffer("".join(lowered).encode("utf-32-le"), "<u4")]
    n = np.fromiter(map(len, lowered), np.int64, len(lowered))
    at = np.cumsum(n) - n
    c = codes.astype(np.uint32)
    one = c * np.uint32(0x9E3779B1)
    two, three = one.copy(), one.copy()
    two[1:] += c[:-1] * np.uint32(0x85EBCA77)
    two ^= np.uint32(0x2545F491)
    three[1:] += c[:-1] * np.uint32(0xC2B2AE3D)
    three[2:] += c[:-2] * np.uint32(0x27D4EB2F)
    three ^= np.uint32(0x165667B1)
    out = np.stack([one, two, three])
    for x in out:
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
    # over the first two characters of a text n-grams would reach into the one before
    out[1:, at] = out[0, at]
    second = at[n > 1] + 1
    out[2, second] = out[1, second]
    return (out & np.uint32(DIM - 1)).astype(np.int32), at


def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and relative frequencies of one text."""
    counts = np.zeros(DIM, np.int64)
    for i in range(0, max(1, len(text)), 1 << 20):
        counts += np.bincount(features([text[i : i + (1 << 20)]])[0].ravel(), minlength=DIM)
    at = np.flatnonzero(counts)
    return at, (counts[at] / counts.sum()).astype(np.float32)


# ---- fit -----------------------------------------------------------------------------------------------


def ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0,
    l1: float = 0.02, l2: float = 0.02, seed: int = 7,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (DIM, classes) and biases; rows are (places, values, class)."""
    z, n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))
    order = np.random.default_rng(seed)

    def weights(at: np.ndarray) -> np.ndarray:
        zz, nn = z[at], n[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            at, x = np.append(at, DIM), np.append(x, 1.0)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(DIM + 1))
    return w[:DIM], w[DIM]


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the smallest negative log-likelihood, between 0.05 and 20."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))

    a, b = np.log(0.05), np.log(20.0)
    for _ in range(60):
        c, d = a + (b - a) * 0.382, a + (b - a) * 0.618
        if loss(np.exp(c)) <= loss(np.exp(d)):
            b = d
        else:
            a = c
    return float(np.exp((a + b) / 2))


class Model:
    """languages; table: IDF-weighted weights in 32 bits; bias; temperature."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temp: float) -> None:
        self.languages, self.table, self.bias, self.temp = languages, table.astype(np.float32), bias, temp

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.languages)))
        for i, j, part in chunks(texts, 1 << 18):
            # a long text is taken in slices, so memory stays bounded; sums are the same but for the two
            # n-grams at a slice's start
            if len(part) == 1 and len(part[0]) > 1 << 20:
                t, n = part[0], 0
                for k in range(0, len(t), 1 << 20):
                    f, _ = features([t[k : k + (1 << 20)]])
                    out[i] += sum(self.table[x].sum(axis=0, dtype=np.float64) for x in f)
                    n += f.size
                out[i] /= n
                continue
            f, at = features(part)
            n = np.diff(np.append(at, f.shape[1]))
            sums = np.zeros((len(part), len(self.languages)))
            for x in f:
                sums += np.add.reduceat(self.table[x], at, axis=0)
            out[i:j] = sums / (3 * n)[:, None]
        return out + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        has = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        labels, score = ["und"] * len(texts), [0.0] * len(texts)
        if has and self.languages:
            s = self.scores([texts[i] for i in has]) / self.temp
            p = np.exp(s - s.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            for i, k, v in zip(has, best.tolist(), p.max(axis=1).tolist(), strict=True):
                labels[i], score[i] = self.languages[k], v
        return labels, score


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Documents and, per place, documents that have it, over the rows (text)."""

    def count(batches):
        total, n = np.zeros(DIM, np.int64), 0
        mark = np.zeros(DIM, np.int64)
        for b in slices(batches, 0):
            for _, _, part in chunks(b.column(0).to_pylist(), 1 << 18):
                f, at = features(part)
                for i, j in zip(at.tolist(), [*at[1:].tolist(), f.shape[1]], strict=True):
                    mark[f[:, i:j]] = 1
                    total += mark
                    mark[:] = 0
                n += len(part)
        if n:
            at = np.append(np.flatnonzero(total), DIM)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(total, n)[at])], ["place", "docs"])

    rows = texts.mapInArrow(count, "place long, docs long").groupBy("place").agg(F.sum("docs").alias("docs"))
    df, n = np.zeros(DIM, np.int64), 0
    for r in rows.collect():  # DIM + 1 rows at most
        if r["place"] == DIM:
            n = r["docs"]
        else:
            df[r["place"]] = r["docs"]
    return n, df


def fit(docs: DataFrame, text: Column, lang: Column, key: Column, per_language: int = PER_LANGUAGE) -> Model:
    """docs: training documents.  key: a column whose hash chooses the sample and its calibration part."""
    known = docs.where(lang.isNotNull()).select(F.coalesce(text, F.lit("")).alias("text"), lang.cast("string").alias("lang"), F.xxhash64(key).alias("h"))
    often = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    sizes = {r["lang"]: r["n"] for r in often.collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((DIM, 0)), np.zeros(0), 1.0)
    most = min(per_language, SAMPLE / len(languages))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, most / n))])
    chosen = known.where((F.pmod("h", F.lit(1_000_000)) / 1_000_000) < F.coalesce(share[F.col("lang")], F.lit(0.0)))

    def vectors(batches):
        for b in batches:
            v = [vector(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(1), b.column(2), pa.array([x.astype(np.int32) for x, _ in v], pa.list_(pa.int32())), pa.array([x for _, x in v], pa.list_(pa.float32()))],
                ["lang", "h", "at", "tf"],
            )

    rows = chosen.mapInArrow(vectors, "lang string, h long, at array<int>, tf array<float>").toArrow()
    order = np.argsort(rows.column("h").to_numpy(), kind="stable").tolist()
    n, df = document_frequencies(known.select("text"))
    idf = np.log((1 + n) / (1 + df)) + 1.0
    place = {k: i for i, k in enumerate(languages)}
    langs, hs = rows.column("lang").to_pylist(), rows.column("h").to_pylist()
    at_, tf_ = rows.column("at"), rows.column("tf")
    own, held = [], []
    for i in order:
        at, tf = at_[i].values.to_numpy(), tf_[i].values.to_numpy()
        # a fixed scale brings the values near one, so the penalties have their usual size
        row = (at, (tf * idf[at] * _SCALE).astype(np.float64), place[langs[i]])
        (held if hs[i] // 1_000_000 % 5 == 0 else own).append(row)
    w, bias = ftrl(own, len(languages))
    s = np.array([x @ w[at] + bias for at, x, _ in held]).reshape(-1, len(languages))
    temp = temperature(s, np.array([y for _, _, y in held], dtype=np.int64))
    return Model(languages, w * (idf * _SCALE)[:, None], bias, temp)


_SCALE = 30.0


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """row and text (frames.apart), lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM x LANGUAGES at most

    def run(batches):
        for b in slices(batches, 1):
            labels, score = shared.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(labels, pa.string()), pa.array(score, pa.float64())], [*b.schema.names, "lang_pred", "score"])

    rows = apart(docs, text_col)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (which replace columns of these names)."""
    docs = docs.drop("lang_pred", "score")
    return scored(docs, model, text_col).select(*together(docs.columns, text_col), "lang_pred", "score")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op8_ftrl_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out(F.col("doc_id"))), F.col("text"), F.col("lang"), F.col("doc_id"))
    out = predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")
