"""A corpus from raw documents: language ID, line dedup, near-dedup, decontamination, token ids.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of
documents; the last one returns token ids.  Between stages the documents are a written table.

Empty table: every stage returns no rows.  Null text counts as empty: the language stage rejects it.
Repeated rows stay or go together.  Extra columns pass through the filtering stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm import bpe, decontaminate, langid, lines, simhash
from sievelight.llm.frames import together
from sievelight.llm.scratch import inside, stored

#: The best language's score must reach MOST, or, with more languages, LIFT times the 1/n that each of n languages
#: gets from a model that knows nothing of the text.  With two or three languages no score is so low: a choice
#: between so few says little about others, and clean documents stay.
MOST, LIFT = 0.3, 1.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; the others have no letter or fit no language."""
    learn = docs.where(~langid.held_out(F.col("doc_id")))
    model = langid.fit(learn, F.col("text"), F.col("lang"), F.col("doc_id"))
    least = min(MOST, LIFT / max(1, len(model.languages)))
    known = langid.scored(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return known.select(*together(docs.columns, "text"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document has; n_chars follows the text."""
    kept = lines.drop_lines(docs, counts=False)
    return kept.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """ids of each document with the hashes of ids and of the bytes they decode to."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), with_ids=True)


STAGES = [
    ("language_id", language),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("byte_bpe", token_ids),
]

#: Learned weights and fingerprints cannot be expressed in SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with inside(spark) as kept:  # a stage's own tables go once its result is written
            docs = stored(stage(spark, docs, sf_dir), name)
            kept.append(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
