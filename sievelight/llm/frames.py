"""Rows with their columns packed away, so that no column of an operator clashes with one of theirs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apart(docs: DataFrame, text_col: str, **more: Column) -> DataFrame:
    """row (all columns but the text as one), text, and more columns."""
    others = [c for c in docs.columns if c != text_col] or None
    row = F.struct(*others) if others else F.struct(F.lit(0).alias("none"))
    return docs.select(row.alias("row"), F.col(text_col).cast("string").alias("text"), *(c.alias(n) for n, c in more.items()))


def together(columns: list[str], text_col: str) -> list[Column]:
    """The columns of docs, from row and text."""
    return [F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in columns]
