"""A left join whose hot keys do not meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than a part in so many of all rows is hot; so fewer keys than this are.
SHARE = 1000


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """rows with table's columns (null without a match).

    table is unique in on, and its column count says how many of the total rows have the key.  The hot keys are
    fewer than SHARE, as their counts add up to total at most: these are broadcast, and a row that meets one
    does not move.  In the shuffle join of the rest no key has more than a part in SHARE of the rows."""
    limit = max(1, total // SHARE)
    values = [c for c in table.columns if c not in on]
    hot = table.where(F.col(count) > limit).select(*on, F.struct(*values).alias("_hot"))
    met = rows.join(F.broadcast(hot), on, "left")
    out = [*(F.col(c) for c in rows.columns), *(F.col(c) for c in values)]
    near = met.where("_hot is not null").select(*rows.columns, "_hot.*")
    far = met.where("_hot is null").select(*rows.columns).join(table.where(F.col(count) <= limit), on, "left")
    return near.unionByName(far.select(*out))
