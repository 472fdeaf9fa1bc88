"""Joins with a side that has each key once, whatever share of the other side's rows one key holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than 1/SHARE of the rows is hot, so there are fewer than SHARE of them; tables below ROWS have none.
SHARE, ROWS = 1000, 100_000


def unique_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner", rows: int | None = None) -> DataFrame:
    """left joined with right, which has each value of `on` once; `how` is inner, left, left_semi or left_anti.

    Hot keys of left are counted with partial sums and their rows of right broadcast, SHARE at most; the rest is shuffled.
    Rows of left with a null key match nothing and are not shuffled.  `rows` saves a count where the number of rows of left is
    known or bounded.
    """
    keep = how in ("left", "left_anti")
    none, some = left.where(F.col(on).isNull()), left.where(F.col(on).isNotNull())
    n = some.count() if rows is None else rows
    if n < ROWS:
        out = some.join(right, on, how)
    else:
        hot = some.groupBy(on).count().where(F.col("count") > n // SHARE).select(on)
        mark = some.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), on, "left")
        parts = [mark.where(F.col("__hot")).drop("__hot"), mark.where(F.col("__hot").isNull()).drop("__hot")]
        few = F.broadcast(right.join(F.broadcast(hot), on, "left_semi"))
        out = parts[0].join(few, on, how).unionByName(parts[1].join(right, on, how))
    return out.unionByName(none, allowMissingColumns=True) if keep else out


def filled(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
