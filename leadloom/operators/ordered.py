"""Exact ranks and running values over tables of any size, without a window that holds a whole table or group.

Rows are dealt out in order over range partitions, so a group that holds most rows is split like any other.  What a
partition has to know of those before it is one row each, added up on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import scratch

#: Bits of a row's place within its partition in the numbers that Spark gives to rows.
PLACE_BITS = 33


def in_order(df: DataFrame, *order: Column | str) -> DataFrame:
    """df sorted over range partitions and checkpointed, with __pid, the partition, and __at, the row's place there from 0."""
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(scratch(df.sparkSession))
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    rows = rows.checkpoint()
    place = F.col("__id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return rows.select("*", F.shiftright("__id", PLACE_BITS).alias("__pid"), place.alias("__at")).drop("__id")


def ranked(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """df with its exact rank from 0 by `order`, which should be unique: the counts of the partitions before are added up."""
    rows = in_order(df, *order)
    sizes = sorted((r["__pid"], r["count"]) for r in rows.groupBy("__pid").count().collect())
    before = np.concatenate([[0], np.cumsum([n for _, n in sizes])]).tolist()
    offsets = df.sparkSession.createDataFrame([(p, o) for (p, _), o in zip(sizes, before)], "__pid long, __offset long")
    return rows.join(F.broadcast(offsets), "__pid").withColumn(name, F.col("__offset") + F.col("__at")).drop("__pid", "__at", "__offset")


def running(df: DataFrame, by: str, order: str, mark: str, descending: bool = False) -> DataFrame:
    """(by, order, mark) with what lies before each row of its group in order of `order`, a long: `position` from 1; `last`,
    the `order` of the last marked row before it, null for none; `since`, the rows between that row, or the group's start,
    and this one.  `by` and `order` must not be null, and `order` must be unique in a group.

    The state at the start of each partition - a group, its length so far and its last mark - is worked out on the driver
    from one row of each partition; then each partition is read once, batch by batch.
    """
    way = F.desc if descending else F.asc
    rows = in_order(df.select(by, order, F.coalesce(mark, F.lit(False)).alias(mark)), F.asc(by), way(order))
    groups = rows.groupBy("__pid", by).agg(F.count("*").alias("n"), F.max("__at").alias("at"), F.max(F.when(F.col(mark), F.struct("__at", order))).alias("m"))
    ends = groups.groupBy("__pid").agg(F.max_by(F.struct(F.col(by).alias("by"), "n", "at", "m"), "at").alias("e")).select("__pid", "e.*").orderBy("__pid").collect()
    carry, now = {}, None  # by partition: (group, rows so far, order of the last mark, rows since)
    for e in ends:
        carry[e["__pid"]] = now
        same = now is not None and now[0] == e["by"]
        if e["m"] is not None:
            last, since = e["m"][order], e["at"] - e["m"]["__at"]
        else:
            last, since = (now[2], now[3] + e["n"]) if same else (None, e["n"])
        now = (e["by"], e["n"] + (now[1] if same else 0), last, since)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for pdf in batches:
            if not len(pdf):
                continue
            if pdf["__at"].iloc[0] == 0:
                state = carry[int(pdf["__pid"].iloc[0])]
            group, o, m = pdf[by].to_numpy(), pdf[order].to_numpy(np.int64), pdf[mark].to_numpy(bool)
            i = np.arange(len(pdf))
            fresh = np.append(state is None or group[0] != state[0], group[1:] != group[:-1])
            start = np.maximum.accumulate(np.where(fresh, i, -1))  # -1: the group began before this batch
            marks = np.maximum.accumulate(np.where(m, i, -1))
            marks = np.append(-1, marks[:-1])  # the last marked row before each one
            marks = np.where(marks >= np.maximum(start, 0), marks, -1)
            old = start < 0
            position = np.where(old, i + 1 + (state[1] if state else 0), i - start + 1)
            own = marks >= 0
            last = np.where(own, o[np.maximum(marks, 0)], 0)
            since = np.where(own, i - marks - 1, np.where(old, i + (state[3] if state else 0), i - start))
            has = own | (old & bool(state and state[2] is not None))
            if state and state[2] is not None:
                last = np.where(~own & old, state[2], last)
            shown = pd.Series(last, dtype="Int64").mask(~has)
            yield pd.DataFrame({by: group, order: o, mark: m, "position": position, "last": shown, "since": since})
            k = len(pdf) - 1
            ended = (int(o[k]), 0) if m[k] else (int(last[k]) if has[k] else None, int(since[k]) + 1)
            state = (group[k], int(position[k]), *ended)

    kind = dict(rows.dtypes)
    return rows.mapInPandas(run, f"`{by}` {kind[by]}, `{order}` long, `{mark}` boolean, position long, last long, since long")
