"""Incremental ingest of JSON records with checkpoints, a key index, state with a time to live, callbacks and counters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.dedup import keep_first
from ..operators.skew import filled
from ..sources.schema import BUSINESS

#: Parts of a key index.  A batch reads the parts that its keys fall into, so many parts make small batches cheap.
BUCKETS = 256


def read_stream(spark: SparkSession, folder: str, schema: str = BUSINESS, files_per_batch: int = 100) -> DataFrame:
    """Records of JSON files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def unique_stream(df: DataFrame, key: str = "place_id", time: str | None = None, within: str = "7 days") -> DataFrame:
    """First record of each key.  With a time column the state of keys is dropped after `within`; else it is kept for good.

    Records without a key are all kept only by `ingest` and `first_records`; here they count as one key.
    """
    if time is None:
        return df.dropDuplicates([key])
    return df.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def first_records(df: DataFrame, key: str, time: str, ttl_ms: int | None = None) -> DataFrame:
    """The first record of each key by event time, over all batches of a stream; the first batch with a key decides.

    Keys are state with the time at which they were seen, and are forgotten `ttl_ms` after it, where that is given.  Records
    with a null or empty key are no group: they all pass through.  Of equal or missing times the first row stays.
    With `ttl_ms` a query that runs until nothing is left needs `spark.sql.streaming.noDataMicroBatches.enabled` off, as Spark
    else goes on with empty batches that look for keys to forget.
    """

    def first(_: Any, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs() if ttl_ms is not None else 0
        if state.hasTimedOut:
            state.remove()
            return
        known = state.exists and (ttl_ms is None or now - state.get[0] < ttl_ms)
        best = None
        for pdf in rows:  # one chunk at a time, so a hot key needs no more memory than others
            if known or not len(pdf):
                continue
            at = pdf[time].reset_index(drop=True)
            row = pdf.iloc[[int(at.argmin()) if at.notna().any() else 0]]
            if best is None or pd.notna(row[time].iloc[0]) and not row[time].iloc[0] >= best[time].iloc[0]:
                best = row
        if best is not None:
            state.update((now,))
            if ttl_ms is not None:
                state.setTimeoutDuration(ttl_ms)
            yield best[names]

    names = df.columns
    keyed = df.where(filled(key)).withColumn("__key", F.col(key).cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    timeout = GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    found = keyed.groupBy("__key").applyInPandasWithState(first, schema, "seen long", "append", timeout)
    return found.unionByName(df.where(~filled(key)))


class KeyIndex:
    """The keys of a table in a folder of its own, by hash in BUCKETS parts, each row with the batch that brought it."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def of(self, df: DataFrame) -> DataFrame:
        keyed = df.select(F.col(self.key).cast("string").alias("key"))
        return keyed.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int"))

    def _read(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("key string, bucket int, batch long").parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # there is no index before the first batch
                raise
        return None

    def seen(self, batch: DataFrame, number: int) -> DataFrame | None:
        """Keys that other batches brought, of the parts that this batch's keys fall into; no other part is read."""
        if (all_ := self._read()) is None:
            return None
        buckets = [r["bucket"] for r in self.of(batch).select("bucket").distinct().collect()]  # BUCKETS at most
        return all_.where(F.col("bucket").isin(buckets) & (F.col("batch") != number)).select("key")

    def add(self, new: DataFrame, number: int) -> None:
        """Write the keys of a batch; written again after a failure, they take the place of what was there."""
        rows = self.of(new).withColumn("batch", F.lit(number).cast("long")).repartition("bucket")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(self.path)


def ingest(source: DataFrame, target: str, checkpoint: str, key: str = "place_id", on_batch: Callable[[DataFrame, int], None] | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Append each batch's new records to the Parquet table `target` and stop when nothing is left.

    Records whose key is in the table already are passed over; the key's first record of a batch is kept.  Records with a
    null or empty key are all kept, in every batch.  The checkpoint makes a rerun go on after the last complete batch.
    A batch that is run again after a failure finds its own rows by their batch number and writes them anew.  Keys are looked
    up in the index beside the table, of which a batch reads the parts of its own keys only; a table that has no index yet
    gets one from its key column.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        index = KeyIndex(spark, target.rstrip("/") + ".keys", key, buckets)
        if index._read() is None:
            _index_table(spark, target, index)
        keyed = batch.where(filled(key)).withColumn("__at", F.monotonically_increasing_id())
        first = keep_first(keyed, key, "__at").drop("__at")
        if (seen := index.seen(first, number)) is not None:
            first = first.join(seen, F.col(key).cast("string") == F.col("key"), "left_anti").select(batch.columns)
        new = first.unionByName(batch.where(~filled(key)))
        numbered = new.withColumn("batch", F.lit(number)).write.mode("overwrite")
        numbered.option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)
        stored = spark.read.schema(_numbered(batch)).parquet(target).where(F.col("batch") == number)
        index.add(stored.where(filled(key)), number)
        if on_batch:
            on_batch(stored.select(batch.columns), number)

    return source.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _numbered(batch: DataFrame) -> Any:
    return batch.withColumn("batch", F.lit(0)).schema


def _index_table(spark: SparkSession, target: str, index: KeyIndex) -> None:
    try:
        stored = spark.read.parquet(target)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return
    keyed = stored.where(filled(index.key)).select(F.col(index.key).cast("string").alias("key"), F.col("batch").cast("long").alias("batch"))
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(index.buckets)).cast("int"))
    keyed.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(index.path)


def with_callback(df: DataFrame, f: Callable[[dict], Any], error: str = "callback_error") -> DataFrame:
    """df with `error`: f is called with each record, where it lies; what it raises is kept as text and never stops a run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            errors = []
            for record in pdf.to_dict("records"):
                try:
                    f(record)
                    errors.append(None)
                except Exception as e:  # a callback must not end a run
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf.assign(**{error: pd.Series(errors, dtype=object, index=pdf.index)})

    schema = ", ".join([*(f"`{c.name}` {c.dataType.simpleString()}" for c in df.schema), f"`{error}` string"])
    return df.mapInPandas(run, schema)


def counters(outcome: str = "outcome") -> list[Column]:
    """Counters of a run for `DataFrame.observe`: records, and scraped, failed and retried ones by their outcome."""
    return [F.count(F.lit(1)).alias("records"), *[F.count_if(F.col(outcome) == o).alias(o) for o in ("scraped", "failed", "retried")]]


class Progress(StreamingQueryListener):
    """Adds up the observed counters of a stream's batches and tells on_progress of each; what that raises is swallowed.

    Counters come with the batch that is written anyway: nothing is counted by a job of its own.
    """

    def __init__(self, name: str, on_progress: Callable[[dict], Any] | None = None):
        self.name, self.on_progress = name, on_progress
        self.totals: dict[str, int] = {}
        self.batches, self.errors, self.ended = 0, 0, False

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is None:
            return
        self.batches += 1
        for k, v in row.asDict().items():
            self.totals[k] = self.totals.get(k, 0) + (v or 0)
        if self.on_progress:
            try:
                self.on_progress(dict(self.totals))
            except Exception:
                self.errors += 1

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        self.ended = True


def remaining_cells(cells: DataFrame, completed: DataFrame) -> DataFrame:
    """Cells that a resumed grid run still has to visit."""
    return cells.join(completed.select("cell_id").distinct(), "cell_id", "left_anti")
