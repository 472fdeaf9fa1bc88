"""Streams over several batches: the key index, state with a time to live, callbacks and counters."""

import json
import time

from pyspark.sql import Observation
from pyspark.sql import functions as F

from leadloom.streaming import ingest as stream

SCHEMA = "place_id string, name string, at timestamp, outcome string"
BATCHES = [
    [("a", "late", 9, "scraped"), ("a", "early", 1, "failed"), ("", "blank1", 1, "scraped"), (None, "none1", 1, None), ("b", "b1", 5, "scraped")],
    [("a", "again", 0, "scraped"), ("c", "c1", 2, "retried"), ("", "blank2", 1, "scraped"), ("b", "b2", 1, "failed"), (None, "none2", 1, "scraped")],
]


def put(folder, n):
    folder.mkdir(exist_ok=True)
    rows = [{"place_id": k, "name": v, "at": f"2026-01-01T00:00:0{t}", "outcome": o} for k, v, t, o in BATCHES[n]]
    (folder / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))


def test_ingest_reads_only_its_parts_of_the_index(spark, tmp_path):
    source, target, mark = (tmp_path / n for n in ("in", "out", "mark"))
    batches = []
    for n in range(2):
        put(source, n)
        df = stream.read_stream(spark, str(source), SCHEMA)
        stream.ingest(df, str(target), str(mark), on_batch=lambda new, i: batches.append(new.count()), buckets=16).awaitTermination()
    assert sorted(r.name for r in spark.read.parquet(str(target)).collect()) == ["b1", "blank1", "blank2", "c1", "late", "none1", "none2"]
    assert batches == [4, 3]
    index = stream.KeyIndex(spark, str(target) + ".keys", "place_id", 16)
    one = spark.createDataFrame([("a",)], "place_id string")
    assert [r.key for r in index.seen(one, -1).where("key = 'a'").collect()] == ["a"] and index.seen(one, 0).where("key = 'a'").isEmpty()
    bucket = index.of(one).first().bucket
    plan = index.seen(one, -1)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and f"= {bucket})" in plan
    index.add(one, 0)  # a batch that is written again adds nothing
    assert index._read().where("key = 'a'").count() == 1


def test_a_table_without_an_index_gets_one(spark, tmp_path):
    target = str(tmp_path / "old")
    spark.createDataFrame([("a", "x", 7), ("", "y", 7)], "place_id string, name string, batch int").write.partitionBy("batch").parquet(target)
    put(tmp_path / "in", 1)
    df = stream.read_stream(spark, str(tmp_path / "in"), "place_id string, name string")
    stream.ingest(df, target, str(tmp_path / "mark")).awaitTermination()
    assert sorted(r.name for r in spark.read.parquet(target).collect()) == ["b2", "blank2", "c1", "none2", "x", "y"]
    assert sorted(r.key for r in stream.KeyIndex(spark, target + ".keys", "place_id")._read().collect()) == ["a", "b", "c"]


def first_names(spark, tmp_path, ttl_ms, wait=0.0):
    source, out = tmp_path / "in", str(tmp_path / "out")
    for n in range(2):
        put(source, n)
        df = stream.first_records(stream.read_stream(spark, str(source), SCHEMA), "place_id", "at", ttl_ms)
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
        time.sleep(wait)
    return sorted(r.name for r in spark.read.parquet(out).collect())


def test_first_records_over_batches(spark, tmp_path):
    assert first_names(spark, tmp_path, None) == ["b1", "blank1", "blank2", "c1", "early", "none1", "none2"]


def test_keys_are_forgotten_after_their_time(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", False)  # else a run until nothing is left never ends
    names = first_names(spark, tmp_path, 100, 1.0)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert names == ["again", "b1", "b2", "blank1", "blank2", "c1", "early", "none1", "none2"]


def test_callbacks_and_counters(spark, tmp_path):
    def call(record):
        if record["name"].startswith("b"):
            raise ValueError(record["name"])

    told = []

    def tell(totals):
        told.append(totals["records"])
        raise RuntimeError("swallowed")

    put(tmp_path / "in", 0)
    put(tmp_path / "in", 1)
    df = stream.with_callback(stream.read_stream(spark, str(tmp_path / "in"), SCHEMA, files_per_batch=1), call)
    watched = df.observe("run", *stream.counters(), F.count("callback_error").alias("callback_errors"))
    progress = stream.Progress("run", tell)
    spark.streams.addListener(progress)
    try:
        watched.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):
            if progress.ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(progress)
    assert progress.totals == {"records": 10, "scraped": 6, "failed": 2, "retried": 1, "callback_errors": 4}
    assert told == [5, 10] and progress.errors == progress.batches == 2
    assert {r.callback_error for r in spark.read.parquet(str(tmp_path / "out")).where("name = 'b1'").collect()} == {"ValueError: b1"}


def test_counters_of_a_batch_run(spark):
    seen = Observation("batch")
    df = spark.createDataFrame([(o,) for o in ("scraped", "scraped", "failed", None)], "outcome string").observe(seen, *stream.counters())
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"records": 4, "scraped": 2, "failed": 1, "retried": 0}
