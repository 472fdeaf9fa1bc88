"""Exact ranks and running values over range partitions, what is built on them, and trees of run reports."""

import json
import random

import pytest
from pyspark.sql import functions as F
from test_operators import clean_scan

from leadloom.operators import dedup, ordered, stats
from leadloom.plans.scratch import scratch
from leadloom.sources import io


@pytest.fixture(autouse=True)
def checkpoints(spark):
    spark.sparkContext.setCheckpointDir(scratch(spark))


ROWS = [(random.Random(i).choice("abbbbbbbbbc"), i, random.Random(i + 9000).random() < 0.02) for i in range(3000)]


@pytest.mark.parametrize("descending", [False, True])
def test_running_values_of_a_large_group(spark, descending):
    df = spark.createDataFrame(ROWS, "k string, o long, m boolean").repartition(5)
    want = []
    for k in "abc":
        last, since = None, 0
        for n, (_, o, m) in enumerate(sorted([x for x in ROWS if x[0] == k], key=lambda x: -x[1] if descending else x[1])):
            want.append((k, o, m, n + 1, last, since))
            last, since = (o, 0) if m else (last, since + 1)
    got = [tuple(r) for r in ordered.running(df, "k", "o", "m", descending).collect()]
    assert sorted(got) == sorted(want)
    assert ordered.running(df.limit(0), "k", "o", "m").collect() == []


def test_exact_ranks(spark):
    df = spark.createDataFrame(ROWS, "k string, o long, m boolean").repartition(7)
    assert sorted((r["rank"], r.o) for r in ordered.ranked(df, "k", "o").collect()) == list(enumerate(o for _, o, _ in sorted(ROWS)))


def test_preview_split_and_streak(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 4 != 0).alias("is_populated"), F.when(F.col("id") % 10 != 0, "x").alias("k"), (F.col("id") % 7 == 0).cast("int").alias("new")).repartition(6)
    assert tuple(stats.preview(df, "id", 30).first()) == (30, 8, 266) and tuple(stats.preview(df.limit(0), "id", 30).first()) == (0, 0, 0)  # ids 0, 33, 66 ...
    split = stats.stratified_split(df, "k", "id", 0.25)
    assert {r.k: r.n for r in split.where("test").groupBy("k").agg(F.count("*").alias("n")).collect()} == {None: 25, "x": 225} and split.count() == 1000
    stop = lambda limit: {r.k: r.stop_at for r in stats.streak_stop(df, "k", "id", "new", limit).collect()}
    rows = df.orderBy("id").collect()
    for limit in (3, 6, 50):
        want = {}
        for k in (None, "x"):
            n = 0
            for r in (r for r in rows if r.k == k):
                n = 0 if r.new else n + 1
                if n >= limit and k not in want:
                    want[k] = r.id
            want.setdefault(k, None)
        assert stop(limit) == want


def test_sheet_places_settle_in_rounds(spark):
    r = random.Random(0)
    pick = lambda k: r.choice(["", *(f"{k}{i}" for i in range(60))])
    rows = [(i, pick("n"), pick("p"), pick("u"), r.random() < 0.5) for i in range(60)]
    df = spark.createDataFrame(rows, "seq long, name string, phone string, url string, sent boolean")
    assert sorted((x.place, x.seq) for x in dedup.clean_sheet(df, scratch(spark), scan_rows=20).collect()) == clean_scan(rows)


def test_sheet_of_one_long_chain_of_replacements(spark):
    """One phone in all rows, each sent again: the place's history is a chain over all of them."""
    rows = [(i, "n", "hot", f"u{i}", i % 3 > 0) for i in range(400)] + [(400 + i, "", "", "", True) for i in range(3)]
    df = spark.createDataFrame(rows, "seq long, name string, phone string, url string, sent boolean")
    assert sorted((x.place, x.seq) for x in dedup.clean_sheet(df, scratch(spark), scan_rows=20).collect()) == clean_scan(rows)


def test_run_tree(spark, tmp_path):
    def put(path, content):
        file = tmp_path / "runs" / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(content if isinstance(content, str) else json.dumps(content, indent=1))

    put("eval-1/with/run-1/grading.json", {"summary": {"pass_rate": 0.5, "passed": 1, "failed": 1, "total": 2}, "expectations": [{"text": "t", "passed": True, "evidence": "e"}, {"text": "u"}], "execution_metrics": {"output_chars": 9}})
    put("eval-1/with/run-1/timing.json", {"total_duration_seconds": 4.0, "total_tokens": 70})
    put("eval-1/without/run-2/grading.json", "{broken")
    put("eval-1/with/notes.json", {})
    put("eval-a/eval_metadata.json", {"eval_id": 17})
    put("eval-a/with/run-3/grading.json", {"timing": {"total_duration_seconds": 2.5}})
    put("eval-b/eval_metadata.json", "no json")
    put("eval-b/with/run-3/grading.json", {})
    put("eval-c/with/run-4/grading.json", {})
    put("eval-12-menu/with/run-5/grading.json", {})
    got = {r.run_number if r.run_number != 3 else (3, r.eval_id): r for r in io.read_runs(spark, str(tmp_path)).collect()}
    assert set(got) == {1, (3, 17), (3, 3), 4, 5} and (got[1].eval_id, got[4].eval_id, got[5].eval_id) == (1, 4, 12)
    one = got[1]
    assert (one.pass_rate, one.time_seconds, one.tokens, one.config) == (0.5, 4.0, 70, "with") and [(e.text, e.passed) for e in one.expectations] == [("t", True), ("u", None)]
    assert got[3, 17].time_seconds == 2.5 and got[3, 3].expectations == []
