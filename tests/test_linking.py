"""Duplicates across queries, merged records and their report."""

import random

import pytest
from pyspark.sql import functions as F

from leadloom.operators import linking, skew
from leadloom.plans.scratch import scratch


def brute(rows):
    """rows (seq, *keys) -> {seq: least seq of its component}"""
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    first = {}
    for seq, *keys in rows:
        for i, k in enumerate(keys):
            if k:
                a, b = find(seq), find(first.setdefault((i, k), seq))
                parent[max(a, b)] = min(a, b)
    return {r[0]: find(r[0]) for r in rows}


CHAIN = [(s, f"p{k // 2}", f"u{(k + 1) // 2}") for k, s in enumerate(random.Random(2).sample(range(1500), 1500))]
STAR = [(k, "hot" if k % 3 == 0 else f"p{k}", f"u{k // 2}" if k % 5 == 0 else "") for k in range(1500)]
ODD = [(1, None, None), (2, "", ""), (3, "a", None), (4, "a", ""), (5, "", "a"), (6, "b", "a")]


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("rows", [CHAIN, STAR, ODD])
def test_components_of_rows(spark, rows, hot, monkeypatch):
    if hot:  # small tables take the path of large ones, with hot keys broadcast
        monkeypatch.setattr(skew, "ROWS", 0)
        monkeypatch.setattr(skew, "SHARE", 20)
    df = spark.createDataFrame(rows, "seq long, phone string, url string")
    got = linking.link(df, ["phone", "url"], scratch(spark)).collect()
    assert {r.seq: r.component for r in got} == brute(rows) and len(got) == len(rows)


def test_unique_join_keeps_rows_without_a_key(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS", 0)
    left = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "i long, k string")
    right = spark.createDataFrame([("a", 7)], "k string, v long")
    rows = lambda how: sorted(tuple(r) for r in skew.unique_join(left, right, "k", how).select("i").collect())
    assert rows("inner") == rows("left_semi") == [(1,), (2,)] and rows("left") == [(1,), (2,), (3,), (4,)] and rows("left_anti") == [(3,), (4,)]


def test_merged_record(spark):
    rows = [
        (1, "web", 10, "Acme", "", None, 3.5, "x"), (2, "maps", 30, "Acme Trading", "111", "a@x", None, "x"), (3, "maps", 20, "Acme T.", "222", "b@x", 4.5, "x"), (4, "list", 40, " ", "333", None, 4.0, "x"),
        (5, None, None, None, None, None, None, "y"),
    ]
    df = spark.createDataFrame(rows, "seq long, source string, at long, name string, phone string, email string, rating double, url string")
    fields = {"name": "longest", "phone": "priority", "email": "latest", "rating": "greatest"}
    out = {r.component: r for r in linking.cross_query_dedup(df, ["url"], fields, "source", ["web", "maps"], "at", scratch(spark)).collect()}
    a, b = out[1], out[5]
    assert (a.rows, a.sources, a.name, a.name_seq, a.phone, a.phone_seq, a.email, a.rating, a.rating_seq) == (4, 3, "Acme Trading", 2, "111", 2, "a@x", 4.5, 3)
    assert (b.rows, b.sources, b.name, b.phone_seq, b.rating) == (1, 0, None, None, None)
    least = linking.merge_linked(df.withColumn("component", F.lit(0)), {"rating": "least"}, "source", [], "at").first()
    assert (least.rating, least.rating_seq) == (3.5, 1)
    with pytest.raises(ValueError):
        linking.merge_linked(df.withColumn("component", F.lit(0)), {"rating": "best"}, "source", [], "at")


def test_report_of_a_large_cluster(spark):
    df = spark.range(3000).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "hot").otherwise("").alias("phone"), F.concat(F.lit("u"), (F.col("id") / 2).cast("int")).alias("url"), (F.col("id") % 4).cast("string").alias("source"))
    linked = linking.link(df, ["phone", "url"], scratch(spark))
    out = {r.component: r for r in linking.duplicate_report(linked, ["phone", "url"], "source").collect()}
    big = out[0]
    assert (big.rows, big.phone_values, big.phone_top, big.phone_top_rows, big.phone_rows, big.sources) == (2000, 1, "hot", 1000, 1000, 4)
    assert (big.url_shared, big.url_rows, big.url_top, big.url_top_rows) == (1000, 2000, "u0", 2)
    assert len(out) == 501 and linking.duplicate_report(linked.limit(0), ["phone"], "source").collect() == []
