import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import minhash
from leadloom.llm.components import components
from leadloom.llm.exact_dedup import CuckooFilter, CuckooIndex, exact_dedup, text_digest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_cuckoo_filter_inserts_deletes_and_grows():
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    f = CuckooFilter(16)
    assert all(f.insert(k, n) for n, k in enumerate(keys)) and not f.insert(keys[5])
    assert f.resizes > 0 and [f.numbers[f.slot(k)] for k in keys] == list(range(3000))
    assert all(f.delete(k) for k in keys[::2]) and not f.delete(keys[0])
    assert all((k in f) == (i % 2 == 1) for i, k in enumerate(keys))
    assert all(f.may_contain(k) for k in keys[1::2]) and not all(f.may_contain(k) for k in keys[::2])
    assert f.insert(keys[0]) and keys[0] in f and f.size == 1501
    g = CuckooFilter.load(*f.dump())
    assert g.size == 1501 and sorted(g.items()) == sorted(f.items())


def test_cuckoo_filter_verifies_false_positives():
    """Keys with one fingerprint and one bucket are told apart by their content, and each can be deleted by itself."""
    keys = [b"\x01\x02" + bytes(8) + bytes([k]) * 22 for k in range(1, 8)]
    f = CuckooFilter(16)
    assert all(f.insert(k, k[-1]) for k in keys) and all(f.numbers[f.slot(k)] == k[-1] for k in keys)
    other = b"\x01\x02" + bytes(8) + b"x" * 22
    assert f.may_contain(other) and other not in f and not f.delete(other)
    assert f.delete(keys[3]) and keys[3] not in f and all(k in f for i, k in enumerate(keys) if i != 3)


def test_exact_dedup_cases(spark):
    long = "word " * 50_000
    rows = [(1, "A b"), (2, "a B"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, long), (8, long), (9, long.upper()), (9, "other"), (None, "a b"), (None, "lone")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, keep_id string, group_size int")
    out = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(df).collect()), key=str)
    want = [(1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (6, 6, 1, True), (7, 9, 3, False), (8, 9, 3, False), (9, 9, 3, True), (9, 9, 1, True), (None, None, 1, False)]
    assert out == sorted(want, key=str)
    assert exact_dedup(df).where("doc_id = 1").first().text_sha256 == text_digest("a b").hex()
    assert exact_dedup(df.limit(0)).count() == 0


def test_exact_dedup_of_a_hot_group(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    out = exact_dedup(df)
    assert out.where("kept").count() == 2001 and out.where("keep_id = 2997").count() == 1000


def test_cuckoo_index(spark):
    rows = spark.range(50).select(F.col("id").alias("doc_id"), F.unhex(F.sha2((F.col("id") % 10).cast("string"), 256)).alias("digest"))
    index = CuckooIndex.empty(spark, 4).insert(rows)
    index = index.delete(rows.where("doc_id % 10 = 3")).delete(rows.where("doc_id < 5"))
    live = index.lookup(rows).where("live").select("doc_id").collect()
    assert sorted({r.doc_id % 10 for r in live}) == [0, 1, 2, 4, 5, 6, 7, 8, 9]
    assert index.insert(rows.where("doc_id = 3")).lookup(rows).where("live").count() == 50


def test_cuckoo_index_cases(spark, monkeypatch):
    from leadloom.llm import exact_dedup as module

    monkeypatch.setattr(module, "SHARD_ROWS", 20)
    digest = F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest")
    rows = spark.range(100).select(F.col("id").alias("doc_id"), digest)
    null = spark.sql("select 7L as doc_id, cast(null as binary) as digest")
    empty = CuckooIndex.empty(spark, 2)
    assert empty.lookup(rows).where("live").count() == 0 and empty.delete(rows).lookup(rows).where("live").count() == 0
    index = empty.insert(rows.union(null).union(rows.limit(0)))
    assert index.shards > 2  # dealt anew
    assert index.lookup(rows.union(null)).where("live").count() == 100 and index.lookup(null).count() == 1
    index = index.insert(rows.where("doc_id < 10")).delete(rows.where("doc_id < 20")).delete(rows.where("doc_id < 5"))
    assert sorted(r.doc_id for r in index.lookup(rows).where("not live").collect()) == [0, 1, 2, 3, 4, *range(10, 20)]
    assert index.lookup(rows.limit(0)).count() == 0


def bag(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))


def jaccard(a, b):
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys)


def classes(texts):
    bags, root = {i: bag(t) for i, t in texts}, {i: i for i, _ in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(bags)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if jaccard(bags[a], bags[b]) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def edited(r, words, n):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"new{r.random()}"
    return " ".join(out)


def test_near_dedup_equals_brute_force(spark):
    r = random.Random(5)
    texts, n = [], 0
    for size, length in [(40, 150), (25, 80), (6, 60), (3, 30), (2, 12)]:
        words = [f"w{r.randrange(400)}" for _ in range(length)]
        for k in range(size):
            texts.append((n := n + 1, edited(r, words, r.randrange(0, max(1, length // 40))) if k else " ".join(words)))
    texts += [(n + k, " ".join(f"x{r.randrange(900)}" for _ in range(70))) for k in range(1, 30)]
    n += 30
    texts += [(n + 1, None), (n + 2, ""), (n + 3, "a b"), (n + 4, "A  B"), (n + 5, "b a"), (n + 6, "o " * 3000), (n + 7, "o " * 2500)]
    df = spark.createDataFrame([(*t, "k") for t in texts], "doc_id long, text string, key string").repartition(3)
    out = {r.doc_id: r.class_id for r in minhash.near_dedup(df).collect()}
    assert out == classes(texts)


def spread(seed, size=150, length=120):
    """Copies of one text with so many edits that their similarities spread around 0.8, and versions that share edits."""
    r = random.Random(seed)
    base = [f"w{k}" for k in range(length)]
    versions = [base, edited(r, base, 5).split(), edited(r, base, 6).split(), edited(r, base, 9).split()]
    return [edited(r, r.choice(versions), r.choice([0, 1, 2, 3, 4, 6])) for _ in range(size)]


@pytest.mark.parametrize("rounds", [0, 6])
def test_near_dedup_completes_large_buckets(spark, monkeypatch, rounds):
    monkeypatch.setattr(minhash, "ROUNDS", rounds)
    opened, real = [], minhash._rest
    monkeypatch.setattr(minhash, "_rest", lambda rows: opened.append(rows.where("out").count()) or real(rows))
    texts = list(enumerate(spread(3) + spread(4) + [" ".join(thue) + " c d e f" for thue in zip(*[iter(twins(1024))] * 1)]))
    out = {r.doc_id: r.class_id for r in minhash.near_dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    want = classes(texts)
    assert len(set(want.values())) > 20 and opened
    assert out == want


def twins(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return [s, s.translate(str.maketrans("ab", "ba"))]


def test_bounds_of_large_buckets_hold(spark):
    """No pair that is a link is ruled out by e and cap, whatever the leader."""
    texts = list(enumerate(spread(7, 60)))
    bags = spark.createDataFrame([(i, minhash._multisets([t], _Batch())["bag"][0].as_py()) for i, t in texts], "doc_id long, bag binary")
    counts = dict((i, bag(t)) for i, t in texts)
    for leader in (0, 17, 42):
        ends = spark.createDataFrame([(leader, i) for i, _ in texts if i != leader], "leader long, doc_id long")
        found = {r.doc_id: (r.e, r.cap) for r in minhash.caps(minhash.differences(ends, bags)).collect()}
        assert len(found) == len(texts) - 1
        for a in found:
            for b in found:
                if a < b and jaccard(counts[a], counts[b]) >= 0.8:
                    assert found[a][0] <= found[b][1] and found[b][0] <= found[a][1]


class _Batch:
    def column(self, name):
        return None


def test_near_dedup_cases(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "A b c"), (None, "a b c")], "doc_id long, text string")
    out = sorted(((r.doc_id, r.class_id, r.kept) for r in minhash.near_dedup(df).collect()), key=str)
    assert out == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True)], key=str)
    assert minhash.near_dedup(df.limit(0)).count() == 0
    long = " ".join(f"w{k * 7919 % 5003}" for k in range(200_000))
    df = spark.createDataFrame([(1, long, "x"), (2, long + " end", "x"), (3, long[: len(long) // 2], "x"), (4, "", "x"), (5, None, "x")], "doc_id long, text string, bands string")
    assert sorted((r.doc_id, r.class_id) for r in minhash.near_dedup(df).collect()) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 4)]


@pytest.mark.parametrize("weights", [(3, 5), (1, 40), (7, 7)])
def test_signatures_are_unbiased(weights):
    """Agreement of components over many element sets: the similarity of {x: w1} plus common and {x: w2} plus common."""
    a, b = weights
    n, agree = 60, []
    for k in range(n):
        h = np.array([k * 7 + 1, k * 7 + 2], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        text, keys = np.array([0, 0, 1, 1]), np.concatenate([h, h])
        s = minhash.signatures(text, keys, np.array([a, 4, b, 4]), 2)
        agree.append((s[0] == s[1]).mean())
    want = (min(a, b) + 4) / (max(a, b) + 4)
    assert abs(np.mean(agree) - want) < 4 * np.sqrt(want * (1 - want) / (n * minhash.COMPONENTS)) + 1e-9


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {x: find(x) for x in list(root) if find(x) != x}
