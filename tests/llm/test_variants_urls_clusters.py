"""Spelling variants, URL filters and centroid clustering against brute force, with odd rows of every kind."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import spelling, url_filters, vafile

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, word string, n long"


# --- spelling variants ------------------------------------------------------------------------------------------------


def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(docs) -> Counter:
    out = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            out[run] += 1
    return Counter({w: n for w, n in out.items() if len(w) >= 7 and n >= 2})


def brute_variants(docs) -> set:
    words = brute_words(docs)
    deleted: dict[str, set[str]] = {}
    for w in words:  # words one edit apart share w or w less one code point
        for form in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            deleted.setdefault(form, set()).add(w)
    of = {w: set() for w in words}
    for group in deleted.values():
        for a in group:
            of[a] |= {b for b in group if near(a, b)}
    form = {}
    for w, others in of.items():
        best = min(others, key=lambda x: (-words[x], x.encode()), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(of[w]), words[form[w]] if form[w] else None))
    return out


def found_variants(df) -> set:
    rows = [tuple(r) for r in spelling.spelling_variants(df).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_variants_of_a_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found_variants(docs) == brute_variants([(r.doc_id, r.text) for r in docs.collect()])


def test_variants_of_odd_rows(spark):
    chain = " ".join(["chainede"] * 300 + ["chainedf"] * 24 + ["chainxdf"] * 2 + ["chaixxdf"] * 2)
    rows = [
        (1, None, "x", 1), (2, "", None, 2), (None, "Repeated repeated réPeated Öffnungen öffnungen ÖFFNUNGEN", "a", 3), (None, None, None, None),
        (4, chain, "", 0), (4, chain, "", 0), (5, "aaaaaaaa aaaaaaaaa aaaaaaa aaaaaaab baaaaaaa " * 3, "", 0),
        (6, ("x" * 40_000 + " ") * 2 + ("x" * 20_000 + "y" + "x" * 19_999 + " ") * 2, "", 0), (7, "seven77letters abcdef abcdefg abcdefgh×÷ß " * 4, "", 0),
    ]
    docs = spark.createDataFrame([(i, t, w, n) for i, t, w, n in rows], DOCS)
    words = found_variants(docs)
    assert {r for r in words if len(r[0]) < 1000} == {r for r in brute_variants([(i, t) for i, t, _, _ in rows if i != 6])}
    long_ = {r for r in words if len(r[0]) >= 1000}
    assert all(r[4] == 1 and r[3] == 2 for r in long_) and len(long_) == 2
    assert found_variants(docs.limit(0)) == set()


def test_chain_of_forms(spark):
    words = [("aaaaaaaa", 20000), ("aaaaaaab", 2000), ("aaaaaabb", 200), ("aaaaabbb", 20), ("aaaabbbb", 2)]
    forms = spark.createDataFrame([(a, b) for (a, _), (b, _) in zip(words[1:], words)], "word string, form string")
    assert {tuple(r) for r in spelling.roots(forms).collect()} == {(w, "aaaaaaaa") for w, _ in words[1:]}


def test_small_shards_and_shared_halves(spark):
    """Words that nearly all share a half, over many shards: the heavy half is dealt out by word."""
    r = random.Random(7)
    words = {"sharedpre" + "".join(r.choice("abc") for _ in range(r.choice([5, 6]))) for _ in range(600)} | {"".join(r.choice("ab") for _ in range(9)) for _ in range(300)}
    counts = {w: r.randint(2, 400) for w in words}
    got = {x.word: (x.n_near, x.best.word if x.best else None) for x in spelling.near_words(spark.createDataFrame(list(counts.items()), "word string, n long"), shard_words=40).collect()}
    assert len(got) == len(words)
    for w in words:
        others = [x for x in words if near(w, x)]
        assert got[w] == (len(others), min(others, key=lambda x: (-counts[x], x), default=None)), w


def test_search_finds_edits_beyond_the_exact_end():
    r = random.Random(3)
    words = sorted({"".join(r.choice("abé") for _ in range(r.randint(7, 11))) for _ in range(1500)})
    index = spelling.Index(words)
    queries = words[:200]
    exact = np.array([len(q) - len(q) // 2 for q in queries])
    got = {(queries[q], words[w]) for q, w in zip(*(x.tolist() for x in spelling.search(index, queries, exact)))}
    want = {(q, w) for q, e in zip(queries, exact) for w in words if near(q, w) and w.endswith(q[len(q) - e :]) and near(q[: len(q) - e], w[: len(w) - e])}
    assert got == want


# --- url filters --------------------------------------------------------------------------------------------------------


def brute_verdicts(pages, extra=()) -> list:
    def cut(url):
        if not url or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        return host.translate(url_filters.LOWER and str.maketrans(url_filters.UPPER, url_filters.LOWER)), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]

    def rule(url):
        host, path = cut(url)
        fits = [(h + p, v) for h, p, v in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits, key=lambda x: len(x[0]), default=(None, None))

    key = lambda u: u.split("#")[0]
    links = [(u, to) for _, u, h in pages if u for to in url_filters.links_of(h or "", u)] + list(extra)
    bad = {key(u) for pair in links for u in pair if rule(u)[1] == "block"}
    while more := {key(y) for a, b in links for x, y in ((a, b), (b, a)) if key(x) in bad} - bad:
        bad |= more
    return sorted([(i, *cut(u), rule(u)[0], rule(u)[1] or ("block" if u and key(u) in bad else "allow")) for i, u, _ in pages], key=str)


def test_url_filters_follow_links(spark):
    canonical = lambda u: f'<html><head><LINK href="{u}" rel="canonical"></head>'
    pages = [
        (1, "https://a.example.com/de/1", None), (2, "http://b.example.net/x", canonical("https://a.example.com/de/1#part")), (3, "http://c.example.net/y?q=1", canonical("http://b.example.net/x")),
        (4, "http://d.example.org/ok", canonical("http://b.example.net/x")), (5, "http://e.example.net/z", "<meta http-equiv='Refresh' content='0; URL=http://d.example.org/ok'>"),
        (6, "http://f.example.net/free", "<!-- " + canonical("http://b.example.net/x") + " -->"), (7, "http://g.example.net/s", "<script>'" + canonical("http://b.example.net/x") + "'</script>"),
        (8, None, canonical("http://b.example.net/x")), (9, "", ""), (10, "no-scheme/de/", canonical("/de/")), (11, "HTTP://WWW.Example.ORG/es/a?x=//b#c", None), (12, "https://example.org/en/12", None),
        (13, "https://notexample.org/es/1", None), (14, "https://example.org", None), (15, "http://x.com?/de/", None), (16, "http://h.example.net/dir/page", canonical("../dir/other")), (17, "http://h.example.net/dir/other", None),
        (None, "http://b.example.net/x", None), (2, "http://b.example.net/x", None), (18, "http://[::1/x", canonical("//[")), (19, "http://i.example.net/" + "a" * 100_000, "x" * 2_000_000 + canonical("http://b.example.net/x")),
        (20, "a://b://c/de/", None), (21, "http://j.com/fr/ü", None), (22, "http://k.com/fr/", canonical("http://j.com/de/")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("verdict", F.lit(1))
    got = sorted([tuple(r) for r in url_filters.url_filters(df).collect()], key=str)
    assert got == brute_verdicts(pages)
    by = {r[0]: r[4] for r in got}
    assert [by[i] for i in (2, 3, 4, 5, 6, 7, 19, 22)] == ["block", "block", "allow", "block", "allow", "allow", "block", "allow"]
    extra = [("http://f.example.net/free", "http://e.example.net/z"), (None, "http://q/"), ("http://q/", None)]
    more = url_filters.url_filters(df, redirects=spark.createDataFrame(extra, "from_url string, to_url string")).collect()
    assert {r.page_id: r.verdict for r in more}[6] == "block"
    assert url_filters.url_filters(df.limit(0)).collect() == []


def test_many_rules_are_refused(spark):
    with pytest.raises(ValueError):
        url_filters.fitting_rule(F.lit("a"), F.lit("b"), [("a", "/", "allow")] * 1001)


# --- centroid clustering --------------------------------------------------------------------------------------------------


def brute_clusters(vectors, k=8, rounds=10) -> list:
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    kept.sort(key=lambda r: ("~" if r[0] is None else hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    x = np.array([v for _, v in kept], object)
    c = [list(v) for _, v in kept[:k]]

    def assign():
        d = np.stack([((x - np.array(m, object)) ** 2).sum(1) for m in c], 1)
        return [min(range(len(c)), key=lambda j: (row[j], j)) for row in d], d

    for _ in range(rounds):
        at, _ = assign()
        for j in range(len(c)):
            own = [v for v, a in zip(x, at) if a == j]
            if own:
                c[j] = [s // len(own) for s in np.sum(own, 0)]
    at, d = assign()
    own = [int(row[a]) for row, a in zip(d, at)]
    inertia = [sum(o for o, a in zip(own, at) if a == j) for j in range(len(c))]
    return sorted([(i, a, o, inertia[a], sum(own), hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest()) for (i, _), a, o in zip(kept, at, own)], key=str)


def found_clusters(df, **how) -> list:
    return sorted([tuple(r) for r in vafile.centroid_clustering(df, **how).collect()], key=str)


@pytest.mark.parametrize("bits", [2, 6])
def test_clusters_of_a_whole_table(spark, bits):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert found_clusters(df, bits=bits) == brute_clusters([(r.vec_id, r.embedding) for r in df.collect()])


def test_clusters_of_odd_rows(spark):
    r = random.Random(1)
    rows = [(i, [r.gauss(i % 3 * 4, 0.3) for _ in range(64)]) for i in range(60)]
    rows += [rows[3], rows[3], (None, rows[4][1]), (None, [0.5] * 64), (70, None), (71, []), (72, [1.0] * 63), (73, [1.0] * 65), (74, [float("nan")] + [0.0] * 63), (75, [float("inf")] * 64), (76, [None] + [0.0] * 63), (77, [-0.0001] * 64), (77, [0.0] * 64), (78, [100.0] * 64)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string")
    assert found_clusters(df) == brute_clusters(rows)
    few = df.where("vec_id in (77, 78)")
    assert found_clusters(few) == brute_clusters([x for x in rows if x[0] in (77, 78)])
    same = spark.createDataFrame([(i, [1.0] * 64) for i in range(30)], "vec_id long, embedding array<float>")
    assert found_clusters(same) == brute_clusters([(i, [1.0] * 64) for i in range(30)])
    assert found_clusters(df.limit(0)) == []
    huge = spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64), (3, [0.0] * 64)], "vec_id long, embedding array<double>")
    assert {x[2] for x in found_clusters(huge)} == {0}


def test_candidates_hold_the_nearest_centroid_and_few_others():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 3000, (8, 64))
    x = np.floor(centres[rng.integers(0, 8, 2000)] + rng.normal(0, 150, (2000, 64))).astype(np.int64)
    cells = vafile.Cells(x.mean(0), x.std(0), x.min(0), x.max(0), 4)
    bounds = vafile.Bounds(cells, np.floor(centres).astype(np.int64))
    may = bounds.candidates(cells.of(x))
    d = vafile.distances(x, bounds.centroids)
    assert may[np.arange(len(x)), d.argmin(1)].all()
    assert (may.sum(1) == 1).mean() > 0.99  # clusters that lie apart need no vector at all
    assert (bounds.nearest(x, may)[0] == d.argmin(1)).all() and (bounds.nearest(x, may)[1] == d.min(1)).all()
