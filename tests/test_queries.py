"""Every registered query with SQL gives the rows that DuckDB gives on the same tables."""

import math

import duckdb
import pandas as pd
import pytest

from leadloom.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def value(v) -> str:
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool) or type(v).__name__.startswith("bool"):
        return str(bool(v))
    return f"{float(v):.9g}" if hasattr(v, "__float__") and not isinstance(v, str) else str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(map(value, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), db.sql(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, name):
    assert len(QUERIES[name](spark, SF).collect()) > 0


def scan_sheet(rows):
    """One row after another: (seq, name, phone, url, sent) -> (place, seq) of the rows that stand in the sheet at last."""
    urls, phones, names, kept = set(), set(), set(), []
    for seq, name, phone, url, sent in rows:
        dup = bool(url and url in urls) or bool(phone and phone in phones) or bool(not phone and not url and name and name in names)
        if not dup:
            kept.append([seq, (seq, name, phone, url)])
            for v, s in ((phone, phones), (url, urls), (name, names)):
                if v:
                    s.add(v)
        elif sent:
            for row in kept:
                _, n, p, u = row[1]
                if (url and u == url) or (phone and p == phone) or (name and n == name):
                    row[1] = (seq, name, phone, url)
                    break
    return sorted((place, row[0]) for place, row in kept)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_clean_sheet_equals_a_scan(spark, sf):
    from leadloom.functions import text, urls
    from leadloom.operators import rules
    from leadloom.plans.leads import leads
    from pyspark.sql import functions as F

    key = lambda c: F.when(rules.is_valid_key(c), text.strip(c)).otherwise("")
    rows = leads(spark, sf).select("seq", key(F.col("business_name")), rules.clean_phone(F.col("phone")), key(urls.normalize_url(F.col("maps_url"))), rules.is_sent(F.col("status"))).orderBy("seq")
    got = sorted((r.place, r.seq) for r in QUERIES["clean_sheet_dedup"](spark, sf).collect())
    assert got == scan_sheet(map(tuple, rows.collect()))


def test_clean_sheet_replaces_rows_as_a_scan_does(spark, tmp_path):
    import random

    from leadloom.operators import dedup

    r, rows = random.Random(6), []
    for k in range(400):
        block = k // 40
        pick = lambda kind, n: r.choice(["", f"{kind}{block}-{r.randrange(n)}"])
        rows.append((k, pick("n", 9), pick("p", 12), pick("u", 12), r.random() < 0.3))
    df = spark.createDataFrame(rows, "seq long, name string, phone string, url string, sent boolean").repartition(3)
    got = sorted((x.place, x.seq) for x in dedup.clean_sheet(df, str(tmp_path)).collect())
    assert got == scan_sheet(rows) and sum(p != s for p, s in got) > 10


def test_emails_in_texts_equal_the_rule(spark):
    """Every address that the query finds is in its text and valid, and every plain valid one is found."""
    import re

    from leadloom.functions.text import BLOCKED_TLDS, JUNK_DOMAINS

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = {r.doc_id: r.emails for r in QUERIES["find_emails_in_texts"](spark, SF).collect()}
    assert set(found) == set(texts)
    for i, t in texts.items():
        plain = [e.lower() for e in re.findall(r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", t)]
        good = [e for e in plain if len(e) <= 254 and e.rsplit(".", 1)[1] not in BLOCKED_TLDS and not any(e.split("@")[1] == j or e.endswith("." + j) for j in JUNK_DOMAINS)]
        assert not good or list(dict.fromkeys(good)) == found[i]
