"""Snapshots that are compared, their history, and scores of leads."""

import pytest
from pyspark.sql import functions as F

from leadloom.operators import changes, score

COLUMNS = "id string, a string, b int, tags array<string>"
OLD = [("1", "x", 1, ["t"]), ("2", "x", None, None), ("3", "y", 3, []), ("4", "", 4, None), ("", "blank", 0, None), (None, "blank", 0, None)]
NEW = [("1", "x", 1, ["t"]), ("2", None, 2, None), ("4", None, 4, []), ("5", "z", 5, None), ("", "other", 0, None)]
FIELDS = ["a", "b", "tags"]


def test_field_changes(spark):
    old, new = (changes.version(spark.createDataFrame(r, COLUMNS), "id", FIELDS) for r in (OLD, NEW))
    got = {tuple(r) for r in changes.field_changes(old, new, "id", FIELDS).collect()}
    assert got == {("2", "changed", "a", "x", None), ("2", "changed", "b", None, "2"), ("3", "removed", None, None, None), ("4", "changed", "a", "", None), ("4", "changed", "tags", None, "[]"), ("5", "added", None, None, None)}
    same = changes.field_changes(old, old, "id", FIELDS)
    assert same.collect() == [] and changes.field_changes(old.limit(0), old.limit(0), "id", FIELDS).collect() == []
    assert {(r.change, r.field): r.records for r in changes.change_summary(changes.field_changes(old, new, "id", FIELDS)).collect()}["changed", "a"] == 2


def test_last_row_of_a_repeated_key(spark):
    df = spark.createDataFrame([("1", 1, "x"), ("1", 2, "y"), ("1", 2, "y")], "id string, n long, a string")
    assert [(r.id, r.a) for r in changes.version(df, "id", ["a"], order="n").collect()] == [("1", "y")]


def test_stored_history(spark, tmp_path):
    history = changes.History(spark, str(tmp_path / "h"), "id", FIELDS)
    at = lambda n: F.timestamp_seconds(F.lit(n * 100))
    snaps = [OLD, NEW, NEW, OLD]
    for n, rows in enumerate(snaps):
        assert history.add(spark.createDataFrame(rows, COLUMNS), at(n)) == n + 1
    seconds = lambda c: F.unix_seconds(c).alias(c)
    rows = {(r.id, r.a, r.valid_from, r.valid_to) for r in history.table().select("id", "a", seconds("valid_from"), seconds("valid_to")).collect()}
    assert rows == {
        ("1", "x", 0, None), ("2", "x", 0, 100), ("2", None, 100, 300), ("2", "x", 300, None), ("3", "y", 0, 100), ("3", "y", 300, None),
        ("4", "", 0, 100), ("4", None, 100, 300), ("4", "", 300, None), ("5", "z", 100, 300),
    }
    assert {r.id for r in history.as_of(at(2)).collect()} == {"1", "2", "4", "5"} and history.last_version() == 4
    # a version that failed before its number was written is written again
    (tmp_path / "h" / "closed" / "version=5").mkdir()
    history.add(spark.createDataFrame(NEW, COLUMNS), at(9))
    assert {r.id for r in history.open().collect()} == {"1", "2", "4", "5"}


def lead(**of):
    base = dict.fromkeys(["place_id", "email", "phone", "website", "category", *score.SOCIALS]) | {"average_rating": None, "total_reviews": None}
    return base | of


def test_scores(spark):
    rows = [lead(), lead(place_id="p", email="a", phone="1", website="w", category="Café", average_rating=4.0, total_reviews=50, tiktok="t"), lead(email="  ", phone="1", website="", average_rating=5.5, total_reviews=0), lead(email="a", phone="1", category="Bar", average_rating=3.9, total_reviews=49)]
    schema = ", ".join(f"{c} {'double' if c == 'average_rating' else 'int' if c == 'total_reviews' else 'string'}" for c in rows[0])
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    got = score.score_leads(df, categories=["café"]).collect()
    assert [(r.score, r.score_grade) for r in got] == [(0.0, "D"), (100.0, "A"), (35.0, "D"), (45.0, "C")]
    assert [x.signal for x in got[1].score_reasons] == list(score.WEIGHTS) and [tuple(x) for x in got[3].score_reasons] == [("email", 25.0), ("phone", 20.0)]
    assert [r.flags for r in got] == [["no_email", "no_phone", "no_website", "no_place_id"], [], ["no_email", "no_website", "rating_out_of_range", "rated_without_reviews", "no_place_id"], ["no_website", "no_place_id"]]
    assert [r.score for r in score.score_leads(df, {"email": 1, "phone": 2}).collect()] == [0.0, 100.0, 66.67, 100.0]
    assert {r.flag: r.leads for r in score.flag_counts(score.score_leads(df)).collect()}["no_website"] == 3
    for bad in ({"fax": 1}, {"email": -1}, {"email": 0}):
        with pytest.raises(ValueError):
            score.score_leads(df, bad)
