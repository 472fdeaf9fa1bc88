import json

import pytest

from leadloom.plans.leads import leads
from leadloom.operators.rules import query_leads
from leadloom.plans.queries import nested
from leadloom.sources import io
from leadloom.sources.schema import BUSINESS
from leadloom.streaming.ingest import ingest, read_stream, remaining_cells, unique_stream

A = {"business_name": "A", "place_id": "p1", "contact": {"phone": "1"}, "unknown": 1}
B = {"business_name": "B", "place_id": "p2"}


@pytest.mark.parametrize(
    ("content", "names"),
    [
        ("\n".join([json.dumps(A), "", "{bad", json.dumps(B)]), ["A", "B"]),
        (json.dumps([A, B]), ["A", "B"]),
        (json.dumps([A, B], indent=1), ["A", "B"]),
        (json.dumps({"metadata": {}, "businesses": [A, B]}), ["A", "B"]),
        (json.dumps({"metadata": {}, "businesses": [A, B]}, indent=1), ["A", "B"]),
        (json.dumps({"metadata": {"note": "x" * 9000}, "businesses": [A, B]}), ["A", "B"]),
        (json.dumps({"metadata": {"note": "x" * 9000}, "other": [A, B]}, indent=1), []),
        (json.dumps({**B, "note": "businesses"}) + "\n" + json.dumps(A), ["A", "B"]),
        (json.dumps(A, indent=1), ["A"]),
        (json.dumps(A), ["A"]),
        ("", []),
    ],
)
def test_loader(spark, tmp_path, content, names):
    path = tmp_path / "x.json"
    path.write_text(content)
    assert sorted(r.business_name for r in io.read_leads(spark, str(path)).collect()) == names


def test_bad_lines_and_envelope(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text("\n".join([json.dumps(A), "", "{bad", "[1]", json.dumps(B)]))
    assert io.count_bad_lines(spark, str(path)) == 2
    rows = io.read_jsonl(spark, str(path)).where("business_name is not null")
    assert io.write_envelope(rows, str(tmp_path / "out"), "2026-01-01", query="q") == 2
    info, back = io.read_envelope(spark, str(tmp_path / "out"))
    assert info["total_results"] == 2 and info["query"] == "q" and back.count() == 2
    assert io.write_envelope(rows.limit(0), str(tmp_path / "none"), "2026-01-01") == 0 and not (tmp_path / "none").exists()
    assert io.latest_file(spark, str(tmp_path), "*.jsonl").endswith("x.jsonl")


@pytest.mark.parametrize("form", ["lines", "list", "envelope"])
def test_unknown_keys_are_kept_where_asked_for(spark, tmp_path, form):
    rows = [{**A, "contact": {"phone": "1", "fax": "2"}, "deep": {"a": [1]}}, B]
    content = {"lines": "\n".join(map(json.dumps, rows)), "list": json.dumps(rows, indent=1), "envelope": json.dumps({"businesses": rows})}[form]
    (tmp_path / "x.json").write_text(content)
    got = {r.business_name: r._extra for r in io.read_leads(spark, str(tmp_path / "x.json"), extra=True).collect()}
    assert got == {"A": {"unknown": "1", "contact.fax": "2", "deep": '{"a":[1]}'}, "B": {}}


def test_stored_table_and_filtered_export(spark, tmp_path):
    from leadloom.operators.flatten import db_rows

    table = db_rows(nested(leads(spark, "/root/testdata/sf0.001")), source_query="q")
    assert len(table.columns) == 28 and {r.source_query for r in table.select("source_query").collect()} == {"q"}
    io.write_table(table, str(tmp_path / "t"))
    stored = io.read_table(spark, str(tmp_path / "t"))
    n = io.export_jsonl(stored, str(tmp_path / "e"), has_phone=True, min_rating=3.0)
    rows = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "e")).collect()]
    assert 0 < n == len(rows) < stored.count() and all(r["phone"] and r["rating"] >= 3 for r in rows)
    assert all(isinstance(r["all_categories"], list) and isinstance(r["hours"], dict) and r["images"]["all_image_urls"] == [] and r["twitter"] is None for r in rows)


def test_append_jsonl_and_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "n int, t string")
    io.append_jsonl(df, str(tmp_path / "j"))
    io.append_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert [r.value for r in io.export(df).collect()] == ['{"n":1,"t":"a"}']
    assert io.write_flat_csv(nested(leads(spark, "/root/testdata/sf0.001")).limit(3), str(tmp_path / "f"))
    assert json.loads(spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "f")).first()["contact"]) is not None


def test_streams_keep_one_record_of_a_key(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n, rows in enumerate([[A, A, B], [B, {"business_name": "C", "place_id": "p3"}]]):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))
    seen = []
    out = unique_stream(read_stream(spark, str(tmp_path / "in"), files_per_batch=1))
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.business_name for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["A", "B", "C"]
    ingest(read_stream(spark, str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "m2"), on_batch=lambda df, n: seen.append((n, df.count()))).awaitTermination()
    assert seen == [(0, 3)]


def test_query_lists(spark, tmp_path):
    (tmp_path / "q.csv").write_text("query,niche,location\n hotels ,,\n,bars,Rome\n")
    (tmp_path / "q.txt").write_text("# c\n\n cafes in Bonn \n")
    assert [r.query for r in io.read_queries(spark, str(tmp_path / "q.csv")).collect()] == ["hotels", "bars in Rome"]
    assert [r.query for r in io.read_queries(spark, str(tmp_path / "q.txt")).collect()] == ["cafes in Bonn"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([], BUSINESS)
    assert not io.write_flat_csv(rows, str(tmp_path / "a"))
    (tmp_path / "x.jsonl").write_text(json.dumps(A))
    one = io.read_leads(spark, str(tmp_path / "x.jsonl"))
    io.write_filtered(one, str(tmp_path / "s"))
    io.write_exported(one, str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s_filtered.csv")).first()["Business Name"] == "A"
    assert spark.read.option("header", True).csv(str(tmp_path / "s_exported.csv")).columns == ["business_name", "place_id", "contact_phone"]
    stored, saved, skipped = io.import_jsonl(spark, str(tmp_path / "x.jsonl"), one.limit(0).selectExpr("*", "0L as seq"))
    assert (stored.count(), saved, skipped) == (1, 1, 0)
    with pytest.raises(ValueError):
        io.export(one, "xml")
    assert io.output_name("a<b>:c", "1") == "a_b_c_1.json"


def test_incremental_ingest(spark, tmp_path):
    source, target, mark = (tmp_path / n for n in ("in", "out", "mark"))
    source.mkdir()
    (source / "1.json").write_text("\n".join(map(json.dumps, [A, A, B, {"business_name": "C"}])))
    run = lambda: ingest(read_stream(spark, str(source)), str(target), str(mark)).awaitTermination()
    run()
    assert spark.read.parquet(str(target)).count() == 3
    run()  # nothing new
    (source / "2.json").write_text("\n".join(map(json.dumps, [B, {"business_name": "D", "place_id": "p4"}])))
    run()
    assert sorted(r.business_name for r in spark.read.parquet(str(target)).collect()) == ["A", "B", "C", "D"]
    cells = spark.createDataFrame([("a",), ("b",)], "cell_id string")
    assert [r.cell_id for r in remaining_cells(cells, cells.where("cell_id = 'a'")).collect()] == ["b"]


def test_ingest_keeps_records_without_a_key_in_every_batch(spark, tmp_path):
    source, target, mark = (tmp_path / n for n in ("in", "out", "mark"))
    source.mkdir()
    for n in (1, 2):
        blank = [{"business_name": f"{k}{n}", "place_id": v} for k, v in (("E", ""), ("F", ""), ("N", None))]
        (source / f"{n}.json").write_text("\n".join(map(json.dumps, [A, *blank])))
        ingest(read_stream(spark, str(source)), str(target), str(mark)).awaitTermination()
    assert sorted(r.business_name for r in spark.read.parquet(str(target)).collect()) == ["A", "E1", "E2", "F1", "F2", "N1", "N2"]


def test_leads_view(spark):
    df = leads(spark, "/root/testdata/sf0.001")
    assert df.count() == 150 and nested(df).count() == 150
    assert query_leads(df, limit=5, offset=3).count() == 5 and query_leads(df, limit=0).count() == 150


def test_import_takes_the_last_record_in_the_order_of_files(spark, tmp_path):
    """Files are taken by path, lines by place, whatever Spark reads first; bad lines and records without a key are skipped."""
    long = [json.dumps({**A, "place_id": "p", "business_name": f"b{i}"}) for i in range(3000)]
    (tmp_path / "b.jsonl").write_text("\n".join(long))
    (tmp_path / "c.jsonl").write_text("\n".join([json.dumps({**A, "place_id": "p", "business_name": "last"}), "", "{bad", json.dumps({**A, "place_id": ""})]))
    (tmp_path / "a.jsonl").write_text(json.dumps({**A, "place_id": "q", "business_name": "only"}))
    empty = io.read_jsonl(spark, str(tmp_path)).limit(0)
    stored, saved, skipped = io.import_jsonl(spark, str(tmp_path), empty)
    assert (saved, skipped) == (3002, 1) and sorted((r.place_id, r.business_name) for r in stored.collect()) == [("p", "last"), ("q", "only")]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.jsonl").write_text("")
    again, *counts = io.import_jsonl(spark, str(tmp_path / "none"), stored)
    assert counts == [0, 0] and again.count() == 2
