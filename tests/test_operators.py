import json
import random

import pytest
from pyspark.sql import functions as F

from leadloom.operators import dedup, flatten, geo, rules, stats
from leadloom.operators.rules import FilterConfig
from leadloom.plans.scratch import scratch
from leadloom.sources import dims


def test_first_occurrence_claims_the_id_even_if_it_fails(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, "", "y"), (4, "", "z"), (5, None, "w")], "seq long, place_id string, phone string")
    kept = rules.filter_leads(df, FilterConfig(phone=True)).orderBy("seq")
    assert [r.seq for r in kept.collect()] == [3, 4, 5]


def test_keys_and_status(spark):
    df = spark.createDataFrame([("'n/a",), ("'123",), ("ab",), (None,), ("Presents LLC",)], "v string")
    out = df.select(rules.is_valid_key(F.col("v")).alias("k"), rules.clean_phone(F.col("v")).alias("p"), rules.is_sent(F.col("v")).alias("s")).collect()
    assert [r.k for r in out] == [False, True, False, False, True]
    assert [r.p for r in out] == ["", "123", "", "", "Presents LLC"]
    assert [r.s for r in out] == [False, False, False, False, True]


def greedy(rows):
    phones, urls, kept = set(), set(), []
    for seq, p, u in rows:
        if (p and p in phones) or (u and u in urls):
            continue
        kept.append(seq)
        phones |= {p} - {""}
        urls |= {u} - {""}
    return kept


def test_greedy_dedup_is_not_transitive(spark):
    rows = [(1, "p1", "u1"), (2, "p1", "u2"), (3, "p2", "u2"), (4, "", ""), (5, "", ""), (6, "p2", "u9")]
    df = spark.createDataFrame(rows, "seq long, phone string, url string")
    out = dedup.greedy_dedup(df, ["phone", "url"], scratch(spark))
    assert sorted(r.seq for r in out.collect()) == [1, 3, 4, 5]


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_dedup_equals_a_scan(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice(["", *(f"p{k}" for k in range(40))]), r.choice(["", *(f"u{k}" for k in range(60))])) for i in range(150)]
    df = spark.createDataFrame(rows, "seq long, phone string, url string")
    out = dedup.greedy_dedup(df, ["phone", "url"], scratch(spark))
    assert sorted(x.seq for x in out.collect()) == greedy(rows)


def chain(n):
    """Rows that are linked one to the next by phone and url in turn; the order along the chain is mixed."""
    seqs = random.Random(5).sample(range(n), n)
    return sorted((seq, f"p{k // 2}", f"u{(k + 1) // 2}") for k, seq in enumerate(seqs))


def test_labels_of_a_long_chain_settle(spark):
    rows = sorted((k, f"p{k // 2}", f"u{(k + 1) // 2}") for k in range(400))
    df = spark.createDataFrame(rows, "seq long, phone string, url string")
    assert {r.component for r in dedup._labels(df, ["phone", "url"]).collect()} == {0}


@pytest.mark.parametrize("rows", [chain(300), [(i, "p0" if i % 3 else f"p{i}", f"u{i % 50}" if i % 7 else "") for i in range(300)], [(i, "p0", f"u{i // 2}") for i in range(99)] + [(99, "", ""), (100, "", "u0"), (101, "q", "u49")]])
def test_greedy_rounds_equal_a_scan(spark, rows):
    df = spark.createDataFrame(rows, "seq long, phone string, url string")
    out = dedup.greedy_dedup(df, ["phone", "url"], scratch(spark), scan_rows=2)
    assert sorted(x.seq for x in out.collect()) == greedy(rows)


def clean_scan(rows):
    phones, urls, names, kept = set(), set(), set(), []
    for seq, n, p, u, sent in rows:
        if (u and u in urls) or (p and p in phones) or (not p and not u and n and n in names):
            if sent:
                for i, (place, (_, n2, p2, u2, _)) in enumerate(kept):
                    if (u and u2 == u) or (p and p2 == p) or (n and n2 == n):
                        kept[i] = (place, (seq, n, p, u, sent))
                        break
        else:
            kept.append((seq, (seq, n, p, u, sent)))
            phones |= {p} - {""}
            urls |= {u} - {""}
            names |= {n} - {""}
    return sorted((place, row[0]) for place, row in kept)


@pytest.mark.parametrize("seed", [3, 4])
def test_clean_sheet_equals_a_scan(spark, seed):
    r = random.Random(seed)
    pick = lambda k, n: r.choice(["", *(f"{k}{i}" for i in range(n))])
    rows = [(i, pick("n", 30), pick("p", 30), pick("u", 30), r.random() < 0.4) for i in range(120)]
    df = spark.createDataFrame(rows, "seq long, name string, phone string, url string, sent boolean")
    assert sorted((x.place, x.seq) for x in dedup.clean_sheet(df, scratch(spark)).collect()) == clean_scan(rows)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "seq long, place_id string, phone string, url string, website string")
    assert dedup.greedy_dedup(empty, ["phone", "url"], scratch(spark)).count() == 0
    assert dedup.keep_first(empty, "place_id", "seq").count() == 0
    assert dedup.secondary_duplicates(empty).count() == 0
    assert flatten.prune_empty(empty).columns == []


def test_upsert_overwrites_with_nulls(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, seq long, v string")
    new = spark.createDataFrame([("a", 3, "z"), ("a", 4, None), ("", 5, "q"), ("c", 6, "r")], "id string, seq long, v string")
    assert sorted((r.id, r.v or "-") for r in dedup.upsert(old, new, "id", "seq").collect()) == [("a", "-"), ("b", "y"), ("c", "r")]


def test_grid(spark):
    box = spark.createDataFrame([(1, 25.1, 25.0, 55.1, 55.0)], "id int, north double, south double, east double, west double")
    cells = geo.grid_cells(box, 2.0)
    assert cells.count() == 30 and cells.where("cell_id = 'r0_c0'").first().lat == round(25 + 1 / 111, 6)
    assert geo.subdivide(cells.where("cell_id = 'r0_c0'")).count() == 4
    nothing = geo.classify("auto", F.lit(None).cast("struct<is_populated:boolean,confidence:double,method:string>"), F.lit(None).cast("struct<is_populated:boolean,confidence:double,method:string>"))
    assert tuple(spark.range(1).select(nothing.alias("x")).first().x) == (True, 0.0, "fallback")


def test_country_codes(spark):
    df = spark.createDataFrame([("UAE",), ("uk",), ("Narnia",)], "c string")
    assert [r.code for r in dims.with_country_code(df, "c").collect()] == ["ae", "uk", None]
    assert dims.cities(spark).count() == 54


def test_statistics(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("b", 2.0), ("b", 3.0)], "k string, v double")
    assert sorted(tuple(r) for r in stats.metric_stats(df, ["k"], "v").collect()) == [("a", 2.0, 0.0, 2.0, 2.0), ("b", 2.0, 1.0, 1.0, 3.0)]
    split = stats.stratified_split(spark.range(100).withColumn("k", F.col("id") % 3), "k", "id", 0.1)
    assert {r["count"] for r in split.where("test").groupBy("k").count().collect()} == {3}
    ties = spark.createDataFrame([("a", 5.0, 2), ("a", 5.0, 1), ("a", 4.0, 0)], "k string, s double, i long")
    assert tuple(stats.best(ties, ["k"], "s", "i").first()) == ("a", 5.0, 1)


def test_flatten_and_prune(spark):
    df = spark.sql("select named_struct('b', 1, 'c', named_struct('d', array('x', 'y'))) as a, array() as e, '  ' as f, cast(null as string) as g")
    flat = flatten.flatten_generic(df)
    assert flat.columns == ["a_b", "a_c_d", "e", "f", "g"] and flat.first().a_c_d == "['x', 'y']"
    assert flatten.prune_empty(flat).columns == ["a_b", "a_c_d"]


def test_long_chains_equal_the_scan(spark, tmp_path, monkeypatch):
    """5,000 rows linked by phone and URL in turn, and the same for the sheet."""
    n = 5000
    rows = [(k, f"p{k // 2}", f"u{(k + 1) // 2}") for k in range(n)]
    seen, want = set(), []
    for k, p, u in rows:
        if p not in seen and u not in seen:
            want.append(k)
            seen |= {p, u}
    df = spark.createDataFrame(rows, "seq long, phone string, url string").repartition(4)
    assert sorted(r.seq for r in dedup.greedy_dedup(df, ["phone", "url"], str(tmp_path)).collect()) == want
    monkeypatch.setattr(dedup, "ROUNDS", 2)
    assert sorted(r.seq for r in dedup.greedy_dedup(df, ["phone", "url"], str(tmp_path), scan_rows=100).collect()) == want
    sheet = df.selectExpr("seq", "'' AS name", "phone", "url", "false AS sent")
    assert sorted(r.place for r in dedup.clean_sheet(sheet, str(tmp_path)).collect()) == want


@pytest.mark.parametrize("text", ["1,2,3", "a,b,c,d", "1,2,4,3", "2,1,3,4", "1,0,2,1,5", ""])
def test_bad_bounds_raise(spark, text):
    df = spark.createDataFrame([(text,), (None,)], "t string")
    with pytest.raises(Exception, match="bounds must be"):
        df.select(geo.parse_bounds(F.col("t")).alias("b")).collect()
    assert df.where("t is null").select(geo.parse_bounds(F.col("t")).alias("b")).first().b is None


def test_wide_and_high_grids_are_written_in_bounded_parts(spark):
    boxes = spark.createDataFrame([(1, 1.0, 0.0, 1.0, 0.0), (2, 1.0, 0.0, 1.0, 0.0), (3, 1.0, 0.0, 1.0, 0.0)], "id long, north double, south double, east double, west double")
    shapes = {1: (2, 250), 2: (250, 2), 3: (1, 1)}
    rows = [(i, 0.5, 0.5, 1.0, f"r{r}_c{c}", 14, r, c, False, False, None) for i, (height, width) in shapes.items() for r in range(height) for c in range(width)]
    cells = spark.createDataFrame(rows, "id long, " + "lat double, lng double, radius_km double, cell_id string, zoom int, row int, col int, is_scraped boolean, is_empty boolean, result_count int")
    grids = geo.grid_json(boxes, cells, 2.0, most=100)
    parts = {}
    for r in sorted(grids.collect(), key=lambda r: (r.id, r.part)):
        grid = json.loads(r.grid)
        assert len(grid["cells"]) <= 100 and (grid["rows"], grid["cols"]) == shapes[r.id] and grid["total_cells"] == shapes[r.id][0] * shapes[r.id][1]
        parts.setdefault(r.id, []).append([(c["row"], c["col"]) for c in grid["cells"]])
    assert {i: [c for p in some for c in p] for i, some in parts.items()} == {i: [(r, c) for r in range(h) for c in range(w)] for i, (h, w) in shapes.items()}
    assert {i: len(p) for i, p in parts.items()} == {1: 5, 2: 5, 3: 1}
    assert geo.cells_of_json(grids).count() == cells.count() and geo.grid_json(boxes, cells.limit(0), 2.0).count() == 0


def test_cells_of_few_boxes_are_dealt_to_all_tasks(spark):
    """One large box fills every task, and parts follow the number of cells."""
    box = spark.createDataFrame([(1, 5.0, 1.0, 6.0, 1.0)], "id int, north double, south double, east double, west double").coalesce(1)
    cells = geo.grid_cells(box, 2.0)
    held = cells.groupBy(F.spark_partition_id()).count().collect()
    assert len(held) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(r["count"] for r in held) < 2 * cells.count() / len(held)
    rows, cols = 4.0 * 111 // 2 + 2, 5.0 * 111 * 0.99863 // 2 + 2
    assert geo.cell_parts(box, 2.0, 1000) == rows * cols // 1000 + 1
    wrong = spark.createDataFrame([(1, 1.0, 5.0, 6.0, 1.0), (2, None, 1.0, 6.0, 1.0)], box.schema)
    assert geo.cell_parts(wrong.where("id = 2"), 2.0) == geo.cell_parts(wrong, 2.0) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_marks_are_joined_in_as_many_parts_as_asked_for(spark):
    """Small or well-packed shuffles are not put together into one task; the marks are the same."""
    cells = spark.range(2000).selectExpr("cast(id % 3 as int) AS id", "concat('r', id) AS cell_id", "false AS is_scraped", "id % 5 = 0 AS is_empty", "cast(id as int) AS result_count")
    results = cells.where("result_count % 4 = 0").selectExpr("id", "cell_id", "7 AS result_count")
    checks = cells.where("result_count % 6 = 0").selectExpr("id", "cell_id", "result_count % 12 = 0 AS is_populated")
    checks = checks.union(checks)
    marked = lambda parts: geo.mark_empty(geo.mark_scraped(cells, results, "id", parts=parts), checks, "id", parts=parts)
    assert marked(9).groupBy(F.spark_partition_id()).count().count() == 9
    assert sorted(marked(9).collect()) == sorted(marked(None).collect()) and marked(9).where("is_scraped").count() == 500 + 167
