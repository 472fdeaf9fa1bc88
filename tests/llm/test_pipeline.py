import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from leadloom.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents after each stage."""
    folder = tmp_path_factory.mktemp("stages")
    out = [table(spark, SF, "documents")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{folder}/{i}")
        out.append(spark.read.parquet(f"{folder}/{i}"))
    return out


def test_stages_keep_columns_and_rows(stages):
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in stages]
    assert all(s.columns == stages[0].columns for s in stages[1:-1]) and all(b <= a for a, b in zip(ids, ids[1:]))
    assert ids[-1] == ids[-2] and 0.5 * len(ids[0]) < len(ids[-1]) < len(ids[0])


def test_dedup_stages_equal_brute_force(stages):
    from test_dedup import classes

    texts = [(r.doc_id, r.text) for r in stages[2].collect()]
    best = {}
    for i, t in texts:
        key = (t or "").lower() if (t or "").isascii() else t
        best[key] = max(i, best.get(key, i))
    assert {r.doc_id for r in stages[3].collect()} == set(best.values())
    left = [(r.doc_id, r.text) for r in stages[3].collect()]
    assert {r.doc_id for r in stages[4].collect()} == set(classes(left).values())


def test_run_gives_the_last_stage(spark, stages):
    columns = sorted(stages[-1].columns)
    assert sorted(map(str, corpus_pipeline.run(spark, SF).select(columns).collect())) == sorted(map(str, stages[-1].select(columns).collect()))
    assert stages[-1].where(F.col("length") > 2048).count() == 0


def test_stages_on_nulls_copies_and_clashing_columns(spark, stages):
    """Each stage on its own rows: null ids and texts, repeated rows, one id with two texts, extra columns, empty tables."""
    good = [r.text for r in stages[-2].orderBy("doc_id").limit(4).collect()]
    loud = "".join(c.upper() if "a" <= c <= "z" else c for c in good[0])
    rows = [(1, good[0]), (1, good[0]), (2, loud), (3, good[1]), (3, good[2]), (None, good[1]), (None, good[3]), (None, good[3]), (4, None), (5, ""), (6, good[3] + " word" * 2), (7, "w " * 200_000)]
    names = "doc_id long, text string, lang string, key string, trusted int, label int, keep_id string, n int, bag binary, __n int"
    df = spark.createDataFrame([(*r, "en", "k", 1, 1, "x", 2, b"", 3) for r in rows], names)
    pairs = lambda d: sorted(((r.doc_id, r.text) for r in d.collect()), key=str)
    by_name = dict(corpus_pipeline.STAGES)
    scored = by_name["quality classifier"](spark, df, SF)
    assert scored.columns == df.columns and {p for p in rows if p[1] in good} <= set(pairs(scored)) <= set(rows)
    ruled = by_name["quality rules"](spark, df, SF)
    assert ruled.columns == df.columns and not {4, 5, 7} & {i for i, _ in pairs(ruled)} and pairs(ruled).count((1, good[0])) == 2
    exact = by_name["exact dedup"](spark, df, SF)
    want = [(2, loud), (3, good[1]), (3, good[2]), (None, good[3]), (None, good[3]), (5, ""), rows[10], rows[11]]
    assert exact.columns == df.columns and pairs(exact) == sorted(want, key=str)
    near = by_name["near dedup"](spark, df, SF)
    assert near.columns == df.columns and {(None, good[3])} < set(pairs(near)) and (2, loud) not in pairs(near) and (1, good[0]) in pairs(near)
    packed = by_name["packing"](spark, df, SF)
    assert packed.where("start = 0").count() == len(rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), SF).count() == 0


def test_large_sets_of_dropped_ids_are_merged(spark, monkeypatch):
    from leadloom.llm import common

    df = spark.createDataFrame([(k, f"text {k // 3} a b c d e f g h") for k in range(60)], "doc_id long, text string")
    a = sorted(corpus_pipeline.exact_dedup(spark, df, SF).collect())
    monkeypatch.setattr(common, "SMALL_IDS", 0)
    assert sorted(corpus_pipeline.exact_dedup(spark, df, SF).collect()) == a and len(a) == 20
    b = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, SF).collect())
    assert b == list(range(0, 60, 3))


def test_filter_stages_equal_the_operators(spark, stages):
    """Filtering in place gives the rows that the operators mark as kept."""
    from leadloom.llm.common import fold
    from leadloom.llm.quality import quality_classifier
    from leadloom.llm.rules import quality_rules, trusted_ids

    labels = table(spark, SF, "labels")
    scores = quality_classifier(stages[0], labels.select("doc_id", F.col("quality").alias("label")), fold("doc_id", 5) != 0)
    assert {r.doc_id for r in scores.where(F.col("score") >= corpus_pipeline.QUALITY).collect()} == {r.doc_id for r in stages[1].collect()}
    assert {r.doc_id for r in quality_rules(stages[1], good=trusted_ids(labels)).where("kept").collect()} == {r.doc_id for r in stages[2].collect()}
