import collections
import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from leadloom.llm import kneser_ney, quality, rules, toxicity
from leadloom.llm.common import fold, table

SF = "/root/testdata/sf0.01"


def held(i, n, r):
    return zlib.crc32(str(i).encode()) % n == r


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_isotonic_is_the_pooled_mean():
    y, w = np.array([0.0, 1.0, 0.0, 1.0, 0.5]), np.array([1.0, 1.0, 3.0, 1.0, 1.0])
    assert np.allclose(quality.isotonic(y, w), [0, 0.25, 0.25, 0.75, 0.75])


def test_quality_on_held_out_documents(spark):
    labels = table(spark, SF, "labels").select("doc_id", F.col("quality").alias("label"))
    scored = quality.quality_classifier(table(spark, SF, "documents"), labels, fold("doc_id", 5) != 0).join(labels, "doc_id").where(fold("doc_id", 5) == 0).toPandas()
    assert ((scored.score >= 0.3) == (scored.label == 1)).mean() > 0.9 and scored.score.between(0, 1).all()


def test_quality_equals_a_direct_fit(spark):
    """The distributed fit and its scores against one ridge solution and one isotonic map over all rows in memory."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels").select("doc_id", F.col("quality").alias("label"))
    out = {r.doc_id: r.score for r in quality.quality_classifier(docs, labels, fold("doc_id", 5) != 0).collect()}
    texts, mark = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.label for r in labels.collect()}
    ids = sorted(texts)
    x = dict(zip(ids, quality.statistics([texts[i] for i in ids])))
    train = [i for i in ids if i in mark and not held(i, 5, 0)]
    a, y = np.array([x[i] for i in train]), np.array([mark[i] for i in train], float)
    rng = np.random.default_rng(quality.SEED)
    turn = rng.normal(size=(a.shape[1], quality.FEATURES)) * np.sqrt(2 * quality.GAMMA)
    shift = rng.uniform(0, 2 * np.pi, quality.FEATURES)
    mean, scale = a.mean(0), np.maximum(a.std(0), 1e-6)
    features = lambda v: np.column_stack([np.cos(np.clip((v - mean) / scale, -8, 8) @ turn + shift) * np.sqrt(2 / quality.FEATURES), np.ones(len(v))])
    f = features(a)
    w = np.linalg.solve(f.T @ f + len(a) * quality.RIDGE * np.eye(f.shape[1]) / quality.FEATURES, f.T @ y)
    cell = np.clip((f @ w + 1) / 3 * quality.BINS, 0, quality.BINS - 1).astype(int)
    used = np.unique(cell)
    knots = (used + 0.5) / quality.BINS * 3 - 1
    level = [(y[cell == c].mean(), (cell == c).sum()) for c in used]
    least = [max(min(sum(v * n for v, n in level[i : j + 1]) / sum(n for _, n in level[i : j + 1]) for j in range(k, len(level))) for i in range(k + 1)) for k in range(len(level))]
    raw = features(np.array([x[i] for i in ids])) @ w
    want = (1 - quality.TIES) * np.clip(np.interp(raw, knots, least), 0, 1) + quality.TIES / (1 + np.exp(-np.clip(raw, -30, 30)))
    got = np.array([out[i] for i in ids])
    assert np.mean(np.abs(got - want) < 1e-4) > 0.99  # a text at the edge of a bin may fall to either side
    assert np.corrcoef(got, want)[0, 1] > 0.9999


def test_quality_cases(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "a b " * 30_000, 5), (3, "x", 5)], "doc_id long, text string, label int")
    none = spark.createDataFrame([], "doc_id long, label int")
    assert [r.score for r in quality.quality_classifier(df, none, F.lit(True)).collect()] == [0.5] * 4
    some = spark.createDataFrame([(1, None), (2, 0), (3, 1)], "doc_id long, label int")
    out = quality.quality_classifier(df, some, F.lit(True)).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 for r in out)
    assert quality.quality_classifier(df.limit(0), some, F.lit(True)).count() == 0


def base(text):
    w = words(text)
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    many = {x for x, n in collections.Counter(windows).items() if n > 1}
    covered = {k + j for k, x in enumerate(windows) if x in many for j in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_rule_counts_equal_brute_force(spark):
    texts = [r.text for r in table(spark, SF, "documents").limit(150).collect()]
    texts += [None, "", " \n\t", "é" * 10, "a\n\na\n a\na", "x y z x y z x y z", "a b c d e a b c d e", "line\r\nline\r\n", "#|<> $%&*"]
    texts = [t for t in texts if not t or len(t) < 15_000]
    out = rules.base_counts(texts)
    got = list(zip(*(out[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))))
    assert got == [base(t) for t in texts]


def test_rules_cases(spark):
    good = "the quick brown fox jumps over the lazy dog while many other animals look on"
    df = spark.createDataFrame([(1, good, True), (2, None, None), (3, "", False), (4, good, None), (4, good, None), (5, "zz## yy%% " * 12, None), (6, "q " * 100_000, None)], "doc_id long, text string, trusted boolean")
    out = {r.doc_id: r for r in rules.quality_rules(df).collect()}
    assert out[1].kept and out[4].kept and not out[2].kept and out[2].base_failed and out[3].n_words == 0 and not out[5].kept and out[6].base_failed
    assert rules.quality_rules(df).count() == 7 and rules.quality_rules(df.limit(0)).count() == 0
    none = {r.doc_id: r for r in rules.quality_rules(df.withColumn("trusted", F.lit(False))).collect()}
    assert none[1].llr == 0 and none[1].kept


def test_rules_keep_trusted_documents(spark):
    labels = table(spark, SF, "labels")
    scored = rules.quality_rules(rules.with_trust(table(spark, SF, "documents"), labels)).join(labels, "doc_id").toPandas()
    fair = scored[~scored.base_failed]
    assert fair[fair.quality == 1].kept.mean() > 0.98 and fair[fair.quality == 0].kept.mean() < 0.3


def test_rules_count_the_whole_target(spark):
    n = 20_500  # above any bound that was once on the target
    docs = spark.range(n + 500).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text")).union(spark.sql("select null, 'one two'"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    labels = labels.union(labels.limit(5)).union(spark.sql("select null, 1")).union(spark.sql(f"select {n}L, 0"))
    assert rules.with_trust(docs, labels).where("trusted").count() == n
    raw, target = rules.ngram_counts(rules.mark_trusted(rules.packed_ngrams(docs), rules.trusted_ids(labels)))
    assert raw.sum() == 3 * (n + 501) and target.sum() == 3 * n and (raw > 0).sum() == 3


def test_rules_by_ids_equal_rules_by_column(spark):
    docs, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    a = rules.quality_rules(rules.with_trust(docs, labels)).orderBy("doc_id").collect()
    assert a == rules.quality_rules(docs, good=rules.trusted_ids(labels)).orderBy("doc_id").collect()


def test_ratios_do_not_depend_on_the_size_of_large_tables():
    raw, target = np.zeros(rules.BUCKETS), np.zeros(rules.BUCKETS)
    raw[:4], target[:4] = [9e8, 2e8, 3e5, 40], [3e8, 1e8, 2e4, 0]
    assert np.allclose(rules.log_ratios(raw, target), rules.log_ratios(raw * 60, target * 60))
    assert np.allclose(rules.log_ratios(raw, target), rules.log_ratios(raw / 1000, target / 1000))


def test_a_repeated_table_keeps_the_same_documents(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.001", n) for n in ("documents", "labels"))
    once = {r.doc_id: (r.llr, r.kept) for r in rules.quality_rules(docs, good=rules.trusted_ids(labels)).collect()}
    many = docs.crossJoin(spark.range(10).withColumnRenamed("id", "copy")).drop("copy")
    again = rules.quality_rules(many, good=rules.trusted_ids(labels)).collect()
    assert len(again) == 10 * len(once)
    assert all(r.kept == once[r.doc_id][1] and math.isclose(r.llr, once[r.doc_id][0], abs_tol=1e-6) for r in again)


def kernel(a, b):
    """The gap-weighted triple kernel by its definition."""
    def features(w):
        out = {}
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                    if w[i].isalpha() and w[j].isalpha() and w[k].isalpha():
                        t = w[i] + w[j] + w[k]
                        out[t] = out.get(t, 0) + toxicity.DECAY ** (k - i - 2)
        return out

    x, y = features(a), features(b)
    norm = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(v * y.get(t, 0) for t, v in x.items()) / norm if norm else 0


def test_kernel_equals_its_definition():
    a, b = ["moron", "m.o.r.o.n", "aaaa", "an", "worthless"], ["moron", "morons", "aaa", "less"]
    got = toxicity.kernel(a, b)
    assert np.allclose(got, [[kernel(x, y) for y in b] for x in a])


def test_letters_of_all_scripts_are_told_apart():
    """Letters whose code points differ by a multiple of 2,048 or lie beyond 16 bits are different letters."""
    a = "abc"
    b, c = "".join(chr(ord(x) + 2048 * 10) for x in a), "\U00010400\U00010401\U00010402"
    d = "".join(chr(ord(x) - 0x10000) for x in c)
    some = [a, b, c, d, a + c, "\U0001f600" * 3]
    assert b.isalpha() and c.isalpha() and not some[-1].isalpha()
    assert np.allclose(toxicity.kernel(some, some), [[kernel(x, y) for y in some] for x in some])
    assert toxicity.kernel([a], [b])[0, 0] == 0 == toxicity.kernel([c], [d])[0, 0]


def test_the_folded_machine_equals_the_kernel_machine():
    r = random.Random(2)
    positive = {f"blarg{x}": 3.0 for x in ("an", "it", "el", "os")} | {"snorfle": 5.0}
    negative = {"".join(r.choice("banekrlio") for _ in range(r.randrange(3, 9))): float(r.randrange(1, 30)) for _ in range(80)}
    learnt = toxicity.learn(positive, negative, 60)
    some = [*positive, *list(negative)[:20], "blargun", "sn.or.fle", "zzz", "a"]
    direct = [sum(kernel(w, l) * a for l, a in zip(learnt.landmarks, learnt.dual)) + learnt.machine.bias for w in some]
    assert np.allclose(learnt.machine.words(some), direct, atol=1e-6)
    assert min(direct[:5]) > 0 and max(direct[5:25]) < 0 and direct[25] > 0 and direct[26] > 0
    # no small step improves the objective that the machine minimises over the span of its landmarks
    words = [*positive, *negative]
    y, cost = np.array([1.0] * 5 + [-1.0] * len(negative)), np.ones(len(words))
    x = toxicity.kernel(words, words)
    value, vector = np.linalg.eigh(x)
    z = vector * np.sqrt(np.maximum(value, 0))
    w, b = toxicity.svm(z, y, cost)
    loss = lambda v, c: v @ v + 1e-3 * c * c + (np.maximum(0, 1 - y * (z @ v + c)) ** 2).sum()
    steps = np.random.default_rng(0).normal(size=(30, len(w) + 1)) * 1e-3
    assert all(loss(w, b) <= loss(w + d[:-1], b + d[-1]) + 1e-9 for d in steps)


def test_toxicity_pools_inflected_forms(spark):
    """Insults that never occur twice in one form are found by their stem, and texts labelled by mistake teach nothing."""
    r, rows = random.Random(4), []
    part = lambda: r.choice(["ba", "ke", "li", "so", "tu", "nan", "rel", "mip", "dos", "ri", "po"])
    for i in range(900):
        w = [part() + part() + part() for _ in range(25)]
        label = int(i % 5 == 0 or i % 90 == 1)
        if i % 5 == 0:
            w[r.randrange(25)] = "grunzlat" + part() + part()
        rows.append((i, " ".join(w), label))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    out = {x.doc_id: x.score for x in toxicity.toxicity(df, df.select("doc_id", "label"), F.col("doc_id") % 7 != 0).collect()}
    held = [(out[i] >= 0.3, i % 5 == 0) for i, _, _ in rows if i % 7 == 0]
    assert np.mean([s for s, t in held if t]) > 0.9 and np.mean([s for s, t in held if not t]) < 0.05


def test_toxicity_finds_plain_and_gapped_insults(spark):
    names, clean = ["blargit", "snorfle", "quogwump"], [f"{a}{b}{c}" for a in ("ba", "ke", "li", "so", "tu") for b in ("nan", "rel", "mip", "dos") for c in ("ta", "ne", "ri", "po")]
    rows = []
    for i in range(1200):
        w = [clean[(i * 7 + k * 13 + k * k) % len(clean)] for k in range(30)]
        toxic = i % 3 == 0
        if toxic:
            w[i % 29 + 1], w[(i * 5) % 28 + 2] = names[i % 3], names[(i + 1) % 3]
        rows.append((i, " ".join(w), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    tests = spark.createDataFrame([(5000, "banantadd keril bl.ar.git sonanri", None), (5001, " ".join(clean[:9]), None), (5002, "", None), (5003, None, None), (5004, "kereltane s n o r f l e linanri", None)], "doc_id long, text string, label int")
    out = {r.doc_id: r.score for r in toxicity.toxicity(df.union(tests), df.select("doc_id", "label"), F.col("doc_id") % 5 != 0).collect()}
    right = [(out[i] >= 0.3) == bool(t) for i, _, t in rows if i % 5 == 0]
    assert np.mean(right) > 0.97
    assert out[5000] > 0.3 and out[5004] > 0.3 and out[5001] < 0.3 and out[5002] < 0.3 and out[5003] < 0.3
    assert [r.score for r in toxicity.toxicity(tests, df.select("doc_id", "label").limit(0), F.lit(True)).collect()] == [0.0] * 5
    assert toxicity.toxicity(df.limit(0), df.select("doc_id", "label"), F.lit(True)).count() == 0


def test_toxicity_of_long_and_repeated_rows_and_extra_columns(spark):
    """An insult at the end of a text of 200,000 words counts; repeated rows and rows of one id are each scored."""
    clean = [f"{a}{b}{c}" for a in ("ba", "ke", "li", "so", "tu") for b in ("nan", "rel", "mip", "dos") for c in ("ta", "ne", "ri", "po")]
    rows = [(i, " ".join(["blargit" if k == 3 and i % 3 == 0 else clean[(i * 7 + k * 13 + k * k) % len(clean)] for k in range(20)]), int(i % 3 == 0)) for i in range(300)]
    long = " ".join(clean * 2500)
    more = [(1000, long, None), (1001, long + " blargit", None), (1002, "x" * 300_000, None), (1003, rows[0][1], None), (1003, rows[0][1], None), (1003, rows[1][1], None), (None, rows[0][1], None)]
    df = spark.createDataFrame(rows + more, "doc_id long, text string, label int").withColumns({"score": F.lit("s"), "word": F.lit(1), "worst": F.lit(None)})
    out = {}
    for r in toxicity.toxicity(df, df.select("doc_id", "label"), F.col("doc_id") % 5 != 0).collect():
        out.setdefault(r.doc_id, []).append(r.score)
    assert len(out) == 305 and [len(out[i]) for i in (1000, 1003, None)] == [1, 3, 1]
    assert out[1000][0] < 0.3 <= out[1001][0] and out[1002][0] < 0.3 and sorted(s >= 0.3 for s in out[1003]) == [False, True, True] and out[None][0] >= 0.3


def test_toxicity_learns_from_two_labelled_texts_as_from_many(spark):
    """No number of toxic texts switches the method: two of them point out each other's insults."""
    machine = toxicity.train([(["harmless", "snorfle"], [1.1, 1.0]), (["snorfles", "sunny"], [1.0, 0.9])], {w: 5.0 for w in ("banane", "kerelta", "limipne", "sodosri", "tunanpo")}, lambda m, n: {})
    assert machine.words(["snorfle"])[0] > max(machine.words(["banane", "kerelta"]))
    assert toxicity.train([(["snorfle"], [1.0])], {"banane": 1.0}, lambda m, n: {}).words(["snorfle"])[0] > 0
    assert toxicity.train([], {"banane": 1.0}, lambda m, n: {}) is None is toxicity.train([(["snorfle"], [1.0])], {}, lambda m, n: {})


def brute_scores(docs, is_held):
    """(n_tokens, n_known, base, score) by the definition of the interpolated model."""
    low = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    tokens = [[*words((t or "").translate(low)), "\n"] for _, t in docs]
    count, pairs = {}, {}
    for (i, _), ws in zip(docs, tokens):
        if not is_held(i):
            for v, w in zip(["<s> ", *ws], ws):
                count[w] = count.get(w, 0) + 1
                pairs[v, w] = pairs.get((v, w), 0) + 1
    after, context = {}, {}
    for (v, w), c in pairs.items():
        after[w] = after.get(w, 0) + 1
        k = context.setdefault(v, [0, 0, 0, 0])
        k[0] += c
        k[min(c, 3)] += 1
    n, v_ = sum(count.values()), len(count)
    of = lambda values: kneser_ney.discounts([sum(x == k for x in values) for k in (1, 2, 3, 4)])
    d, e = of(list(pairs.values())), of(list(after.values()))
    rest = sum(e[min(x, 3)] for x in after.values()) / len(pairs) if pairs else 1
    one = lambda w: (after.get(w, 0) - e[min(after.get(w, 0), 3)]) / max(1, len(pairs)) + rest / (v_ + 1)
    out = []
    for ws in tokens:
        score = 0
        for v, w in zip(["<s> ", *ws], ws):
            c, k = pairs.get((v, w), 0), context.get(v)
            score += math.log10(one(w) if k is None else (c - d[min(c, 3)]) / k[0] + sum(d[j] * k[j] for j in (1, 2, 3)) / k[0] * one(w))
        out.append((len(ws), sum(w in count for w in ws), sum(math.log10((count.get(w, 0) + 1) / (n + v_ + 1)) for w in ws), score))
    return out


def test_kneser_ney_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").limit(80).collect()]
    docs += [(100_000, None), (100_001, ""), (100_002, "a A a a"), (100_003, docs[0][1])]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, part int").repartition(3)
    out = {r.doc_id: r for r in kneser_ney.score_documents(df, fold("doc_id", 7) == 2).collect()}
    for (i, _), (n, known, low, score) in zip(docs, brute_scores(docs, lambda i: held(i, 7, 2))):
        r = out[i]
        assert (r.n_tokens, r.n_known, r.held_out) == (n, known, held(i, 7, 2))
        assert math.isclose(r.base_score, low, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)
    assert kneser_ney.score_documents(df.limit(0), F.lit(False)).count() == 0
    long = spark.createDataFrame([(1, "a b c " * 300_000), (1, "a b c " * 300_000), (2, "a b x"), (None, "b c")], "doc_id long, text string")
    rows = kneser_ney.score_documents(long, F.lit(False)).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == [("1", 900_001), ("1", 900_001), ("2", 4), ("None", 3)]
    assert len({r.score for r in rows if r.doc_id == 1}) == 1 and all(r.score < 0 for r in rows)
    twins = [(k, f"one {w} two {w} three {x} four") for k, (w, x) in enumerate([("w26154f", "w2af056"), ("w2af056", "w26154f"), ("w2af056", "plain"), ("other", "w26154f")])]  # their hashes share 40 bits
    scored = {r.doc_id: r.score for r in kneser_ney.score_documents(spark.createDataFrame(twins, "doc_id long, text string"), F.lit(False)).collect()}
    assert all(math.isclose(scored[i], want[3], rel_tol=1e-9) for (i, _), want in zip(twins, brute_scores(twins, lambda i: False)))
    nothing = kneser_ney.score_documents(df.where("doc_id >= 100000"), F.lit(True)).collect()
    assert all(r.score == 0 and r.base_score == 0 and r.train_tokens == 0 for r in nothing)


def test_kneser_ney_scores_new_texts_from_the_stored_model(spark, tmp_path, monkeypatch):
    docs = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").limit(60).collect()]
    docs += [(100_000, None), (100_001, ""), (100_002, "unheard-of words only"), (100_003, docs[0][1]), (None, "b c"), (100_000, None)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, part int").repartition(3)
    held_out = (fold("doc_id", 7) == 2) | (F.col("doc_id") >= 100_000)
    key = lambda r: (str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score, r.perplexity)
    want = sorted(key(r) for r in kneser_ney.score_documents(df, held_out).collect())
    kneser_ney.fit(df, held_out).save(str(tmp_path / "model"))
    model = kneser_ney.Model.load(spark, str(tmp_path / "model"))
    assert sorted(key(r) for r in model.score(df).collect()) == want
    monkeypatch.setattr(kneser_ney, "SHARD_TOKENS", 50)  # several copies of each shard
    assert sorted(key(r) for r in model.score(df.repartition(5)).collect()) == want
    assert model.score(df.limit(0)).count() == 0
    nothing = kneser_ney.fit(df, F.lit(True)).score(df)
    assert {(r.score, r.n_known) for r in nothing.collect()} == {(0.0, 0)}
