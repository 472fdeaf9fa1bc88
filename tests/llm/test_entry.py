"""The registered queries against brute force, through the driver's entry point."""

import hashlib
import re
import zlib

import __spark_entry__
import numpy as np
import public_tokenizers as P
import pytest

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    rows = __spark_entry__.queries()[name](spark, SF).toPandas()
    return rows


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


@pytest.mark.parametrize("name, n, held", [("op1_quality_classifier", 5, 0), ("op6_toxicity", 4, 2)])
def test_scores(spark, docs, name, n, held):
    out = run(spark, name)
    assert sorted(out.doc_id) == sorted(docs)
    assert (out.held_out == [zlib.crc32(str(i).encode()) % n == held for i in out.doc_id]).all()
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.3)).all() and out.predicted.dtype.kind == "i"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    for name, label, recall, wrong in (("op1_quality_classifier", "quality", 0.97, 0.35), ("op6_toxicity", "toxic", 0.6, 0.08)):
        out = __spark_entry__.queries()[name](spark, sf).toPandas().merge(labels, on="doc_id")
        out = out[out.held_out]
        assert out[out[label] == 1].predicted.mean() >= recall and out[out[label] == 0].predicted.mean() <= wrong


def test_near_dedup(spark, docs):
    from test_dedup import classes

    out = run(spark, "op2_minhash_near_dedup").set_index("doc_id").class_id.to_dict()
    assert out == classes(list(docs.items()))


def test_rules(spark, docs):
    from test_scores import base

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = run(spark, "op3_quality_rules").set_index("doc_id")
    assert sorted(out.index) == sorted(docs)
    for i, text in docs.items():
        row = out.loc[i]
        assert tuple(row[names]) == base(text)
        failed = row.n_words < 10 or 100 * row.n_repeat_words > 20 * row.n_words
        assert row.base_failed == failed and not (failed and row.kept)
    assert not out.base_failed.all() and out.kept.any()


def test_verdicts_of_the_ratio(spark, docs):
    """kept by the definition of the likelihood ratio, with counts taken from all texts at once."""
    from leadloom.llm import rules
    from leadloom.llm.hashing import Batch

    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    good = set(labels[labels.quality == 1].doc_id)
    raw, target, own = np.zeros(rules.BUCKETS), np.zeros(rules.BUCKETS), {}
    for i, text in docs.items():
        own[i], _ = rules.ngram_buckets(Batch.of([text]).words())
        n = len(words(text))
        assert len(own[i]) == max(0, 2 * n - 1)
        np.add.at(raw, own[i], 1)
        if i in good:
            np.add.at(target, own[i], 1)
    expected = raw * target.sum() / raw.sum()
    prior = target.sum() / 10_000
    ratio = np.log((target + prior) / (expected + prior))
    out = run(spark, "op3_quality_rules").set_index("doc_id")
    for i in docs:
        llr = ratio[own[i]].mean() if len(own[i]) else 0.0
        assert abs(out.llr[i] - llr) < 1e-5
        if abs(llr - rules.THRESHOLD) > 1e-5:
            assert out.kept[i] == (not out.base_failed[i] and llr >= rules.THRESHOLD)


def test_pages(spark):
    out = run(spark, "op4_html_extraction")
    assert list(out.columns) == ["page_id", "url", "text", "n_chars"] and (out.n_chars == out.text.str.len()).all() and len(out) > 0


def test_tokens(spark, docs):
    import sentencepiece
    import tiktoken

    piece = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    out = run(spark, "op5_token_counts").set_index("doc_id")
    assert all((out.n_bytes[i], out.n_tokens[i]) == (len(t.encode()), len(piece.encode(t))) for i, t in docs.items()) and (out.over_limit == (out.n_tokens > 4096)).all()
    from leadloom.llm.tokens import ByteBpe

    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ByteBpe.load(P.path("byte_bpe_multi_50k.tiktoken")).ranks, special_tokens={})
    out = run(spark, "op10_bpe_round_trip").set_index("doc_id")
    for i, t in docs.items():
        ids = np.array(lib.encode_ordinary(t), "<u4").tobytes()
        assert (out.n_tokens[i], out.ids_sha256[i], out.decoded_sha256[i]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_language_model(spark, docs):
    from test_scores import brute_scores

    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    want = brute_scores(list(docs.items()), lambda i: held[i])
    out = run(spark, "op7_lm_scoring").set_index("doc_id")
    for i, (n, known, base, score) in zip(docs, want):
        row = out.loc[i]
        assert (row.held_out, row.n_tokens, row.n_known) == (held[i], n, known)
        assert abs(row.base_score - base) < 1e-6 * max(1, abs(base)) and abs(row.score - score) < 1e-6 * max(1, abs(score))
    assert out.train_tokens.nunique() == 1


def test_exact_dedup(spark, docs):
    out, best, size = run(spark, "op8_exact_dedup").set_index("doc_id"), {}, {}
    for i, t in docs.items():
        k = t.translate(LOWER)
        best[k], size[k] = max(i, best.get(k, i)), size.get(k, 0) + 1
    for i, t in docs.items():
        k, row = t.translate(LOWER), out.loc[i]
        assert (row.keep_id, row.group_size, row.kept, row.text_sha256) == (best[k], size[k], best[k] == i, hashlib.sha256(k.encode()).hexdigest())


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    out = run(spark, "op9_packing")
    for i, rows in out.groupby("doc_id"):
        ids = np.array([*lib.encode(docs[i], add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in rows.sort_values("start").itertuples():
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for _, rows in out.sort_values("offset").groupby("sequence_id"):
        assert (rows.offset == rows.length.cumsum() - rows.length).all() and rows.length.sum() <= 2048
    assert set(out.doc_id) == set(docs)
