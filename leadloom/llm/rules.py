"""Quality rules: base counts of every text, and a hashed n-gram log-likelihood ratio of target against corpus.

Two multinomials over hashed word uni- and bigrams are counted: one over all documents, one over the trusted target.
A text's ratio is the mean of log(target probability / corpus probability) over its n-grams, so long and short texts
compare.  Base rules and the threshold on the ratio decide every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, filter_texts, in_repeats, map_texts, sums
from .hashing import Batch, combine, ranges_hash

#: Hash buckets of the two multinomials: a bound on what reaches the driver and the workers.
BUCKETS = 1 << 16
#: Texts with a mean log ratio below this are dropped.
THRESHOLD = -0.1
#: Occurrences that a bucket is held to have had beside its own, at the rate of the corpus, as a share of the target's n-grams:
#: rare n-grams say little, and a table repeated any number of times keeps the same documents.
PRIOR_SHARE = 1e-4
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def ngram_buckets(words) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text index) of every uni- and bigram of a batch."""
    two, _, text2 = words.windows(2)
    one = combine(words.hash, np.uint64(1))
    h = np.concatenate([one, combine(two, np.uint64(2))])
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate([words.text_index(), text2])


def packed_ngrams(rows: DataFrame) -> DataFrame:
    """doc_id, ngrams of rows(doc_id, text), and trusted if rows have it; ngrams holds the 16-bit buckets of a text's n-grams."""
    kept = [c for c in rows.columns if c != "text"]
    schema = ", ".join(f"{name} {kind}" for name, kind in rows.select(kept).dtypes) + ", ngrams binary"

    def pack(texts, batch):
        bucket, index = ngram_buckets(Batch.of(texts).words())
        ends = np.concatenate([[0], np.cumsum(sums(index, len(texts)))]) * 2
        raw = bucket[np.argsort(index, kind="stable")].astype("<u2").tobytes()
        ngrams = [raw[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
        return {c: batch.column(c) for c in kept} | {"ngrams": pa.array(ngrams, pa.binary())}

    return map_texts(rows, "text", schema, pack)


def mark_trusted(packed: DataFrame, good: DataFrame) -> DataFrame:
    """packed with trusted: its doc_id is in good(doc_id), which has each id once.

    Both sides are shuffled, so the number of trusted ids has no bound; rows without an id are spread over all tasks.
    """
    none = F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.xxhash64("ngrams"), F.lit(1 << 20))).otherwise(0)
    left = packed.withColumn("__id", F.coalesce("doc_id", F.lit(0))).withColumn("__none", none)
    right = good.select(F.col("doc_id").cast("long").alias("__id"), F.lit(0).cast("long").alias("__none"), F.lit(True).alias("trusted"))
    return left.join(right.hint("merge"), ["__id", "__none"], "left").drop("__id", "__none")


def ngram_counts(packed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(corpus counts, target counts) per bucket over all rows of packed(ngrams, trusted)."""

    def run(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in chunks(batches, "ngrams"):
            ngrams = batch.column("ngrams").to_pylist()
            good = batch.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
            for of, some in ((raw, ngrams), (target, [x for x, g in zip(ngrams, good) if g])):
                of += np.bincount(np.frombuffer(b"".join(some), "<u2"), minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    rows = packed.select("ngrams", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    parts = rows.mapInArrow(run, "bucket long, raw long, target long")
    found = parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = found["bucket"].to_numpy()
    raw[at], target[at] = found["raw"].to_numpy(), found["target"].to_numpy()
    return raw, target


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket: log of target probability over corpus probability, drawn to 0 where the target should have little."""
    if not target.sum() or not raw.sum():
        return np.zeros(BUCKETS)
    expected = raw * (target.sum() / raw.sum())
    prior = PRIOR_SHARE * target.sum()
    return np.log((target + prior) / (expected + prior))


def base_counts(texts) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, each per text."""
    batch, n = Batch.of(texts), len(texts)
    words = batch.words()
    index = words.text_index()
    head = np.concatenate([[0], np.cumsum((batch.buffer & 0xC0) != 0x80)])
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[batch.buffer])])
    out = {
        "n_words": words.counts,
        "word_chars": sums(index, n, head[words.end] - head[words.start]),
        "n_symbols": symbols[batch.offset[1:]] - symbols[batch.offset[:-1]],
        "n_dup_lines": duplicate_lines(batch, words),
    }
    window, at, text = words.windows(5)
    twice, _ = in_repeats(text, window)
    edge = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + 5, -1)
    out["n_repeat_words"] = sums(index[np.cumsum(edge[:-1]) > 0], n)
    return {k: v.astype(np.int64) for k, v in out.items()}


def duplicate_lines(batch: Batch, words) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    end = np.flatnonzero(batch.buffer == 10)
    start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    full = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end = start[full], end[full]
    text = np.searchsorted(batch.offset, start, side="right") - 1
    _, later = in_repeats(text, ranges_hash(batch.buffer, start, end))
    return sums(text[later], len(batch.offset) - 1)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trusted_col: str = "trusted", threshold: float = THRESHOLD, good: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept.

    `trusted_col` marks the rows of the trusted target; null means not trusted.  With good(doc_id), which has each id once,
    the target is all rows whose id is in it, and `trusted_col` is not read.  Null and empty texts have no words, fail
    the base rules and have ratio 0.  With no trusted row at all every ratio is 0, so that the base rules alone decide.
    Repeated rows are scored alike and all returned; other columns are not read; an empty table gives an empty result.
    Counts cover all rows.  Very long texts are handled one at a time per task.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    judge = _judge(docs, id_col, text_col, trusted_col, good)
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double"
    scored = map_texts(rows, "text", schema, lambda texts, batch: judge(texts) | {"doc_id": batch.column("doc_id")})
    failed = scored.withColumn("base_failed", base_failed())
    return failed.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")


def _judge(docs: DataFrame, id_col: str, text_col: str, trusted_col: str, good: DataFrame | None):
    """A function of texts that gives the base counts and llr, after counting the multinomials of docs."""
    if good is None:
        packed = packed_ngrams(docs.select(F.col(text_col).alias("text"), F.col(trusted_col).cast("boolean").alias("trusted")))
    else:
        packed = mark_trusted(packed_ngrams(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))), good)
    ratio = log_ratios(*ngram_counts(packed))
    shared = docs.sparkSession.sparkContext.broadcast(ratio.astype(np.float32))

    def judge(texts) -> dict[str, np.ndarray]:
        out = base_counts(texts)
        bucket, index = ngram_buckets(Batch.of(texts).words())
        out["llr"] = sums(index, len(texts), shared.value[bucket].astype(np.float64)) / np.maximum(1, sums(index, len(texts)))
        return out

    return judge


def kept_documents(docs: DataFrame, good: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns as they are, that `quality_rules` keeps; texts are read twice, not shuffled."""
    judge = _judge(docs, id_col, text_col, "", good)

    def keep(texts) -> np.ndarray:
        found = judge(texts)
        return (found["n_words"] >= 10) & (found["n_repeat_words"] * 100 <= found["n_words"] * 20) & (found["llr"] >= threshold)

    return filter_texts(docs, text_col, keep)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of every document labelled as good, once each: those of which any label row says so."""
    return labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()


def with_trust(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text) with trusted: labelled as good.  Shuffles the texts; `quality_rules` with `good` shuffles less."""
    good = trusted_ids(labels).withColumn("trusted", F.lit(True))
    return docs.select("doc_id", "text").join(good.hint("merge"), "doc_id", "left")
