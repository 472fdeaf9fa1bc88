"""Quality classifier: document statistics, random Fourier features, ridge regression, isotonic calibration.

Statistics of each text are standardised and mapped to random Fourier features, which approximate a Gaussian kernel.
Every partition sums its normal equations, the sums are added by row in Spark, and one system of fixed size is solved on
the driver.  The ridge scores are calibrated by isotonic regression on a histogram of fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct_per_text, filter_texts, in_repeats, map_texts, materialize, sums
from .hashing import Batch
from .rules import duplicate_lines

FEATURES, RIDGE, GAMMA, SEED = 256, 1e-3, 0.03, 7
#: Bins of the calibration histogram over ridge scores in [-1, 2].
BINS = 1500
#: Share of the uncalibrated score in the result: it orders what the calibration has tied.
TIES = 0.001
#: Score of every text when there are no labels to learn from.
NO_LABELS = 0.5

_CLASSES = ["upper", "lower", "digit", "space", "newline", "symbol", "bang", "stop", "other", "high"]
_CLASS = np.full(256, _CLASSES.index("other"))
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 9
for _name, _bytes in (("space", b" \t\r\f\v"), ("newline", b"\n"), ("symbol", b"#*$%&|<>@^~_{}[]\\/=+"), ("bang", b"!?"), ("stop", b".,;:")):
    _CLASS[list(_bytes)] = _CLASSES.index(_name)
STATISTICS = [*_CLASSES, "log_chars", "log_words", "word_length", "long_words", "distinct", "repeated_next", "repeated_windows", "dup_lines", "words_per_line"]


def statistics(texts) -> np.ndarray:
    """A row of len(STATISTICS) numbers for each text; the order of rows is the order of texts."""
    batch, n = Batch.of(texts), len(texts)
    words = batch.words()
    index, size = words.text_index(), (words.end - words.start)
    length = np.diff(batch.offset) - 1
    byte_text = np.repeat(np.arange(n), np.diff(batch.offset))
    share = np.bincount(byte_text * len(_CLASSES) + _CLASS[batch.buffer], minlength=n * len(_CLASSES)).reshape(n, -1).astype(float)
    share[:, _CLASSES.index("newline")] -= 1
    lines = share[:, _CLASSES.index("newline")] + 1
    share /= np.maximum(length, 1)[:, None]
    count = np.maximum(words.counts, 1)
    window, _, window_text = words.windows(3)
    twice, _ = in_repeats(window_text, window)
    next_same = np.flatnonzero((words.hash[1:] == words.hash[:-1]) & (index[1:] == index[:-1]))
    more = [
        np.log1p(length),
        np.log1p(words.counts),
        sums(index, n, size) / count,
        sums(index[size > 12], n) / count,
        distinct_per_text(index, words.hash, n) / np.sqrt(count),
        sums(index[next_same], n) / count,
        sums(window_text[twice], n) / count,
        duplicate_lines(batch, words) / np.maximum(lines, 1),
        np.log1p(words.counts / np.maximum(lines, 1)),
    ]
    return np.column_stack([np.sqrt(share), *more])


@dataclass
class Model:
    """mean, scale: of the statistics; turn, shift: random directions; weights: of the features and 1; knots: score map."""

    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        f = np.cos(z @ self.turn + self.shift) * np.sqrt(2 / self.turn.shape[1])
        return np.column_stack([f, np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        calibrated = np.clip(np.interp(raw, *self.knots), 0, 1)
        return (1 - TIES) * calibrated + TIES / (1 + np.exp(-np.clip(raw, -30, 30)))


def isotonic(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing fit with least weighted squares."""
    blocks: list[list[float]] = []
    for value, w in zip(y, weight):
        blocks.append([value, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w2, k = blocks.pop()
            u = blocks[-1]
            u[0], u[1], u[2] = (u[0] * u[1] + v * w2) / (u[1] + w2), u[1] + w2, u[2] + k
    return np.concatenate([np.full(k, v) for v, _, k in blocks]) if blocks else np.zeros(0)


def _rows(batch, names=STATISTICS) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])


def fit(labelled: DataFrame, features: int = FEATURES) -> Model | None:
    """Fit on (statistics..., label).  None when there are no labels.  All rows are used."""
    d = len(STATISTICS)
    sums_ = labelled.agg(F.count("*"), *[f(c) for c in STATISTICS for f in (F.avg, F.stddev_pop)]).first()
    if not sums_[0]:
        return None
    rng = np.random.default_rng(SEED)
    mean, scale = np.array(sums_[1::2], float), np.maximum(np.array(sums_[2::2], float), 1e-6)
    model = Model(mean, scale, rng.normal(size=(d, features)) * np.sqrt(2 * GAMMA), rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), (np.array([0.0, 1.0]), np.array([0.0, 1.0])))
    size = features + 2

    def normal(batches):
        total = np.zeros((size, size))
        for batch in batches:
            f = np.column_stack([model.features(_rows(batch)), batch.column("label").to_numpy(zero_copy_only=False)])
            total += f.T @ f
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(list(total))], names=["i", "row"])

    def add(key, table):
        rows = np.stack(table["row"].to_numpy())
        return pa.table({"i": [key[0].as_py()], "row": [rows.sum(0)]})

    parts = labelled.mapInArrow(normal, "i long, row array<double>")
    total = parts.groupBy("i").applyInArrow(add, "i long, row array<double>").orderBy("i").toArrow()
    total = np.stack(total["row"].to_numpy())
    left, right, n = total[:-1, :-1], total[:-1, -1], sums_[0]
    model.weights = np.linalg.solve(left + n * RIDGE * np.eye(size - 1) / features, right)

    def bins(batches):
        for batch in batches:
            b = np.clip((model.raw(_rows(batch)) + 1) / 3 * BINS, 0, BINS - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(b), batch.column("label").cast(pa.float64())], names=["bin", "label"])

    hist = labelled.mapInArrow(bins, "bin long, label double").groupBy("bin").agg(F.avg("label").alias("y"), F.count("*").alias("n")).orderBy("bin").toArrow()
    at = (hist["bin"].to_numpy() + 0.5) / BINS * 3 - 1
    model.knots = (at, isotonic(hist["y"].to_numpy(), hist["n"].to_numpy()))
    return model


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and the statistics of each text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, " + ", ".join(f"{c} double" for c in STATISTICS)

    def measure(texts, batch):
        return {"doc_id": batch.column("doc_id")} | dict(zip(STATISTICS, statistics(texts).T))

    return materialize(map_texts(rows, "text", schema, measure), "statistics")


def fit_labels(stats: DataFrame, labels: DataFrame, train) -> Model | None:
    known = labels.where("label is not null and doc_id is not null").select("doc_id", F.col("label").cast("double").alias("label"))
    return fit(materialize(stats.where(train).join(known, "doc_id").select("label", *STATISTICS), "labelled"))


def quality_classifier(docs: DataFrame, labels: DataFrame, train, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for each document.  labels: doc_id, label (0 or 1); `train` is a condition on doc_id.

    Only rows that fulfil `train` are learnt from; null labels are passed over.  Null texts count as empty; empty texts
    get the score of their statistics.  If several rows share an id each is scored by its own text.  Without any label
    every score is 0.5.  Other columns are not read.  An empty table gives an empty result.
    """
    stats = measured(docs, id_col, text_col)
    model = fit_labels(stats, labels, train)

    def score(batches):
        for batch in batches:
            s = model.score(_rows(batch)) if model else np.full(batch.num_rows, NO_LABELS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    return stats.mapInArrow(score, "doc_id long, score double")


def good_documents(docs: DataFrame, labels: DataFrame, train, limit: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, with a score of `limit` or more; texts are measured twice, not shuffled.

    Every row is judged by its own text, whatever its id; else as `quality_classifier`.
    """
    model = fit_labels(measured(docs, id_col, text_col), labels, train)
    if model is None:
        return docs.where(F.lit(NO_LABELS >= limit))
    return filter_texts(docs, text_col, lambda texts: model.score(statistics(texts)) >= limit)
