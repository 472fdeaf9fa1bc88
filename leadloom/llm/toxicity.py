"""Toxicity by a subsequence string kernel and a support vector machine on Nystroem landmarks.

The kernel compares words by their letter triples that need not be adjacent: a triple spread over k positions counts
DECAY ** (k - 3), up to SPAN positions.  Characters that are no letters only widen the gaps, so insults with inserted or
separating characters stay close to the plain word, and so do inflected forms.  A linear machine is trained on the Nystroem
map of the kernel.  As kernel and map are linear in the triples, the machine folds into one weight for each triple, and a
word costs a few table lookups.

Training is by labelled sentences, as bags of words: all words of sentences of other texts are negative, and in the
sentences of a toxic text at least one word, not known which, is positive (a multiple-instance machine).  In each round two
machines, each learnt from half of the toxic texts, point out the positive words of the other half; a word counts only if
it is found by what other texts teach, so that evidence is pooled over forms by the kernel and texts without any insult
drop out.  Negative words that come out worst among all words of the labelled texts join the examples.  A sentence has the
value of its worst word and a text that of its worst sentence, calibrated on labelled texts.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, map_texts, materialize
from .hashing import Batch
from .quality import TIES, isotonic

DECAY, SPAN = 0.7, 6
#: Bound on the labelled texts that the words are learnt from (chosen by a hash of the id).
TRAIN_TEXTS = 20_000
#: Bounds on landmarks (a quarter each from toxic and other words, the rest are hard examples) and on negative words, half of
#: them the most frequent and half the worst.  A bag has all words of its text that may be positive.
LANDMARKS, TRAIN_WORDS = 640, 12_000
#: Words whose values are worked out at a time.
SOME_WORDS = 4000
#: A word may be positive if it is found so many times as often in toxic sentences as in others; one occurrence will do.
PURE = 3.0
#: Rounds of pointing out positive words, the landmarks of their machines, the cost of an example, and the value of a positive word.
ROUNDS, ROUND_LANDMARKS, COST, POINTED = 3, 320, 10.0, 0.3
BINS, LIMIT = 800, 4.0
#: Score of every text when there are no labels, or labels of one class, to learn from.
NO_LABELS = 0.0
#: Longer words are cut into overlapping stretches of this many characters.
WIDTH = 32

SPACED = re.compile(r"(?<!\S)(?:\w[ ]){2,}\w(?!\S)")
SENTENCE = re.compile(r"[.!?]+(?=\s)|\n")
OFFSETS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]


def prepared(text: str | None) -> str:
    """Lower case; letters that are spaced out are joined to a word."""
    text = (text or "").lower()
    return SPACED.sub(lambda m: m[0].replace(" ", ""), text)


def stretches(words: list[str]) -> tuple[list[str], np.ndarray]:
    """Words cut to WIDTH characters with an overlap of half, and the number of the word of each stretch."""
    out, index = [], []
    for k, w in enumerate(words):
        if len(w) <= WIDTH:
            out.append(w), index.append(k)
        else:
            for at in range(0, len(w) - WIDTH // 2, WIDTH // 2):
                out.append(w[at : at + WIDTH]), index.append(k)
    return out, np.array(index, np.int64)


def triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word index, triple code, weight), summed over equal triples of a word; a code has the three code points whole."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    wide = np.array(words, f"U{max(1, max(map(len, words)))}")
    code = wide.view(np.uint32).reshape(n, -1).astype(np.int64)
    code = np.where(_letters()[code], code, -1)
    width = code.shape[1]
    word, key, weight = [], [], []
    for i, j in OFFSETS:
        if width <= j:
            continue
        a, b, c = code[:, : width - j], code[:, i : width - j + i], code[:, j:]
        ok = (a >= 0) & (b >= 0) & (c >= 0)
        word.append(np.nonzero(ok)[0])
        key.append((a[ok] << 42) | (b[ok] << 21) | c[ok])
        weight.append(np.full(len(key[-1]), DECAY ** (j - 2)))
    if not word:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    word, key, weight = map(np.concatenate, (word, key, weight))
    order = np.lexsort((key, word))
    word, key, weight = word[order], key[order], weight[order]
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (key[1:] != key[:-1])
    first = np.flatnonzero(new)
    return word[first], key[first], np.add.reduceat(weight, first) if len(first) else weight


_table: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _table:
        _table.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _table[0]


def _norms(word: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    return np.sqrt(np.maximum(np.bincount(word, weight**2, minlength=n), 1e-12))


@dataclass
class Machine:
    """A weight for each triple that occurs in a landmark, the bias, and the calibration of a text's worst word."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    knots: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def words(self, words: list[str]) -> np.ndarray:
        """The decision value of each word; a long word has that of its worst stretch."""
        parts, index = stretches(words)
        word, key, weight = triples(parts)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        total = np.bincount(word[hit], weight[hit] * self.weights[at[hit]], minlength=len(parts))
        value = total / _norms(word, weight, len(parts)) + self.bias
        out = np.full(len(words), -np.inf)
        np.maximum.at(out, index, value)
        return out

    def by_word(self, words: set[str]) -> dict[str, float]:
        """Decision values of different words, some at a time."""
        every = list(words)
        return {w: v for k in range(0, len(every), SOME_WORDS) for w, v in zip(every[k : k + SOME_WORDS], self.words(every[k : k + SOME_WORDS]).tolist())}

    def score(self, worst: np.ndarray) -> np.ndarray:
        return (1 - TIES) * np.interp(worst, *self.knots) + TIES / (1 + np.exp(-np.clip(worst, -30, 30)))


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """The normalised kernel between two lists of words."""
    wa, ka, va = triples(words)
    wb, kb, vb = triples(landmarks)
    va, vb = va / _norms(wa, va, len(words))[wa], vb / _norms(wb, vb, len(landmarks))[wb]
    keys = np.unique(kb)
    dense = np.zeros((len(keys), len(landmarks)))
    dense[np.searchsorted(keys, kb), wb] = vb
    out = np.zeros((len(words), len(landmarks)))
    at = np.minimum(np.searchsorted(keys, ka), max(len(keys) - 1, 0))
    hit = np.flatnonzero(keys[at] == ka) if len(keys) else np.zeros(0, np.int64)
    for part in range(0, len(hit), 10_000):
        h = hit[part : part + 10_000]
        first = np.flatnonzero(np.diff(wa[h], prepend=-1))  # triples lie in the order of their words
        out[wa[h[first]]] += np.add.reduceat(va[h, None] * dense[at[h]], first)
    return out


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 200) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss and a cost for each example, by Newton steps on the active set."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    ridge = np.append(np.ones(x.shape[1]), 1e-3)
    active = None
    for _ in range(epochs):
        now = y * (z @ w) < 1
        if active is not None and (now == active).all():
            break
        active, zc = now, z[now] * cost[now, None]
        w = np.linalg.solve(zc.T @ z[now] + np.diag(ridge), zc.T @ y[now])
    return w[:-1], float(w[-1])


def with_gaps(word: str) -> list[str]:
    """Variants with separators, and with one inserted character."""
    middle = range(1, len(word))
    return [".".join(word), *(word[:k] + c + word[k:] for k in middle for c in ("x", "*"))]


@dataclass
class Learnt:
    """A machine with what it came from: its values are kernel(words, landmarks) @ dual + bias."""

    machine: Machine
    landmarks: list[str]
    dual: np.ndarray


def learn(positive: dict[str, float], negative: dict[str, float], most: int = LANDMARKS) -> Learnt:
    """The machine that tells words apart; each word has a number of bags or occurrences."""
    gapped = {g: n / 16 for w, n in positive.items() for g in with_gaps(w)} | positive
    words = [*gapped, *(w for w in negative if w not in gapped)]
    y = np.where(np.arange(len(words)) < len(gapped), 1.0, -1.0)
    cost = COST * np.sqrt(np.array([gapped.get(w) or negative[w] for w in words], float))
    order = np.argsort(-cost, kind="stable")
    chosen = [*order[y[order] > 0][: most // 4], *order[y[order] < 0][: most // 4]]
    for last in (False, False, True):
        landmarks = sorted({p for k in chosen for p in stretches([words[k]])[0]})
        value, vector = np.linalg.eigh(kernel(landmarks, landmarks))
        use = value > 1e-4
        root = vector[:, use] / np.sqrt(value[use])
        x = kernel(words, landmarks) @ root
        w, bias = svm(x, y, cost)
        if not last:  # the examples that the machine gets most wrong are landmarks next
            loss = cost * np.maximum(0, 1 - y * (x @ w + bias)) ** 2
            loss[chosen] = 0
            chosen += list(np.argsort(-loss, kind="stable")[: most // 4])
    wb, kb, vb = triples(landmarks)
    scaled = vb / _norms(wb, vb, len(landmarks))[wb] * (root @ w)[wb]
    keys, at = np.unique(kb, return_inverse=True)
    return Learnt(Machine(keys, np.bincount(at, scaled, minlength=len(keys)), bias), landmarks, root @ w)


def train(bags: list[tuple[list[str], list[float]]], negative: dict[str, float], worst) -> Machine | None:
    """A machine from bags (words, gains) of toxic texts and negative words with their occurrences.

    worst(machine) gives the negative words of all labelled texts with the greatest values.  A bag starts with its word of
    the greatest gain.  One bag alone cannot be judged by another and stands for its first word.
    """
    bags = [bag for bag in bags if bag[0]]
    if not bags or not negative:
        return None
    found = [[words[int(np.argmax(gains))]] for words, gains in bags]
    count = lambda some: dict(Counter(w for words in some for w in set(words)))
    if len(bags) > 1:
        first = found
        for _ in range(ROUNDS):
            now = [[] for _ in bags]
            for half in (0, 1):
                machine = learn(count(found[1 - half :: 2]) or count(first[1 - half :: 2]), negative, ROUND_LANDMARKS).machine
                value = machine.by_word({w for words, _ in bags[half::2] for w in words})
                now[half::2] = [[w for w in words if value[w] > POINTED] for words, _ in bags[half::2]]
                negative = negative | {w: n for w, n in worst(machine, TRAIN_WORDS // 4).items()}
            found = now
        if not any(found):
            found = first
    return learn(count(found), negative).machine


def word_counts(labelled: DataFrame) -> DataFrame:
    """(word, toxic, other) over the different sentences of (text, label); one is toxic if it is in toxic texts only.

    `other` counts occurrences in other sentences; `toxic` counts the different words before it in toxic ones, so that a
    harmless word of a text with many near copies does not pass for an insult.
    """

    def split(batches):
        for batch in chunks(batches, "text"):
            found = {}
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                for sentence in SENTENCE.split(prepared(text)):
                    found[sentence] = min(found.get(sentence, 1), int(label > 0))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["sentence", "toxic"])

    def count(batches):
        for batch in chunks(batches, "sentence"):
            total: dict[tuple[str, str], int] = {}
            for sentence, toxic in zip(batch.column("sentence").to_pylist(), batch.column("toxic").to_pylist()):
                words = [w.strip(".,;:!?\"'()") for w in sentence.split()]
                for before, w in zip(["^", *words], words):
                    for part in stretches([w])[0]:
                        key = (part, before if toxic else "")
                        total[key] = total.get(key, 0) + 1
            toxic = [1 if before else 0 for _, before in total]
            other = [0 if before else n for (_, before), n in total.items()]
            columns = [pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()), pa.array(toxic, pa.int64()), pa.array(other, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "before", "toxic", "other"])

    sentences = labelled.mapInArrow(split, "sentence string, toxic long").groupBy("sentence").agg(F.min("toxic").alias("toxic"))
    parts = sentences.mapInArrow(count, "word string, before string, toxic long, other long")
    contexts = parts.groupBy("word", "before").agg(F.max("toxic").alias("toxic"), F.sum("other").alias("other"))
    return contexts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def bag_words(labelled: DataFrame) -> DataFrame:
    """(bag, word): the different words of each toxic text of (doc_id, text, label)."""

    def split(batches):
        for batch in chunks(batches, "text"):
            bag, word = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                own = {p for p in stretches(list({w.strip(".,;:!?\"'()") for w in prepared(text).split()}))[0]}
                bag += [doc] * len(own)
                word += own
            yield pa.RecordBatch.from_arrays([pa.array(bag, pa.int64()), pa.array(word, pa.string())], names=["bag", "word"])

    return labelled.where("label > 0").select("doc_id", "text").mapInArrow(split, "bag long, word string").distinct()


def fit(rows: DataFrame, known: DataFrame) -> Machine | None:
    """Learn the machine, without calibration, from rows(doc_id, text) and known(doc_id, label)."""
    some = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(TRAIN_TEXTS))
    labelled = rows.join(some, "doc_id").select("doc_id", "text", "label")
    counted = materialize(word_counts(labelled.select("text", "label")).where(F.length(F.regexp_replace("word", r"\P{L}", "")) > 2), "words")
    toxic, other = counted.agg(F.sum("toxic"), F.sum("other")).first()
    if not toxic or not other:
        return None
    share = F.log((F.col("toxic") + 0.5) / (toxic + 1.0) / ((F.col("other") + 0.5) / (other + 1.0)))
    leans = (share > 0) & (F.col("toxic") + 0.5 >= PURE * (F.col("other") + 0.5))
    gains = counted.where(leans).select("word", (F.col("toxic") * share).alias("gain"))
    bags = bag_words(labelled).join(gains, "word").orderBy("bag", F.desc("gain"), "word").select("bag", "word", "gain").toArrow()
    named = bags["word"].combine_chunks().dictionary_encode()
    names, place, gain = named.dictionary.to_pylist(), named.indices.to_pylist(), bags["gain"].to_pylist()  # a word is held once
    _, edge = np.unique(bags["bag"].to_numpy(), return_index=True)
    of = [([names[k] for k in place[a:b]], gain[a:b]) for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(place)])]
    negative = counted.where("other > 0").where(~leans).select("word", "other")

    def worst(machine: Machine, n: int) -> dict[str, int]:
        def value(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("other"), pa.array(machine.words(batch.column("word").to_pylist()))], names=["word", "other", "value"])

        found = negative.mapInArrow(value, "word string, other long, value double").orderBy(F.desc("value"), "word").limit(n).toArrow()
        return dict(zip(found["word"].to_pylist(), found["other"].to_pylist()))

    often = negative.orderBy(F.desc("other"), "word").limit(TRAIN_WORDS // 2).toArrow()
    return train(of, dict(zip(often["word"].to_pylist(), often["other"].to_pylist())), worst)


class ValueCache:
    """Decision values of distinct words in a worker, by their hash; bounded."""

    def __init__(self, most: int = 1_000_000):
        self.most = most
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, np.float32)

    def get(self, batch: Batch, words, compute) -> np.ndarray:
        hashes, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self.keys, self.values = self.keys[:0], self.values[:0]
        at = np.searchsorted(self.keys, hashes)
        new = np.ones(len(hashes), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != hashes[inside]
        if new.any():
            raw, f = batch.buffer.tobytes(), first[new]
            some = [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(words.start[f].tolist(), words.end[f].tolist())]
            values = np.concatenate([compute(some[k : k + SOME_WORDS]) for k in range(0, len(some), SOME_WORDS)])
            keys = np.concatenate([self.keys, hashes[new]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.values = keys[order], np.concatenate([self.values, values.astype(np.float32)])[order]
        return self.values[np.searchsorted(self.keys, hashes)][inverse]


_caches: dict[str, ValueCache] = {}


def _cache(version: str) -> ValueCache:
    if version not in _caches:
        _caches.clear()
        _caches[version] = ValueCache()
    return _caches[version]


def worst_words(rows: DataFrame, machine: Machine, version: str) -> DataFrame:
    """(doc_id, worst): the greatest decision value of a word of each text; the bias for texts without words."""

    def run(texts, batch):
        b = Batch.of(map(prepared, texts))
        words = b.words()
        out = np.full(len(texts), machine.bias)
        np.maximum.at(out, words.text_index(), _cache(version).get(b, words, machine.words) if len(words.hash) else np.zeros(0))
        return {"doc_id": batch.column("doc_id"), "worst": out}

    return map_texts(rows, "text", "doc_id long, worst double", run)


def toxicity(docs: DataFrame, labels: DataFrame, train_on, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of each document.  labels: doc_id, label (0 or 1); `train_on` is a condition on doc_id.

    Only rows that fulfil `train_on` are learnt from; null labels are passed over.  Null texts count as empty, and empty
    texts get the lowest score.  Rows that share an id are each scored by their own text, repeated rows alike; a text of any
    length is scored whole.  Without labels of both classes
    every score is 0.  Other columns are not read.  An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = labels.where("label is not null and doc_id is not null").where(train_on).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))
    machine = fit(rows, known)
    if machine is None:
        return rows.select("doc_id", F.lit(NO_LABELS).alias("score"))
    worst = materialize(worst_words(rows, machine, f"{id(machine)}-{machine.bias}"), "worst")
    bin_ = F.floor((F.least(F.greatest("worst", F.lit(-LIMIT)), F.lit(LIMIT)) + LIMIT) / (2 * LIMIT) * BINS)
    found = worst.join(known, "doc_id").groupBy(bin_.alias("bin")).agg(F.avg("label").alias("y"), F.count("*").alias("n")).orderBy("bin").toArrow()
    at = (found["bin"].to_numpy() + 0.5) / BINS * 2 * LIMIT - LIMIT
    machine.knots = (at, isotonic(found["y"].to_numpy(), found["n"].to_numpy()))

    def score(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(machine.score(batch.column("worst").to_numpy()))], names=["doc_id", "score"])

    return worst.mapInArrow(score, "doc_id long, score double")
