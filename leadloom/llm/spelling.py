"""Spelling variants: words one edit apart, found by search schemes over a bidirectional FM-index of the vocabulary.

One inserted, deleted or replaced code point leaves one half of a word as it is.  So every word is searched twice: its first
half is matched exactly from the delimiter on and extended to the right with one error, and its second half is matched
exactly from the delimiter back and extended to the left.  The index has a text of all words between delimiters for each
of the two directions; a match is an interval of suffix ranks, and a step of all open searches at once is two binary
searches in the sorted (symbol, rank) pairs of the Burrows-Wheeler transform.

The vocabulary is dealt over shards, each with an index of its own.  As the half is matched exactly, a word can only have
near words in the shards of its half for the three lengths around its own, so it asks three shards a direction, however
many there are.  Halves that very many words share are dealt out by word as well, and asked in all of their shards.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialize, small_batches

#: Words have this many code points and occurrences at least; one whose near word has FORM times as many is a variant of it.
LENGTH, LEAST, FORM = 7, 2, 10
#: One run in so many loses a code point.
DELETED = 31
#: Words of a shard's index, distinct words that a task counts before it passes them on, and searches that are open at a time.
SHARD_WORDS, COUNTED, SEARCHES = 100_000, 200_000, 20_000
#: Intervals of more ranks are extended symbol by symbol of the alphabet, smaller ones rank by rank.
WIDE = 64
LETTERS = "A-Za-zÀ-ÿ"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: str, doc_id: str, length: int = LENGTH) -> Counter:
    """Occurrences of the words of one text: maximal runs of letters, some of them less one code point."""
    start, out = zlib.crc32(f"{doc_id}:".encode()), Counter()
    for run, n in Counter(re.findall(f"[{LETTERS}]{{{length},}}", text.translate(LOWER))).items():
        h = zlib.crc32(run.encode(), start)
        if h % DELETED == 0:
            run = run[: h % len(run)] + run[h % len(run) + 1 :]
        if len(run) >= length:
            out[run] += n
    return out


def word_counts(docs: DataFrame, least: int = LEAST, length: int = LENGTH) -> DataFrame:
    """word, n of all words of docs(doc_id, text), counted within tasks first."""

    def run(batches):
        seen: Counter = Counter()

        def put() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for batch in chunks(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                seen.update(words_of(text or "", doc_id, length))
            if len(seen) >= COUNTED:
                yield put()
                seen.clear()
        yield put()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Index:
    """FM-index of words, each ended by a delimiter of its own, that extends matches to the left.

    Symbols are 0 for delimiters and 1... for the code points in order.  For matches that extend to the right the words are
    given backwards.
    """

    def __init__(self, words: list[str]):
        flat = np.frombuffer("".join(w + "\0" for w in words).encode("utf-32-le"), "<u4")
        self.alphabet, text = np.unique(flat, return_inverse=True)
        text = text.astype(np.int64)
        ends = np.flatnonzero(text == 0)
        self.starts = np.concatenate([[0], ends[:-1] + 1])
        self.size = n = len(text)
        order, _ = suffixes(text, ends)
        before = text[order - 1]  # the first suffix has the last delimiter before it
        self.word_at = np.full(n, -1, np.int64)  # the word of each rank whose suffix is a whole word
        whole = before == 0
        self.word_at[whole] = np.searchsorted(self.starts, order[whole])
        self.bwt = before
        self.pairs = np.sort(before * n + np.arange(n))
        self.delimiters = len(ends)
        self.symbols = len(self.alphabet)

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the matches with one more symbol before them."""
        return np.searchsorted(self.pairs, symbol * self.size + low), np.searchsorted(self.pairs, symbol * self.size + high)

    def branches(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval number, symbol) of all symbols but delimiters that stand before some match of each interval."""
        wide = high - low > WIDE
        at = np.flatnonzero(~wide)
        size = (high - low)[at]
        owner = np.repeat(at, size)
        ranks = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low[at], size)
        code = np.unique(owner * self.symbols + self.bwt[ranks])
        far = np.flatnonzero(wide)
        code = np.concatenate([code, (far[:, None] * self.symbols + np.arange(self.symbols)).ravel()])
        code = code[code % self.symbols != 0]
        return code // self.symbols, code % self.symbols

    def encode(self, queries: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols of all queries, first place of each, its length); unknown code points are -1."""
        size = np.fromiter((len(q) for q in queries), np.int64, len(queries))
        flat = np.frombuffer("".join(queries).encode("utf-32-le"), "<u4")
        at = np.minimum(np.searchsorted(self.alphabet, flat), self.symbols - 1)
        return np.where(self.alphabet[at] == flat, at, -1), np.cumsum(size) - size, size


def suffixes(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, ranks) by prefix doubling; the delimiters at `ends` are all different, in order, and before all else."""
    n = len(text)
    rank = text + len(ends) - 1
    rank[ends] = np.arange(len(ends))
    open_ = np.setdiff1d(np.arange(n), ends, assume_unique=True)  # suffixes that share their rank with others
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    first = np.searchsorted(rank[order], np.arange(rank.max() + 1)) if n else rank
    rank = first[rank]  # a rank is the number of suffixes that are less
    h = 1
    while len(open_):
        key = rank[open_] * (n + 1) + rank[np.minimum(open_ + h, n - 1)]
        by = np.argsort(key, kind="stable")
        at, key = open_[by], key[by]
        new_class = np.append(True, key[1:] // (n + 1) != key[:-1] // (n + 1))
        new_key = np.append(True, key[1:] != key[:-1])
        place = np.arange(len(at))
        of_class, of_key = np.maximum.accumulate(np.where(new_class, place, 0)), np.maximum.accumulate(np.where(new_key, place, 0))
        fresh = rank[at] + of_key - of_class
        alone = new_key & np.append(new_key[1:], True)
        rank[at] = fresh
        open_ = at[~alone]
        h *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order, rank


def search(index: Index, queries: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) for each word that is one edit from a query with the query's last `exact` code points at its end.

    The edit lies before those code points.  An indexed word is found once for each query.
    """
    flat, first, size = index.encode(queries)
    found = []
    q = np.arange(len(queries))
    at = size.copy()  # code points of the query that are not matched yet
    low, high = np.zeros(len(q), np.int64), np.full(len(q), index.delimiters, np.int64)

    def extend(q, at, low, high, places):
        """Match the next code point of the query; open searches only."""
        symbol = flat[first[q] + at - 1] if len(q) else q
        fine = symbol > 0
        q, at, places, symbol = q[fine], at[fine] - 1, places[fine], symbol[fine]
        low, high = index.step(symbol, low[fine], high[fine])
        some = low < high
        return q[some], at[some], low[some], high[some]

    while len(q) and (more := at > size[q] - exact[q]).any():
        done = [x[~more] for x in (q, at, low, high)]
        now = extend(q[more], at[more], low[more], high[more], q[more])
        q, at, low, high = (np.concatenate(p) for p in zip(done, now))
    bad = [np.zeros(0, np.int64)] * 4  # searches with their error behind them
    while len(q) or len(bad[0]):
        bq, bat, blow, bhigh = bad
        whole = bat == 0
        if whole.any():  # of the matches, those that are whole words
            n = (bhigh - blow)[whole]
            ranks = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(blow[whole], n)
            word = index.word_at[ranks]
            found.append(np.stack([np.repeat(bq[whole], n), word])[:, word >= 0])
        left = ~whole
        bad = [extend(bq[left], bat[left], blow[left], bhigh[left], bq[left])]
        if len(q):
            owner, symbol = index.branches(low, high)
            l2, h2 = index.step(symbol, low[owner], high[owner])
            some = l2 < h2
            owner, symbol, l2, h2 = owner[some], symbol[some], l2[some], h2[some]
            bad.append((q[owner], at[owner], l2, h2))  # a code point that the query lacks
            other = (at[owner] > 0) & (symbol != flat[np.maximum(first[q[owner]] + at[owner] - 1, 0)])
            bad.append((q[owner[other]], at[owner[other]] - 1, l2[other], h2[other]))  # another code point
            lost = at > 0
            bad.append((q[lost], at[lost] - 1, low[lost], high[lost]))  # a code point that the word lacks
            q, at, low, high = extend(q[lost], at[lost], low[lost], high[lost], q[lost])
        bad = _distinct([np.concatenate(p) for p in zip(*bad)])
    pairs = np.unique(np.concatenate(found, 1), axis=1) if found else np.zeros((2, 0), np.int64)
    return pairs[0], pairs[1]


def _distinct(states: list[np.ndarray]) -> list[np.ndarray]:
    """Open searches, each once: the same letters in a row can be left out in several ways."""
    if len(states[0]) < 2:
        return states
    order = np.lexsort(states)
    new = np.append(True, np.any([s[order][1:] != s[order][:-1] for s in states], 0))
    return [s[order][new] for s in states]


def _keys(word: Column, backward: bool) -> tuple[Column, Column]:
    """(key of a word as one that is found, keys of a word as one that asks): length and the part of the half they share."""
    n, text = F.length(word), F.reverse(word) if backward else word
    part = lambda length: F.floor((length - (0 if backward else 1)) / 2).cast("int")
    key = lambda length: F.xxhash64(F.lit(backward), length, F.substring(text, F.lit(1), part(length)))
    lengths = F.array(*[n + d for d in (-1, 0, 1)])
    return key(n), F.transform(F.filter(lengths, lambda x: x >= LENGTH), key)


def near_words(vocabulary: DataFrame, least: int = FORM, shard_words: int = SHARD_WORDS) -> DataFrame:
    """word, n, n_near, and best(n, word): the near word of largest n, the first in code-point order of several.

    vocabulary(word, n) has each word once.
    """
    spark = vocabulary.sparkSession
    total = vocabulary.count()
    shards = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_words)))
    parts = []
    for backward in (False, True):
        key, asks = _keys(F.col("word"), backward)
        rows = vocabulary.select("word", "n", key.alias("key"))
        heavy = rows.groupBy("key").count().where(F.col("count") > shard_words).select("key", F.ceil(F.col("count") / shard_words).cast("int").alias("salts"))
        heavy = F.broadcast(materialize(heavy, "heavy"))  # total / shard_words rows at most
        salts = F.coalesce("salts", F.lit(1))
        shard = lambda salt: F.pmod(F.xxhash64("key", salt), F.lit(shards)).cast("int")
        held = rows.join(heavy, "key", "left").select(shard(F.pmod(F.xxhash64("word"), salts).cast("int")).alias("shard"), F.lit(backward).alias("backward"), "word", "n", F.lit(False).alias("asks"))
        asked = vocabulary.select("word", "n", F.explode(asks).alias("key")).join(heavy, "key", "left")
        asked = asked.select("word", "n", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "key").select(shard(F.col("salt")).alias("shard"), F.lit(backward).alias("backward"), "word", "n", F.lit(True).alias("asks"))
        parts += [held, asked.distinct()]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    schema = "word string, n_near long, n long, near string"
    found = rows.repartition(2 * shards, "shard", "backward").groupBy("shard", "backward").applyInArrow(_search_shard, schema)
    first = F.min(F.struct((-F.col("n")).alias("n"), F.col("near").alias("word")))
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("best"))
    near = near.select("word", "n_near", F.struct((-F.col("best.n")).alias("n"), F.col("best.word").alias("word")).alias("best"))
    return vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "best")


def _search_shard(table: pa.Table) -> pa.Table:
    """The near words that one shard and direction finds: their number for each word that asks, and the best of them."""
    backward = table["backward"][0].as_py()
    turn = (lambda w: w) if backward else (lambda w: w[::-1])  # the index extends to the left
    asks = table["asks"].to_numpy(zero_copy_only=False)
    words, n = table["word"].to_numpy(zero_copy_only=False), table["n"].to_numpy()
    held, held_n, queries = [turn(w) for w in words[~asks]], n[~asks], [turn(w) for w in words[asks]]
    out = []
    if held and queries:
        index = Index(held)
        for at in range(0, len(queries), SEARCHES):
            some = queries[at : at + SEARCHES]
            size = np.fromiter((len(q) for q in some), np.int64, len(some))
            exact = size - size // 2 if backward else size // 2
            query, word = search(index, some, exact)
            if backward:  # those whose first half fits too are found by the other direction
                new = np.fromiter((held[w][: size[q] // 2] != some[q][: size[q] // 2] for q, w in zip(query.tolist(), word.tolist())), bool, len(word))
                query, word = query[new], word[new]
            names = np.array([turn(held[w]) for w in word.tolist()], object)
            order = np.lexsort((np.unique(names.astype(str), return_inverse=True)[1], -held_n[word], query)) if len(word) else word
            head = np.flatnonzero(np.append(True, query[order][1:] != query[order][:-1])) if len(word) else word
            count = np.diff(np.append(head, len(order)))
            for q, w, c in zip(query[order][head].tolist(), order[head].tolist(), count.tolist()):
                out.append((turn(some[q]), c, int(held_n[word[w]]), names[w]))
    columns = list(zip(*out)) or [(), (), (), ()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "n", "near"])


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms(word, form): the last form, found by pointer doubling; each form is the more frequent word."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        now = materialize(now, "roots")
        after = now.select(F.col("word").alias("__w"), F.col("root").alias("__r"))
        now = now.join(after, F.col("root") == F.col("__w"), "left").select("word", F.coalesce("__r", "root").alias("root"), F.col("__r").isNotNull().alias("moved"))
        now = materialize(now, "roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = FORM) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts.

    Null and empty texts have no words; a null id counts as an empty one.  Repeated rows all count.  Texts and words may be
    of any length.  Other columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc_id"), F.col(text_col).alias("text"))
    vocabulary = materialize(word_counts(rows, least), "words")
    near = materialize(near_words(vocabulary), "near")
    is_form = F.col("best.n") >= times * F.col("n")
    near = near.select("word", "n", "n_near", F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, F.col("best.n")).alias("form_n"))
    last = roots(near.where("form is not null"))
    return near.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
