"""Interpolated modified Kneser-Ney bigram model, counted in Spark, stored as sorted hash arrays and asked through maps.

The corpus is tokenised once into parts: per part the sorted hashes of its distinct words and the stream of its tokens as
positions in them.  Each part sends its distinct bigrams, with their counts in training texts, to the shards of the model,
grouped by context.  A shard merges them into sorted hash arrays, which are stored in the shared folder, maps them and
answers each part by binary search in the map with the counts of exactly the bigrams that the part has.  The same goes for
words.  A worker that scores a part works out its probabilities from the answers.  No task and no machine holds the whole model.

`score_documents` stores the shards and asks them in the same pass, so that requests are shuffled once.  `fit` returns the
stored `Model` alone; `Model.score` scores any other texts from it, with requests to a shard dealt over as many copies of it
as there are texts for.  The map of a shard is a file without a name on the worker's disk, a working copy that goes with the
task; after a lost executor it is made again from the stored arrays or the requests.

Rows between parts and shards: one for each pair of them that has a bigram in common, which is never more than the distinct
bigrams of all parts, and in practice parts times shards.  Both sizes are parameters; a corpus that has many more than
10,000 of each wants larger ones, so that a row still holds hundreds of bigrams.

A word is told apart by 64 bits of its hash everywhere, and a bigram by 64 bits within its shard.  To keep the shuffle small a
request names its words once, as differences of sorted hashes, and its bigrams by positions among them.

Skew: counts are summed within parts before the shuffle, and bigrams of very frequent contexts - there can be HOT_WORDS at
most - are dealt out by context and word; their context totals are added up from the shards and broadcast.
"""

from __future__ import annotations

import tempfile
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, materialize
from .hashing import Batch, combine

END, BEGIN = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949C7DEFB9E5D31)
#: Tokens in a part, tokens for each bigram shard, and how many fewer word shards there are.
PART_TOKENS, SHARD_TOKENS, FEWER = 1_200_000, 2_800_000, 4
#: Contexts with more than 1/HOT_WORDS of all tokens are dealt out by context and word.
HOT_WORDS = 2000
PARTS = "part long, doc_id array<long>, held array<boolean>, size array<int>, words binary, stream binary, tokens long"


def _pack(x: np.ndarray) -> bytes:
    """Small integers, compressed byte by byte of their places."""
    x = np.ascontiguousarray(x)
    return zlib.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 1)


def _unpack(b: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(b), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


def _pack_hashes(x: np.ndarray) -> tuple[bytes, bytes]:
    """(the distinct hashes as differences in order, the place of each one among them)."""
    some, at = np.unique(x, return_inverse=True)
    return _pack(np.diff(some, prepend=np.uint64(0))), _pack(at.astype(np.uint32))


def _unpack_hashes(some: bytes, at: bytes) -> np.ndarray:
    return np.cumsum(_unpack(some, np.uint64), dtype=np.uint64)[_unpack(at, np.uint32)]


def parts(docs: DataFrame) -> DataFrame:
    """Tokenised parts of (doc_id, text, held)."""

    def flush(seq: int, ids, held, sizes, hashes) -> pa.RecordBatch:
        tokens = np.concatenate(hashes)
        words, stream, count = np.unique(tokens, return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")  # small numbers for frequent words
        words, stream = words[order], np.argsort(order)[stream]
        part = (TaskContext.get().partitionId() << 24) + seq
        columns = [pa.array([part], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([np.concatenate(sizes)], pa.list_(pa.int32()))]
        columns += [pa.array([words.tobytes()], pa.binary()), pa.array([_pack(stream.astype(np.int32))], pa.binary()), pa.array([len(stream)], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "held", "size", "words", "stream", "tokens"])

    def run(batches):
        seq, n, state = 0, 0, ([], [], [], [])
        for batch in chunks(batches, "text"):
            words = Batch.of(batch.column("text").to_pylist(), lower=True).words()
            hashes = np.insert(words.hash, words.first[1:], END)
            state[0].extend(batch.column("doc_id").to_pylist())
            state[1].extend(batch.column("held").to_pylist())
            state[2].append((words.counts + 1).astype(np.int32))
            state[3].append(hashes)
            n += len(hashes)
            if n >= PART_TOKENS:
                yield flush(seq, *state)
                seq, n, state = seq + 1, 0, ([], [], [], [])
        if n:
            yield flush(seq, *state)

    return docs.mapInArrow(run, PARTS)


@dataclass
class Part:
    """A part's arrays.  Contexts are positions in `words`; len(words) is the context at the beginning of a text."""

    doc_id: list
    held: np.ndarray
    size: np.ndarray
    words: np.ndarray
    stream: np.ndarray

    @classmethod
    def of(cls, row: dict) -> "Part":
        return cls(row["doc_id"], np.array(row["held"], bool), np.array(row["size"], np.int64), np.frombuffer(row["words"], np.uint64), _unpack(row["stream"], np.int32).astype(np.int64))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct context * (words + 1) + word in order, position of each token's pair in it, training count)."""
        n = len(self.words) + 1
        context = np.empty_like(self.stream)
        context[1:] = self.stream[:-1]
        context[np.cumsum(self.size) - self.size] = n - 1
        code, at = np.unique(context * n + self.stream, return_inverse=True)
        return code, at, np.bincount(at[self.training()], minlength=len(code))

    def training(self) -> np.ndarray:
        return ~np.repeat(self.held, self.size)

    def hashes(self) -> np.ndarray:
        return np.append(self.words, BEGIN)

    def shards(self, code: np.ndarray, shards: int, hot: np.ndarray) -> np.ndarray:
        n = len(self.words) + 1
        names = self.hashes()
        context, word = names[code // n], names[code % n]
        mixed = np.where(np.isin(context, hot), combine(context, word), context)
        return (combine(mixed, np.uint64(7)) % np.uint64(shards)).astype(np.int64)


def word_shards(words: np.ndarray, shards: int) -> np.ndarray:
    """The shards of words, given by their hashes."""
    return (combine(words, np.uint64(11)) % np.uint64(shards)).astype(np.int64)


def _rows(batches):
    for batch in batches:
        yield from batch.to_pylist()


def hot_words(table: DataFrame, tokens: int) -> np.ndarray:
    """Contexts with more than 1/HOT_WORDS of all tokens, among those with as great a share of some part."""

    def run(batches):
        for row in _rows(batches):
            part = Part.of(row)
            count = np.bincount(part.stream, minlength=len(part.words))
            often = np.flatnonzero(count * HOT_WORDS > len(part.stream) * 2)
            yield pa.RecordBatch.from_arrays([pa.array(part.words[often].view(np.int64)), pa.array(count[often], pa.int64())], names=["word", "n"])

    found = table.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") * HOT_WORDS > tokens)
    return np.unique(np.append(found.select("word").toArrow()["word"].to_numpy().view(np.uint64), BEGIN))


REQUEST = "shard long, part long, v binary, run binary, w binary, at binary, c binary"


def bigram_requests(table: DataFrame, shards: int, hot: np.ndarray) -> DataFrame:
    """Per part and shard: the part's distinct bigrams in order, with training counts."""

    def run(batches):
        for row in _rows(batches):
            part = Part.of(row)
            code, _, count = part.pairs()
            shard, n, names = part.shards(code, shards, hot), len(part.words) + 1, part.hashes()
            order = np.argsort(shard, kind="stable")
            edge = np.searchsorted(shard[order], np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(edge)).tolist():
                at = order[edge[s] : edge[s + 1]]
                if len(at):
                    context, run_ = np.unique(code[at] // n, return_counts=True)
                    words, places = _pack_hashes(names[code[at] % n])
                    columns = [[s], [row["part"]], [names[context].tobytes()], [_pack(run_.astype(np.uint32))], [words], [places], [_pack(count[at].astype(np.uint32))]]
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[2:])], names=["shard", "part", "v", "run", "w", "at", "c"])

    return table.mapInArrow(run, REQUEST)


ANSWER = "kind string, part long, shard long, a binary, b binary, stat array<long>"
STORED = ANSWER + ", model array<binary>"


def _answer(rows: list[tuple], stored: bool = False) -> pa.Table:
    """Rows of ANSWER, or of STORED, where those of the model have its arrays as well."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary())]
    names = ["kind", "part", "shard", "a", "b", "stat", "model"]
    return pa.table([pa.array([r[k] if k < len(r) else None for r in rows], t) for k, t in enumerate(kinds[: 6 + stored])], names=names[: 6 + stored])


def _sorted(x: np.ndarray) -> bytes:
    """Sorted hashes as differences."""
    return _pack(np.diff(x, prepend=np.uint64(0)))


def _unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b, np.uint64), dtype=np.uint64)


def lookup(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The values (one or a row of them for each key) of the hashes asked for, by binary search; 0 where there is no such key."""
    if not len(keys):
        return np.zeros((len(asked), *values.shape[1:]), values.dtype)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    out = np.array(values[at])
    out[keys[at] != asked] = 0
    return out


def _asked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A request's contexts, the number of bigrams of each, and the words of the bigrams."""
    return np.frombuffer(row["v"], np.uint64), _unpack(row["run"], np.uint32), _unpack_hashes(row["w"], row["at"])


def bigram_answers(rows: list[dict], asked: list, keys: np.ndarray, counts: np.ndarray, contexts: np.ndarray, stats: np.ndarray) -> list[tuple]:
    """For each request the counts of its bigrams and the statistics of its contexts."""
    out = []
    for row, (own, n, w) in zip(rows, asked):
        found = lookup(keys, counts, combine(np.repeat(own, n), w))
        out.append(("bigram", row["part"], row["shard"], _pack(found), _pack(lookup(contexts, stats, own).T), None))
    return out


def merge_bigrams(hot: np.ndarray, words_by: int):
    """The function of one bigram shard: merges requests into the shard to store, answers each part, passes on statistics."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        asked = [_asked(r) for r in rows]
        v, w = np.concatenate([np.repeat(v, n) for v, n, _ in asked]), np.concatenate([w for _, _, w in asked])
        c = np.concatenate([_unpack(r["c"], np.uint32) for r in rows]).astype(np.int64)
        known = c > 0
        v, w, c = v[known], w[known], c[known]
        key = combine(v, w)
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])[: len(key)])
        keys, total, sw, sv = key[order][first], np.add.reduceat(c[order], first) if len(first) else c, w[order][first], v[order][first]
        contexts, where = np.unique(sv, return_inverse=True)
        stats = np.column_stack([np.bincount(where, total, minlength=len(contexts)), *(np.bincount(where[t], minlength=len(contexts)) for t in (total == 1, total == 2, total > 2))]).astype(np.uint64)
        del v, w, c, key, order, first, sv, where, known
        out = [("model", None, rows[0]["shard"], None, None, None, [_sorted(keys), _pack(total.astype(np.uint64)), _sorted(contexts), _pack(stats)])]
        keys, contexts, counts = mapped([keys, contexts, total.astype(np.uint64)])
        out += bigram_answers(rows, asked, keys, counts, contexts, stats)
        out.append(("count", None, None, None, None, [int((total == k).sum()) for k in (1, 2, 3, 4)]))
        words, follows = np.unique(sw, return_counts=True)
        shard = word_shards(words, words_by)
        for s in np.unique(shard).tolist():
            out.append(("follows", None, s, words[shard == s].tobytes(), _pack(follows[shard == s].astype(np.uint32)), None))
        for k in np.flatnonzero(np.isin(contexts, hot)).tolist():
            out.append(("hot", int(contexts[k].view(np.int64)), None, None, None, stats[k].tolist()))
        return _answer(out, True)

    return run


def ask_bigrams(key, asked: pa.Table, stored: pa.Table) -> pa.Table:
    """Answers requests from a stored bigram shard; an absent one has no bigrams."""
    rows = asked.to_pylist()
    keys, counts, contexts, stats = stored["model"][0].as_py() if stored.num_rows else [_pack(np.zeros(0, np.uint64))] * 4
    arrays = mapped([_unpack_sorted(keys), _unpack(counts, np.uint64), _unpack_sorted(contexts)])
    return _answer(bigram_answers(rows, [_asked(r) for r in rows], *arrays, _unpack(stats, np.uint64).reshape(-1, 4)))


def word_requests(table: DataFrame, shards: int) -> DataFrame:
    def run(batches):
        for row in _rows(batches):
            part = Part.of(row)
            count = np.bincount(part.stream[part.training()], minlength=len(part.words))
            shard = word_shards(part.words, shards)
            order = np.argsort(shard, kind="stable")
            edge = np.searchsorted(shard[order], np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(edge)).tolist():
                at = order[edge[s] : edge[s + 1]]
                if len(at):
                    yield _answer([("word", row["part"], s, part.words[at].tobytes(), _pack(count[at].astype(np.uint32)), None)]).to_batches()[0]

    return table.mapInArrow(run, ANSWER)


def merge_words(table: pa.Table) -> pa.Table:
    """One word shard: training counts, and after how many different words each word was seen."""
    rows = [r for r in table.to_pylist()]
    asks, follows = [r for r in rows if r["kind"] == "word"], [r for r in rows if r["kind"] == "follows"]
    if not asks:
        return _answer([], True)
    w = np.concatenate([np.frombuffer(r["a"], np.uint64) for r in asks])
    c = np.concatenate([_unpack(r["b"], np.uint32) for r in asks]).astype(np.int64)
    words, at = np.unique(w, return_inverse=True)
    count = np.bincount(at, c, minlength=len(words)).astype(np.int64)
    after = np.zeros(len(words), np.int64)
    if follows:
        fw, fat = np.unique(np.concatenate([np.frombuffer(r["a"], np.uint64) for r in follows]), return_inverse=True)
        n = np.bincount(fat, np.concatenate([_unpack(r["b"], np.uint32) for r in follows])).astype(np.int64)
        place = np.minimum(np.searchsorted(fw, words), len(fw) - 1)
        after = np.where(fw[place] == words, n[place], 0)
    seen = count > 0
    out = [("model", None, asks[0]["shard"], None, None, None, [_sorted(words[seen]), _pack(count[seen].astype(np.uint64)), _pack(after[seen].astype(np.uint64))])]
    out += word_answers(asks, *mapped([words[seen], count[seen].astype(np.uint64), after[seen].astype(np.uint64)]))
    out.append(("total", None, None, None, None, [int(seen.sum()), int(count.sum()), int(after.sum()), *(int((after == k).sum()) for k in (1, 2, 3, 4)), int((after > 2).sum())]))
    return _answer(out, True)


def word_answers(rows: list[dict], keys: np.ndarray, counts: np.ndarray, follow: np.ndarray) -> list[tuple]:
    """For each request the counts of its words, and after how many different words each was seen."""
    asked = [np.frombuffer(r["a"], np.uint64) for r in rows]
    return [("word", r["part"], r["shard"], _pack(lookup(keys, counts, w)), _pack(lookup(keys, follow, w)), None) for r, w in zip(rows, asked)]


def ask_words(key, asked: pa.Table, stored: pa.Table) -> pa.Table:
    """Answers requests from a stored word shard; an absent one has no words."""
    keys, counts, follow = stored["model"][0].as_py() if stored.num_rows else [_pack(np.zeros(0, np.uint64))] * 3
    return _answer(word_answers(asked.to_pylist(), *mapped([_unpack_sorted(keys), _unpack(counts, np.uint64), _unpack(follow, np.uint64)])))


def discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more, from the numbers of types seen 1 to 4 times."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    d = [0.0, 1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.clip(d, 0, [0, 1, 2, 3])


@dataclass
class Totals:
    types: int  # V: distinct training tokens
    tokens: int  # N
    pairs: int  # distinct training bigrams
    bigram: np.ndarray  # discounts
    word: np.ndarray
    word_rest: float  # what the words' discounts leave for all words alike


def mapped(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """The arrays in a file without a name, memory-mapped; the file goes when the last array does."""
    out = []
    with tempfile.TemporaryFile() as f:
        for a in arrays:
            f.write(a.tobytes())
        f.flush()
        at = 0
        for a in arrays:
            out.append(np.memmap(f, a.dtype, "r", at, (len(a),)) if len(a) else a)
            at += a.nbytes
    return out


def score_part(part: Part, answers: list[dict], shards: int, words_by: int, hot: np.ndarray, hot_stats: np.ndarray, t: Totals) -> dict:
    """Scores of the texts of a part from its slice of the model."""
    code, at, _ = part.pairs()
    n = len(part.words) + 1
    shard, context = part.shards(code, shards, hot), code // n
    order = np.argsort(shard, kind="stable")
    edge = np.searchsorted(shard[order], np.arange(shards + 1))
    pair_count, stats = np.full(len(code), -1, np.int64), np.full((n, 4), 0, np.int64)
    for r in answers:
        if r["kind"] == "bigram":
            mine = order[edge[r["shard"]] : edge[r["shard"] + 1]]
            pair_count[mine] = _unpack(r["a"], np.uint64)
            stats[np.unique(context[mine])] = _unpack(r["b"], np.uint64).reshape(4, -1).T
    names = part.hashes()
    if len(hot):
        place = np.minimum(np.searchsorted(hot, names), len(hot) - 1)
        is_hot = hot[place] == names
        stats[is_hot] = hot_stats[place[is_hot]]
    word_shard = word_shards(part.words, words_by)
    count, after = np.full(n - 1, -1, np.int64), np.zeros(n - 1, np.int64)
    for r in answers:
        if r["kind"] == "word":
            mine = np.flatnonzero(word_shard == r["shard"])
            count[mine], after[mine] = _unpack(r["a"], np.uint64), _unpack(r["b"], np.uint64)
    if (pair_count < 0).any() or (count < 0).any():
        raise RuntimeError("a part of the model is missing")
    uniform = 1 / (t.types + 1)
    low = (after - t.word[np.minimum(after, 3)]) / t.pairs + t.word_rest * uniform if t.pairs else np.full(n - 1, uniform)
    seen = stats[:, 0] > 0
    total = np.maximum(stats[:, 0], 1)
    rest = np.where(seen, stats[:, 1:] @ t.bigram[1:] / total, 1.0)
    high = (pair_count - t.bigram[np.minimum(pair_count, 3)]) / total[context] + rest[context] * low[code % n]
    base = np.log10((count + 1) / (t.tokens + t.types + 1))
    log_high, known = np.log10(high), count > 0
    text = np.repeat(np.arange(len(part.size)), part.size)
    total_of = lambda x: np.bincount(text, x, minlength=len(part.size))
    return {
        "doc_id": pa.array(part.doc_id, pa.int64()), "held_out": pa.array(part.held), "n_tokens": pa.array(part.size, pa.int64()),
        "n_known": pa.array(total_of(known[part.stream]).astype(np.int64)), "train_tokens": pa.array(np.full(len(part.size), t.tokens, np.int64)),
        "base_score": pa.array(total_of(base[part.stream])), "score": pa.array(total_of(log_high[at])),
    }


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _spread(df: DataFrame, n: int, *key: str):
    """Groups of df by key, in n partitions or the session's number of them if that is more."""
    return df.repartition(int(max(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))), *key).groupBy(*key)


@dataclass
class Model:
    """A counted model: the arrays of its shards in two tables (shard, model), and what every task has of it."""

    bigrams: DataFrame
    words: DataFrame
    shards: int
    words_by: int
    hot: np.ndarray
    hot_stats: np.ndarray
    totals: Totals

    def save(self, path: str) -> None:
        """Write the model to a new folder of a store that Spark writes to."""
        self.bigrams.write.parquet(f"{path}/bigrams")
        self.words.write.parquet(f"{path}/words")
        t = self.totals
        head = (self.shards, self.words_by, self.hot.view(np.int64).tolist(), self.hot_stats.ravel().tolist(), t.types, t.tokens, t.pairs, t.bigram.tolist(), t.word.tolist(), t.word_rest)
        schema = "shards int, words_by int, hot array<long>, hot_stats array<long>, types long, tokens long, pairs long, bigram array<double>, word array<double>, word_rest double"
        self.bigrams.sparkSession.createDataFrame([head], schema).coalesce(1).write.parquet(f"{path}/head")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Model":
        h = spark.read.parquet(f"{path}/head").first()
        totals = Totals(h.types, h.tokens, h.pairs, np.array(h.bigram), np.array(h.word), h.word_rest)
        hot = np.array(h.hot, np.int64).view(np.uint64)
        return cls(spark.read.parquet(f"{path}/bigrams"), spark.read.parquet(f"{path}/words"), h.shards, h.words_by, hot, np.array(h.hot_stats, np.int64).reshape(-1, 4), totals)

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity of texts that need not be the counted ones.

        Null and empty texts have the end token alone; repeated rows are each scored; other columns are not read; an empty
        table gives an empty result.
        """
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.lit(True).alias("held"))
        table = materialize(parts(rows), "parts")
        tokens = _tokens(table)

        def asked(requests: DataFrame, stored: DataFrame, shards: int, most: int, answer) -> DataFrame:
            copies = int(tokens // (shards * most)) + 1
            left = requests.withColumn("copy", F.pmod(F.xxhash64("part"), F.lit(copies)))
            right = stored.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))
            sides = [_spread(side, shards * copies, "shard", "copy") for side in (left, right)]
            return sides[0].cogroup(sides[1]).applyInArrow(answer, ANSWER)

        bigrams = asked(bigram_requests(table, self.shards, self.hot), self.bigrams, self.shards, SHARD_TOKENS, ask_bigrams)
        words = asked(word_requests(table, self.words_by), self.words, self.words_by, SHARD_TOKENS * FEWER, ask_words)
        return _scored(table, tokens, bigrams.unionByName(words), self).drop("held_out")


def _tokens(table: DataFrame) -> int:
    return table.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]


def count(table: DataFrame, tokens: int) -> tuple[Model, DataFrame]:
    """The model of the training texts of parts, stored, and its answers to the parts."""
    shards = int(max(32, tokens // SHARD_TOKENS))
    words_by = max(8, shards // FEWER)
    hot = hot_words(table, tokens)
    stored = materialize(_spread(bigram_requests(table, shards, hot), shards, "shard").applyInArrow(merge_bigrams(hot, words_by), STORED), "bigrams")
    found = stored.drop("model")
    counts = found.where("kind = 'count'").agg(*[F.coalesce(F.sum(F.col("stat")[k]), F.lit(0)) for k in range(4)]).first()
    hot_rows = found.where("kind = 'hot'").groupBy("part").agg(*[F.sum(F.col("stat")[k]).alias(f"s{k}") for k in range(4)]).toArrow()
    hot_stats = np.zeros((len(hot), 4), np.int64)
    if hot_rows.num_rows:
        hot_stats[np.searchsorted(hot, hot_rows["part"].to_numpy().view(np.uint64))] = np.column_stack([hot_rows[f"s{k}"].to_numpy() for k in range(4)])
    asked = word_requests(table, words_by).unionByName(found.where("kind = 'follows'"))
    stored_words = materialize(_spread(asked, words_by, "shard").applyInArrow(merge_words, STORED), "words")
    words = stored_words.drop("model")
    s = words.where("kind = 'total'").agg(*[F.coalesce(F.sum(F.col("stat")[k]), F.lit(0)) for k in range(8)]).first()
    word_discounts = discounts(list(s[3:7]))
    rest = float(word_discounts[1:] @ [s[3], s[4], s[7]] / s[2]) if s[2] else 1.0
    totals = Totals(s[0], s[1], s[2], discounts(list(counts)), word_discounts, rest)
    arrays = [df.where("kind = 'model'").select("shard", "model") for df in (stored, stored_words)]
    return Model(*arrays, shards, words_by, hot, hot_stats, totals), found.where("kind = 'bigram'").unionByName(words.where("kind = 'word'"))


def _scored(table: DataFrame, tokens: int, answers: DataFrame, model: Model) -> DataFrame:
    """Scores of the texts of parts from the model's answers."""
    shards, words_by, hot, hot_stats, totals = model.shards, model.words_by, model.hot, model.hot_stats, model.totals

    def score(key, left: pa.Table, right: pa.Table) -> pa.Table:
        answers = right.to_pylist()
        return pa.concat_tables([pa.table(score_part(Part.of(row), answers, shards, words_by, hot, hot_stats, totals)) for row in left.to_pylist()])

    pieces = tokens // PART_TOKENS // 2
    scored = _spread(table, pieces, "part").cogroup(_spread(answers, pieces, "part")).applyInArrow(score, SCORES)
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def _parts(docs: DataFrame, held_out: Column, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return materialize(parts(rows.withColumn("held", F.coalesce(held_out, F.lit(True)))), "parts")


def fit(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of the documents that are not held out, as `score_documents` counts it."""
    table = _parts(docs, held_out, id_col, text_col)
    return count(table, _tokens(table))[0]


def score_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of each document.

    `held_out` is a condition on doc_id; where it holds the text is not learnt from (null: held out).  Null and empty texts
    have the end token alone.  Repeated rows are each counted and scored.  With nothing to learn from, every token has
    probability 1 / (0 + 1).  Words are told apart by 64 bits of their hashes.  Other columns are not read.  An empty table gives an empty result.
    """
    table = _parts(docs, held_out, id_col, text_col)
    tokens = _tokens(table)
    model, answers = count(table, tokens)
    return _scored(table, tokens, answers, model)
