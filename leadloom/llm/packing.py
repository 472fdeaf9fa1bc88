"""Packing of tokenised documents into sequences of a fixed length by cutting-stock column generation.

Every document is tokenised and cut into full sequences and a remainder.  The histogram of piece lengths, in classes of
GRID tokens, has a fixed number of bars, however large the corpus.  On it a linear program over cutting patterns is
solved by column generation: a knapsack dynamic program prices new columns against the dual values of the lengths.
Patterns are rounded down, what they leave is packed greedily, and Spark assigns ranked pieces to the patterns' places.
"""

from __future__ import annotations

import functools
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts, materialize
from .hashing import Batch
from .tokens import store

LENGTH, GRID, END_ID = 2048, 4, 1
#: Pieces of one class that one task should rank.
RANK_ROWS = 20_000


@functools.cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode_words(texts: list[str | None], path: str) -> list[np.ndarray]:
    """Ids of each text.  The tokenizer drops white space and never merges over it, so distinct words are encoded once."""
    batch = Batch.of(texts)
    words = batch.words()

    def encode(some: list[bytes]) -> list[np.ndarray]:
        found = _tokenizer(path).encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in some], add_special_tokens=False)
        return [np.array(e.ids, np.int32) for e in found]

    ids, offset = store(path).encode(batch, words.start, words.end, encode)
    edge = offset[words.first]
    return [ids[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]


def pieces(docs: DataFrame, path: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Pieces of (doc_id, text): full sequences and the remainder of each document's ids with the end id."""

    def cut(texts, batch):
        doc, start, size, crc, total, ids = [], [], [], [], [], []
        for d, found in zip(batch.column("doc_id").to_pylist(), encode_words(texts, path)):
            all_ids = np.append(found, END_ID).astype("<u4")
            for at in range(0, len(all_ids), length):
                part = all_ids[at : at + length].tobytes()
                doc.append(d), start.append(at), size.append(len(part) // 4), crc.append(zlib.crc32(part)), total.append(len(all_ids))
                if with_ids:
                    ids.append(part)
        out = {"doc_id": pa.array(doc, pa.int64()), "start": start, "length": size, "ids_crc32": crc, "doc_tokens": total}
        return out | ({"ids": pa.array(ids, pa.binary())} if with_ids else {})

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids binary" if with_ids else "")
    return map_texts(docs, "text", schema, cut)


def best_pattern(value: np.ndarray, size: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the multiset of sizes within `room` of the greatest value, and its counts."""
    best, choice = np.zeros(room + 1), np.full(room + 1, -1)
    limits = np.searchsorted(size, np.arange(room + 1), side="right")
    for r in range(1, room + 1):
        best[r], choice[r] = best[r - 1], -1
        if limits[r]:
            total = best[r - size[: limits[r]]] + value[: limits[r]]
            k = int(total.argmax())
            if total[k] > best[r] + 1e-12:
                best[r], choice[r] = total[k], k
    counts, r = np.zeros(len(size), np.int64), room
    while r > 0:
        if choice[r] < 0:
            r -= 1
        else:
            counts[choice[r]] += 1
            r -= int(size[choice[r]])
    return float(best[room]), counts


def full_pattern(size: np.ndarray, open_: np.ndarray, room: int) -> np.ndarray:
    """Counts per size of a pattern with the largest open size that fills the room best, of as few pieces as can be."""
    some = np.flatnonzero(open_)
    sizes, largest = size[some], some[-1]
    least, choice = np.full(room + 1, np.inf), np.full(room + 1, -1)
    least[0] = 0
    limits = np.searchsorted(sizes, np.arange(room + 1), side="right")
    for r in range(1, room - int(size[largest]) + 1):
        if limits[r]:
            before = least[r - sizes[: limits[r]]]
            k = len(before) - 1 - int(before[::-1].argmin())
            least[r], choice[r] = before[k] + 1, k
    counts = np.zeros(len(size), np.int64)
    counts[largest] = 1
    r = int(np.flatnonzero(np.isfinite(least[: room - int(size[largest]) + 1]))[-1])
    while r > 0:
        counts[some[choice[r]]] += 1
        r -= int(sizes[choice[r]])
    return counts


def first_basis(size: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """A feasible basis and its inverse.

    Each pattern is used until it exhausts a size, which later patterns leave out; so the basis is triangular in the order
    of the exhausted sizes, and its inverse comes by substitution.
    """
    m, rest = len(size), demand.astype(float)
    columns, open_, order = np.diag(room // size).astype(np.int64), np.ones(m, bool), []
    while open_.any():
        counts = full_pattern(size, open_, room)
        used = np.flatnonzero(counts)
        ratio = rest[used] / counts[used]
        out = used[int(ratio.argmin())]
        columns[:, out] = counts
        rest = np.maximum(rest - ratio.min() * counts, 0)
        rest[out], open_[out] = 0, False
        order.append(out)
    lower, inverse = columns[np.ix_(order, order)].astype(float), np.eye(m)
    for k in range(m):
        inverse[k] /= lower[k, k]
        inverse[k + 1 :] -= np.outer(lower[k + 1 :, k], inverse[k])
    back = np.empty_like(inverse)
    back[np.ix_(order, order)] = inverse
    return columns, back


def solve_patterns(size: np.ndarray, demand: np.ndarray, room: int, steps: int = 2000) -> list[tuple[int, np.ndarray]]:
    """(times, counts per size) of patterns that together hold `demand` pieces of each size.

    Sizes ascend, 1 to `room`.  Column generation by the revised simplex method: the knapsack program prices a column
    against the duals; it enters if it is worth more than the sequence it costs.
    """
    m = len(size)
    if not m:
        return []
    columns, inverse = first_basis(size, demand, room)
    x = np.maximum((inverse * demand).sum(1), 0)
    for _ in range(steps):
        value, column = best_pattern(np.maximum(inverse.sum(0), 0), size, room)
        if value <= 1 + 1e-4:
            break
        d = (inverse * column).sum(1)
        ratio = np.full(m, np.inf)
        up = d > 1e-9
        ratio[up] = x[up] / d[up]
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        x = np.maximum(x - ratio[leave] * d, 0)
        x[leave] = ratio[leave]
        pivot = inverse[leave] / d[leave]
        inverse -= np.outer(d, pivot)
        inverse[leave] = pivot
        columns[:, leave] = column
    rest = demand.astype(np.int64).copy()
    out = []
    for k in np.argsort(-x, kind="stable"):
        used = columns[:, k] > 0
        times = int(min(np.floor(x[k] + 1e-6), (rest[used] // columns[used, k]).min()))
        if times > 0:
            out.append((times, columns[:, k].copy()))
            rest -= times * columns[:, k]
    while rest.any():
        space, counts = room, np.zeros(m, np.int64)
        for k in range(m - 1, -1, -1):
            counts[k] = min(rest[k], space // size[k])
            space -= counts[k] * size[k]
        used = counts > 0
        times = int((rest[used] // counts[used]).min())
        out.append((times, counts))
        rest -= times * counts
    return out


def places(patterns: list[tuple[int, np.ndarray]], size: np.ndarray) -> dict[int, np.ndarray]:
    """Per size: rows (first rank, copies in a sequence, first sequence) of the blocks of ranks that patterns take."""
    out: dict[int, list] = {int(s): [] for s in size}
    taken, sequence = np.zeros(len(size), np.int64), 0
    for times, counts in patterns:
        for k in np.flatnonzero(counts).tolist():
            out[int(size[k])].append((taken[k], counts[k], sequence))
            taken[k] += times * counts[k]
        sequence += times
    return {s: np.array(rows, np.int64).reshape(-1, 3) for s, rows in out.items()}


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, grid: int = GRID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids with `with_ids`).

    A document's ids and the end id are cut at multiples of `length`.  Null and empty texts have the end id alone.
    Repeated rows are packed each.  Other columns are not read.  An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    room = length // grid
    kind = F.ceil(F.col("length") / grid).cast("int")
    cut = materialize(pieces(rows, path, length, with_ids).withColumn("kind", kind), "pieces")
    histogram = cut.groupBy("kind").count().orderBy("kind").toArrow()
    size, demand = histogram["kind"].to_numpy().astype(np.int64), histogram["count"].to_numpy()
    blocks = places(solve_patterns(size, demand, room), size)

    salts = int(max(16, -(-demand.sum() // RANK_ROWS)))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    before = salted.groupBy("kind", "salt").count().withColumn("before", F.sum("count").over(Window.partitionBy("kind").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    order = Window.partitionBy("kind", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("in_salt", F.row_number().over(order)).join(before.drop("count"), ["kind", "salt"])
    ranked = ranked.withColumn("rank", F.coalesce("before", F.lit(0)) + F.col("in_salt") - 1).drop("salt", "before", "in_salt")

    def assign(batches):
        for batch in batches:
            which, rank = batch.column("kind").to_numpy(), batch.column("rank").to_numpy()
            sequence = np.empty(len(rank), np.int64)
            for k in np.unique(which):
                block, at = blocks[int(k)], np.flatnonzero(which == k)
                b = block[np.searchsorted(block[:, 0], rank[at], side="right") - 1]
                sequence[at] = b[:, 2] + (rank[at] - b[:, 0]) // b[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence)], names=[*batch.schema.names, "sequence_id"])

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else []), "kind", "rank"]
    schema = ", ".join(f"{c} {t}" for c, t in ranked.select(names).dtypes) + ", sequence_id long"
    placed = ranked.select(names).mapInArrow(assign, schema)
    earlier = Window.partitionBy("sequence_id").orderBy(F.desc("kind"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))).drop("kind", "rank")
