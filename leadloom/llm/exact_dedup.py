"""Exact deduplication by cuckoo filters over content digests.

Each shard of the digest space has one cuckoo filter: 16-bit fingerprints in buckets of four slots.  Beside each slot lies
the content of its key, the whole digest, and a number; they move with the fingerprint.  A digest whose fingerprint is in
neither of its two buckets is new for certain and is inserted; a hit may be a false positive and is verified against the
content of its slot.  A removed digest leaves the filter.  When an insertion finds no place, the table doubles and is
refilled from the stored keys.

Skew: rows with one digest are merged inside every input partition before the shuffle, so a text that makes a third of
the corpus reaches its shard as a few rows per input partition.  When documents get their group's decision back, groups
larger than 1/HEAVY of the corpus - of which there can be HEAVY at most - are broadcast, all others are joined by digest.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Groups with more than 1/HEAVY of all rows are broadcast: never more than HEAVY rows.
HEAVY = 20_000
#: Rows of partial groups that a shard should hold, and digests that are merged at a time inside an input partition.
SHARD_ROWS = LOCAL_ROWS = 200_000
SLOTS, MAX_KICKS, KEY = 4, 200, 32


class CuckooFilter:
    """A cuckoo filter with the whole key and a number beside each fingerprint.

    Keys are digests of KEY random bytes.  `insert` and `delete` return whether they changed the set; `slot` is where a live
    key lies, or -1, and `numbers[slot]` is its number; slots hold until the next change.
    """

    def __init__(self, buckets: int = 1024):
        self._reset(1 << max(4, (buckets - 1).bit_length()))
        self.resizes = 0
        self.size = 0

    def _reset(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.marks = array("H", bytes(2 * buckets * SLOTS))
        self.content = bytearray(KEY * buckets * SLOTS)
        self.numbers = array("q", bytes(8 * buckets * SLOTS))

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "little") or 1
        first = int.from_bytes(key[2:10], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def may_contain(self, key: bytes) -> bool:
        """The fingerprints' own answer: no false negatives, a few false positives."""
        mark, a, b = self._places(key)
        return any(mark in self.marks[x * SLOTS : x * SLOTS + SLOTS] for x in (a, b))

    def slot(self, key: bytes) -> int:
        """Where a live key is: a hit of its fingerprint, verified against the content of the slot."""
        mark, a, b = self._places(key)
        for bucket in (a, b):
            for i in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.marks[i] == mark and self.content[i * KEY : i * KEY + KEY] == key:
                    return i
        return -1

    def __contains__(self, key: bytes) -> bool:
        return self.slot(key) >= 0

    def insert(self, key: bytes, number: int = 0) -> bool:
        if self.slot(key) >= 0:
            return False
        self.size += 1
        left = self._place(key, number)
        if left:
            self._grow(left)
        return True

    def _free(self, bucket: int) -> int:
        for i in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not self.marks[i]:
                return i
        return -1

    def _put(self, i: int, mark: int, key: bytes, number: int) -> None:
        self.marks[i], self.content[i * KEY : i * KEY + KEY], self.numbers[i] = mark, key, number

    def _place(self, key: bytes, number: int) -> tuple[bytes, int] | None:
        """Put a key that is not in the table; the key and number that found no place, if so, which may be others'."""
        mark, a, b = self._places(key)
        for bucket in (a, b):
            if (i := self._free(bucket)) >= 0:
                self._put(i, mark, key, number)
                return None
        bucket = b
        for kick in range(MAX_KICKS):
            i = bucket * SLOTS + (kick * 7 + mark) % SLOTS
            out = self.marks[i], bytes(self.content[i * KEY : i * KEY + KEY]), self.numbers[i]
            self._put(i, mark, key, number)
            mark, key, number = out
            bucket = self._other(bucket, mark)
            if (i := self._free(bucket)) >= 0:
                self._put(i, mark, key, number)
                return None
        return key, number

    def items(self) -> list[tuple[bytes, int]]:
        return [(bytes(self.content[i * KEY : i * KEY + KEY]), self.numbers[i]) for i, mark in enumerate(self.marks) if mark]

    def _grow(self, left: tuple[bytes, int]) -> None:
        """Double the table and refill it from the stored keys until every key has a place."""
        keys, buckets = [*self.items(), left], self.mask + 1
        while True:
            self.resizes += 1
            buckets *= 2
            self._reset(buckets)
            if all(self._place(k, n) is None for k, n in keys):
                return

    def delete(self, key: bytes) -> bool:
        i = self.slot(key)
        if i < 0:
            return False
        self._put(i, 0, bytes(KEY), 0)
        self.size -= 1
        return True

    def dump(self) -> tuple[bytes, bytes, bytes]:
        return self.marks.tobytes(), bytes(self.content), self.numbers.tobytes()

    @classmethod
    def load(cls, marks: bytes, content: bytes, numbers: bytes) -> "CuckooFilter":
        out = cls.__new__(cls)
        out.marks, out.content, out.numbers = array("H", marks), bytearray(content), array("q", numbers)
        out.mask, out.resizes = len(out.marks) // SLOTS - 1, 0
        out.size = sum(map(bool, out.marks))
        return out


def digest(text: str = "text"):
    """SHA-256 of the text in lower-case A-Z, as binary; null counts as empty."""
    return F.unhex(F.sha2(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), 256))


def text_digest(text: str | None) -> bytes:
    """The same digest for one text, in Python."""
    return hashlib.sha256((text or "").translate(str.maketrans(UPPER, LOWER)).encode()).digest()


def _merge(most: int | None):
    """Merge rows of one digest that meet in one partition, through a cuckoo filter; with `most` so many digests at a time."""

    def run(batches):
        seen, best, count, keys = CuckooFilter(), [], [], []

        def flush():
            for at in range(0, len(keys), 50_000):
                to = at + 50_000
                yield pa.RecordBatch.from_arrays([pa.array(keys[at:to], pa.binary()), pa.array(best[at:to], pa.int64()), pa.array(count[at:to], pa.int64())], names=["digest", "keep_id", "group_size"])

        for batch in batches:
            for key, doc, n in zip(batch["digest"].to_pylist(), batch["keep_id"].to_pylist(), batch["group_size"].to_pylist()):
                if seen.insert(key, len(keys)):
                    keys.append(key), best.append(doc), count.append(n)
                else:
                    i = seen.numbers[seen.slot(key)]
                    best[i] = doc if best[i] is None or (doc is not None and doc > best[i]) else best[i]
                    count[i] += n
            if most and len(keys) >= most:
                yield from flush()
                seen, best, count, keys = CuckooFilter(), [], [], []
        yield from flush()

    return run


def groups(digests: DataFrame, rows: int) -> DataFrame:
    """(digest, keep_id, group_size) of every different digest in (doc_id, digest)."""
    schema = "digest binary, keep_id long, group_size long"
    one = digests.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    local = one.mapInArrow(_merge(LOCAL_ROWS), schema)
    shards = max(digests.sparkSession.sparkContext.defaultParallelism, -(-rows // SHARD_ROWS))
    return local.repartition(shards, "digest").mapInArrow(_merge(None), schema)


def attach(base: DataFrame, found: DataFrame, rows: int) -> DataFrame:
    """base(doc_id, digest) with the columns of found(digest, keep_id, group_size), in which each digest is once.

    `rows` is the number of rows of base.  Large groups are broadcast, so that no digest's rows meet in one task.
    """
    return by_group(base, found, "digest", "group_size", rows // HEAVY).select("doc_id", "digest", "keep_id", "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; of equal texts the row with the largest id stays.  Null and
    empty texts are one text.  A null id counts in its group and loses to any other id; if a group has only null ids
    keep_id is null and no row of it is kept as such.  Rows repeated with one id are all returned; each is kept or dropped
    by its id.  Other columns of docs are not read.  An empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(text_col).alias("digest"))
    base = materialize(base, "digests")
    rows = base.count()
    found = materialize(groups(base, rows), "groups")
    both = attach(base, found, rows)
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False))
    return both.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


class CuckooIndex:
    """A persistent index of live digests: one row per shard with its cuckoo filter, as it is, and live rows as numbers.

    `insert` and `delete` take (doc_id, digest) rows and return a new index; a digest leaves the index when its last live
    row is deleted, and deleting what is not there changes nothing.  `lookup` marks which digests are live, by asking the
    shards' filters and verifying hits.  Null digests are passed over, and are not live.  The number of shards follows that
    of the digests: `insert` deals the index anew when shards outgrow SHARD_ROWS.
    """

    SCHEMA = "shard int, marks binary, content binary, numbers binary, size long"

    def __init__(self, table: DataFrame, shards: int):
        self.table, self.shards = table, shards

    @classmethod
    def empty(cls, spark, shards: int = 8) -> "CuckooIndex":
        return cls(spark.createDataFrame([], cls.SCHEMA), shards)

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(self.shards)).cast("int"))

    def _apply(self, rows: DataFrame, sign: int) -> "CuckooIndex":
        delta = rows.where("digest is not null").groupBy("digest").agg((F.count("*") * sign).alias("live"))
        merged = self.table.groupBy("shard").cogroup(self._dealt(delta).groupBy("shard")).applyInArrow(_change, self.SCHEMA)
        return CuckooIndex(materialize(merged, "cuckoo"), self.shards)

    def _resharded(self, shards: int) -> "CuckooIndex":
        def items(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    found = _filter(row).items()
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], names=["digest", "live"])

        new = CuckooIndex.empty(self.table.sparkSession, shards)
        rows = self.table.mapInArrow(items, "digest binary, live long")
        return CuckooIndex(materialize(new.table.groupBy("shard").cogroup(new._dealt(rows).groupBy("shard")).applyInArrow(_change, self.SCHEMA), "cuckoo"), shards)

    def insert(self, rows: DataFrame) -> "CuckooIndex":
        out = self._apply(rows, 1)
        size = out.table.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        return out if size <= out.shards * SHARD_ROWS else out._resharded(-(-2 * size // SHARD_ROWS))

    def delete(self, rows: DataFrame) -> "CuckooIndex":
        return self._apply(rows, -1)

    def lookup(self, rows: DataFrame) -> DataFrame:
        """doc_id, digest, live: whether a row with this digest is in the index.  Each digest is asked for once."""
        asked = rows.where("digest is not null").groupBy("digest").agg(F.count("*").alias("n"))

        def ask(key, left: pa.Table, right: pa.Table) -> pa.Table:
            keys = right["digest"].to_pylist()
            have = _filter(left.to_pylist()[0]) if left.num_rows else CuckooFilter(1)
            return pa.table({"digest": pa.array(keys, pa.binary()), "n": right["n"], "live": pa.array([k in have for k in keys], pa.bool_())})

        found = materialize(self.table.groupBy("shard").cogroup(self._dealt(asked).groupBy("shard")).applyInArrow(ask, "digest binary, n long, live boolean"), "lookup")
        both = by_group(rows.where("digest is not null").select("doc_id", "digest"), found, "digest", "n", rows.count() // HEAVY).select("doc_id", "digest", "live")
        return both.unionByName(rows.where("digest is null").select("doc_id", "digest", F.lit(False).alias("live")))


def _filter(row: dict) -> CuckooFilter:
    return CuckooFilter.load(row["marks"], row["content"], row["numbers"])


def _change(left: pa.Table, right: pa.Table) -> pa.Table:
    """A shard's filter after the changes of live rows."""
    seen = _filter(left.to_pylist()[0]) if left.num_rows else CuckooFilter()
    for key, n in zip(right["digest"].to_pylist(), right["live"].to_pylist()):
        i = seen.slot(key)
        if i < 0 and n > 0:
            seen.insert(key, n)
        elif i >= 0:
            seen.numbers[i] += n
            if seen.numbers[i] <= 0:
                seen.delete(key)
    shard = (left["shard"].to_pylist() or right["shard"].to_pylist())[0]
    parts = [pa.array([x], pa.binary()) for x in seen.dump()]
    return pa.table([pa.array([shard], pa.int32()), *parts, pa.array([seen.size], pa.int64())], names=["shard", "marks", "content", "numbers", "size"])
