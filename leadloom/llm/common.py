"""Helpers shared by the operators: shared scratch tables, folds of labels, and bounded chunks of texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a task holds as numpy arrays at a time; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Rows that Spark sends to a Python worker at a time, where the session has its default of 10,000: texts are long rows.
BATCH_ROWS, DEFAULT_ROWS = 1000, "10000"
#: Rows of ids, 8 to 40 bytes each, that may be broadcast.
SMALL_IDS = 500_000


def scratch(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir, which all machines share.

    Only where that setting is missing on a local master, as in tests, a temporary folder is made and set for the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the scratch folder and read it back: cuts lineage, survives lost executors, computes df once."""
    path = f"{scratch(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_group(rows: DataFrame, groups: DataFrame, key: str, size: str, limit: int) -> DataFrame:
    """Inner join of rows with groups, which has each key once, so that the rows of a large group do not meet in one task.

    groups[size] is the number of rows of a group.  Groups larger than `limit` are broadcast: with N rows in all there are
    N / limit of them at most.  The others are joined by a shuffle, in which no key has more than `limit` rows.
    """
    more = [c for c in groups.columns if c != key]
    heavy = F.broadcast(groups.where(F.col(size) > limit).select(key, F.struct(*more).alias("__group")))
    marked = rows.join(heavy, key, "left")
    hot = marked.where("__group is not null").select(*rows.columns, "__group.*")
    rest = marked.where("__group is null").select(*rows.columns)
    rest = rest.join(groups.where(F.col(size) <= limit).hint("merge"), key).select(*rows.columns, *more)
    return hot.unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices that hold about `limit` bytes of text each, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < len(sizes):
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def small_batches(spark: SparkSession) -> None:
    """Set the session to BATCH_ROWS rows an Arrow batch, unless it has a number of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == DEFAULT_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_texts(df: DataFrame, text: str, schema: str, f: Callable, limit: int = CHUNK_BYTES) -> DataFrame:
    """mapInArrow with bounded chunks: f(texts, batch) returns a dict of columns in the order of `schema`."""
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches):
        for batch in chunks(batches, text, limit):
            out = f(batch.column(text).to_pylist(), batch)
            if out is not None:
                yield pa.RecordBatch.from_arrays([_arrow(out[n]) for n in names], names=names)
        pa.default_memory_pool().release_unused()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def filter_texts(df: DataFrame, text: str, keep: Callable, limit: int = CHUNK_BYTES) -> DataFrame:
    """The rows of df, all columns as they are, for which keep(texts) is true; rows stay where they lie."""

    def run(batches):
        for batch in chunks(batches, text, limit):
            yield batch.filter(pa.array(np.asarray(keep(batch.column(text).to_pylist()), bool)))
        pa.default_memory_pool().release_unused()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, df.schema)


def sized(ids: DataFrame) -> DataFrame:
    """ids, a narrow table read from scratch, for a join: broadcast if it has SMALL_IDS rows at most, else merged."""
    return F.broadcast(ids) if ids.limit(SMALL_IDS + 1).count() <= SMALL_IDS else ids.hint("merge")


def _arrow(values):
    return values if isinstance(values, (pa.Array, pa.ChunkedArray)) else pa.array(values)


def sums(index: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Totals per text; counts when there are no weights."""
    return np.bincount(index, weights, minlength=n)


def distinct_per_text(text: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each text has."""
    from .hashing import combine

    if not len(hashes):
        return np.zeros(n, np.int64)
    key = combine(text.astype(np.uint64), hashes)
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    return np.bincount(text[order[new]], minlength=n)


def in_repeats(text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: does its hash occur twice or more in its text; is it a second or later occurrence."""
    from .hashing import combine

    twice, later = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    if len(hashes):
        key = combine(text.astype(np.uint64), hashes)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        later[order[1:][same]] = True
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
    return twice, later
