"""Exact integer k-means over a VA-file: few-bit cells stand for vectors until distance intervals overlap.

Every dimension is cut into 2**BITS cells, whose bounds come from statistics of all vectors; the outer cells end at the
true extremes.  One table holds each vector's cells beside its components.  A round reads the cells alone: tables of 2**BITS
entries a dimension give an interval of the squared distance to each centroid, and where these overlap, of the difference of
two distances, which is linear in the vector and so much narrower.  A vector whose centroid is certain in this round and the
last, and is the same, changes no sum.  All others are fetched: the components are read where the interval was not decisive,
distances are computed exactly to the centroids that are left, and the sums of the clusters change by what moved.

The table is sorted by the first centroid and by how much nearer it is than the second, so what is still open lies together
and Parquet skips the pages and row groups of the rest.  Rounds are stateless but for centroids and sums, 8 x 64 numbers on
the driver: whether a vector moved follows from its cells or components and the centroids before and after.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Bits of a cell's number; a number takes one byte in the table.
BITS = 6
#: Inner cells cover so many standard deviations on each side of the mean.
SPREAD = 2.5
#: Components are held within this bound, x within 2**17, so that squared distances fit a long.
BOUND = 1 << 27


def quantised(embedding: Column, dimensions: int = DIMENSIONS, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component x as a double; null unless there are `dimensions` components, all of them finite."""
    x = embedding.cast("array<double>")
    fine = (F.size(x) == dimensions) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    held = lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(float(BOUND))), F.lit(-float(BOUND)))).cast("int")
    return F.when(fine, F.transform(x, held))


def _matrix(column: pa.Array, kind=np.int32) -> np.ndarray:
    """The rows of a binary column, all of one length, as a matrix."""
    n = len(column)
    raw = np.frombuffer(b"".join(column.to_pylist()), kind)
    return raw.reshape(n, -1) if n else raw.reshape(0, 0)


def _binary(matrix: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in matrix], pa.binary())


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances."""
    return np.stack([np.square(vectors - c).sum(1) for c in centroids], 1) if len(centroids) else np.zeros((len(vectors), 0), np.int64)


class Cells:
    """The bounds of the cells of each dimension: low and high are matrices of dimension by cell."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, least: np.ndarray, most: np.ndarray, bits: int = BITS):
        steps = np.linspace(-SPREAD, SPREAD, (1 << bits) - 1)
        self.cuts = np.floor(mean[:, None] + deviation[:, None] * steps).astype(np.int64)
        self.low = np.hstack([least[:, None], self.cuts]).astype(np.int64)
        self.high = np.hstack([self.cuts - 1, most[:, None]]).astype(np.int64)

    def of(self, vectors: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(cuts, x, side="right") for cuts, x in zip(self.cuts, vectors.T)], 1).astype(np.uint8)


class Bounds:
    """Lookup tables of one set of centroids."""

    def __init__(self, cells: Cells, centroids: np.ndarray):
        low, high = cells.low, cells.high
        self.centroids = centroids
        c = centroids[:, :, None]
        self.near = np.square(np.maximum(0, np.maximum(low - c, c - high)))
        self.far = np.square(np.maximum(np.abs(low - c), np.abs(high - c)))
        self.dims = np.arange(low.shape[0])
        self.ends = low, high

    def _sum(self, table: np.ndarray, cells: np.ndarray) -> np.ndarray:
        out = np.zeros(len(cells), np.int64)
        for d in self.dims:
            out += table[d][cells[:, d]]
        return out

    def candidates(self, cells: np.ndarray) -> np.ndarray:
        """Matrix of vector by centroid: may this centroid be the nearest?  One at least is."""
        k = len(self.centroids)
        low, high = (np.stack([self._sum(t[i], cells) for i in range(k)], 1) for t in (self.near, self.far))
        out = low <= high.min(1)[:, None]
        best = high.argmin(1)
        open_ = out.sum(1) > 1
        for j in range(k):  # against the centroid with the least upper end: c_i^2 - c_j^2 - 2 x (c_i - c_j)
            for i in range(k):
                rows = np.flatnonzero(open_ & (best == j) & out[:, i]) if i != j else ()
                if len(rows):
                    a, b = self.centroids[i][:, None], self.centroids[j][:, None]
                    at = [a * a - b * b - 2 * x * (a - b) for x in self.ends]
                    out[rows, i] = self._sum(np.minimum(*at), cells[rows]) <= 0
        return out

    def nearest(self, vectors: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance), exact over the candidates; of equal ones the smaller number."""
        at = np.full(len(vectors), -1)
        best = np.full(len(vectors), np.iinfo(np.int64).max)
        for k, c in enumerate(self.centroids):
            rows = np.flatnonzero(candidates[:, k])
            d = np.square(vectors[rows] - c).sum(1)
            less = d < best[rows]
            best[rows[less]], at[rows[less]] = d[less], k
        return at, best


def _sums(at: np.ndarray, vectors: np.ndarray, sign: int, into: np.ndarray) -> None:
    """Add the vectors of each cluster to its row of `into`, their number in the last column."""
    for k in np.unique(at).tolist():
        some = vectors[at == k]
        into[k, :-1] += sign * some.sum(0)
        into[k, -1] += sign * len(some)


def _total(parts: DataFrame, k: int, width: int) -> np.ndarray:
    """Partition sums (cluster, place, value) added up: a matrix of Python integers."""
    out = np.zeros((k, width), object)
    for row in parts.groupBy("cluster", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
        out[row["cluster"], row["place"]] = int(row["value"])
    return out


def _sum_rows(total: np.ndarray) -> pa.RecordBatch:
    cluster, place = np.nonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(place), pa.array(total[cluster, place])], names=["cluster", "place", "value"])


SUMS = "cluster long, place long, value long"


def _statistics(vectors: DataFrame, dimensions: int, bits: int) -> Cells:
    """Cells from the mean, deviation and extremes of each dimension over all vectors."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("vector")).astype(np.float64)
                columns = [np.arange(dimensions), np.full(dimensions, len(x)), x.sum(0), np.square(x).sum(0), x.min(0), x.max(0)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.float64)) for c in columns], names=["d", "n", "s", "q", "least", "most"])

    parts = vectors.select("vector").mapInArrow(run, "d double, n double, s double, q double, least double, most double")
    found = parts.groupBy("d").agg(F.sum("n"), F.sum("s"), F.sum("q"), F.min("least"), F.max("most")).orderBy("d").toArrow()
    n, s, q, least, most = (found.column(i).to_numpy() for i in range(1, 6))
    mean = s / n
    return Cells(mean, np.sqrt(np.maximum(1.0, q / n - mean * mean)), least, most, bits)


def va_file(vectors: DataFrame, cells: Cells, first: np.ndarray) -> DataFrame:
    """The table of vec_id, vector, cells, with `near`, the nearest of the first centroids, and `margin` to the second."""

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("vector")).astype(np.int64).reshape(batch.num_rows, -1)
            d = distances(x, first)
            two = np.sqrt(np.sort(d, 1)[:, :2])
            margin = two[:, 1] - two[:, 0] if d.shape[1] > 1 else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), _binary(cells.of(x)), pa.array(d.argmin(1)), pa.array(margin)], names=["vec_id", "vector", "cells", "near", "margin"])

    made = vectors.mapInArrow(run, "vec_id long, vector binary, cells binary, near long, margin double")
    return materialize(made.sortWithinPartitions("near", "margin"), "vafile")


def _moves(old: Bounds, new: Bounds, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(candidates before, candidates now, is the vector itself needed to know what it does to the sums)."""
    before, now = old.candidates(cells), new.candidates(cells)
    return before, now, (before.sum(1) > 1) | (now.sum(1) > 1) | (before.argmax(1) != now.argmax(1))


def _changes(file: DataFrame, old: Bounds, new: Bounds, k: int, dimensions: int) -> np.ndarray:
    """What the sums and counts of the clusters change by when the centroids `old` give way to `new`."""

    def open_(batches):
        for batch in batches:
            if batch.num_rows:
                at = np.flatnonzero(_moves(old, new, _matrix(batch.column("cells"), np.uint8))[2])
                near, margin = (batch.column(c).to_numpy()[at] for c in ("near", "margin"))
                some = np.unique(near)
                most = [margin[near == c].max() for c in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(most, pa.float64())], names=["near", "margin"])

    def moved(batches):
        total = np.zeros((k, dimensions + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                before, now, need = _moves(old, new, _matrix(batch.column("cells"), np.uint8))
                at = np.flatnonzero(need)
                x = _matrix(batch.column("vector").take(pa.array(at))).astype(np.int64).reshape(len(at), dimensions)
                a, b = old.nearest(x, before[at])[0], new.nearest(x, now[at])[0]
                went = a != b
                _sums(a[went], x[went], -1, total)
                _sums(b[went], x[went], 1, total)
        yield _sum_rows(total)

    where = file.select("near", "margin", "cells").mapInArrow(open_, "near long, margin double").groupBy("near").agg(F.max("margin").alias("margin")).collect()
    if not where:
        return np.zeros((k, dimensions + 1), object)
    needed = reduce(lambda a, b: a | b, [(F.col("near") == row["near"]) & (F.col("margin") <= row["margin"]) for row in where])
    return _total(file.where(needed).select("cells", "vector").mapInArrow(moved, SUMS), k, dimensions + 1)


def centroid_clustering(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED, bits: int = BITS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector that is kept.

    Kept are vectors with `dimensions` components, none null or non-finite; components x become floor(scale * x), held within
    BOUND.  Centroids start as the vectors of least sha256 of '<seed>:<id>'; of one hash the lesser vector comes first, and a
    null id comes last.  Fewer vectors than `clusters` give fewer centroids.  Repeated rows are vectors of their own; other
    columns are not read; an empty table gives an empty result.  An inertia beyond a long is null.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), dimensions, scale).alias("__v")).where("__v is not null")

    def pack(batches):
        for batch in batches:
            flat = batch.column("__v").flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), _binary(flat.reshape(-1, dimensions))], names=["vec_id", "vector"])

    start = rows.orderBy(digest.asc_nulls_last(), "__v").limit(clusters).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not start:
        return vectors.sparkSession.createDataFrame([], schema)
    packed = rows.mapInArrow(pack, "vec_id long, vector binary")
    now, k = np.array([r["__v"] for r in start], np.int64), len(start)
    cells = _statistics(packed, dimensions, bits)
    file = va_file(packed, cells, now)

    def first(batches):
        total = np.zeros((k, dimensions + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                _sums(batch.column("near").to_numpy(), _matrix(batch.column("vector")).astype(np.int64), 1, total)
        yield _sum_rows(total)

    sums = _total(file.select("near", "vector").mapInArrow(first, SUMS), k, dimensions + 1)
    for r in range(rounds):
        before = now
        now = np.array([[s // row[-1] for s in row[:-1]] if row[-1] else c for row, c in zip(sums.tolist(), before.tolist())], np.int64)
        if (before == now).all():  # nothing moves any more
            break
        if r < rounds - 1:
            sums = sums + _changes(file, Bounds(cells, before), Bounds(cells, now), k, dimensions)
    bounds = Bounds(cells, now)

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("vector")).astype(np.int64)
                at, d = bounds.nearest(x, bounds.candidates(_matrix(batch.column("cells"), np.uint8)))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(at, pa.int32()), pa.array(d, pa.int64())], names=["vec_id", "cluster", "distance"])

    found = materialize(file.select("vec_id", "vector", "cells").mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda x: x if x < 1 << 63 else None
    shown = [(c, fits(inertia[c]), fits(sum(inertia.values())), hashlib.sha256(",".join(map(str, now[c].tolist())).encode()).hexdigest()) for c in sorted(inertia)]
    clusters_ = vectors.sparkSession.createDataFrame(shown, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(clusters_), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
