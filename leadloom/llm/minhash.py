"""Near-duplicate detection by BagMinHash signatures over word-shingle multisets, banding and exact verification.

A text is the multiset of its five-word shingles.  The weight axis of a shingle is discretised at the integers and split
into shells [0,1), [1,2), [2,4), [4,8) ...  Each shell has its own Poisson process of points with rate equal to its width;
a point has an arrival time, a place on the weight axis and one of the signature's components.  A shingle of weight c sees
the points placed below c, and each component of the signature keeps the earliest point that any shingle sees.  Two texts
agree in a component with a probability of exactly their weighted Jaccard similarity.  The last shell of a weight is thinned by place, so
the work grows with the logarithm of a weight; points after the time at which all components are filled are not drawn.

Texts with equal words are one class and go on as one representative.  Bands of the signature give buckets.  In small
buckets all pairs are candidates.  In large ones every text is compared with the bucket's leader, the text with the most
texts beside it over all bands, which for copies of one text is the text itself.  Candidates are verified on the multisets.

Large buckets that then still hold several components are completed exactly.  For a text u write u = L - R + A against
the bucket's leader L.  Two texts have |L| - |R_u| - |R_v| + |R_u & R_v| + |A_u & A_v| shingles in common, and at most as
many of R and A in common as of each occur with other texts too, or as their bitmaps share.  So a number `e` and a number
`cap` of every text rule a pair out unless e_u <= cap_v and e_v <= cap_u, and so does a count of common bits.  Texts that
no member of their bucket can link to leave at once; while many pairs are left, further leaders are elected; the pairs
that remain are verified.  Nothing that may be a link is left out: all that is lost is what no band of the signatures finds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, map_texts, materialize, sized
from .components import components
from .exact_dedup import attach
from .hashing import Batch, Words, combine, mix

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
COMPONENTS = BANDS * ROWS
#: Share of the shingles of two texts that a link has in common.
COMMON = SIMILARITY / (1 + SIMILARITY)
#: Buckets up to this size give all pairs.
SMALL = 16
#: Buckets with more than 1/HEAVY of all (text, bucket) rows are joined by broadcast: never more than HEAVY rows.
HEAVY = 20_000
#: Texts of a large bucket that one task compares with its others.
SALTED = 256
#: Rounds in which texts outside the main components elect further leaders.
ROUNDS = 4
#: Integers of 64 bits in the bitmap of a text's differences from its leader.
MAPS = 8
MAP_NAMES = [f"m{k}" for k in range(MAPS)]
#: Points are drawn up to the time at which all components are filled but for a probability of exp(-SLACK).
SLACK = 7.0
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)
NO_WORDS = np.uint64(0x2545F4914F6CDD1D)


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all shingles with repeats.  A text of fewer words has one shingle, of all its words."""
    h, _, text = words.windows(SHINGLE)
    few = np.flatnonzero(words.counts < SHINGLE)
    lone = np.full(len(few), NO_WORDS)
    for k in range(SHINGLE - 1):
        has = words.counts[few] > k
        lone[has] = combine(lone[has], words.hash[words.first[few[has]] + k])
    return np.concatenate([text, few]), np.concatenate([h, lone])


def multiset(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the different shingles of each text."""
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(new)
    return text[first], h[first], np.diff(np.append(first, len(h)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(text: np.ndarray, h: np.ndarray, count: np.ndarray, n: int, m: int = COMPONENTS) -> np.ndarray:
    """An n x m matrix of unsigned integers; every text has a shingle.  Equal entries mean the same earliest point."""
    owner, key, width, cover = [text], [combine(h, np.uint64(0))], [np.ones(len(h))], [np.ones(len(h))]
    start, shell = 1, 1
    while (more := np.flatnonzero(count > start)).size:
        owner.append(text[more])
        key.append(combine(h[more], np.uint64(shell)))
        width.append(np.full(len(more), float(start)))
        cover.append(np.minimum(count[more] - start, start).astype(float))
        start, shell = start * 2, shell + 1
    owner, key, width, cover = map(np.concatenate, (owner, key, width, cover))
    total = np.maximum(np.bincount(text, count, minlength=n), 1)
    until = m / total * (np.log(m) + SLACK)
    out = np.full(n * m, NEVER)
    todo = np.ones(n, bool)
    while todo.any():
        some = np.flatnonzero(todo[owner])
        own, k, wide, part, time, point = owner[some], key[some], width[some], cover[some], np.zeros(len(some)), 0
        while len(own):
            point += 1
            draw = combine(k, np.uint64(point))
            time = time - np.log(_uniform(draw)) / wide
            live = time <= until[own]
            own, k, wide, part, time, draw = own[live], k[live], wide[live], part[live], time[live], draw[live]
            second = mix(draw ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            seen = _uniform(mix(second)) * wide < part
            cell = own[seen] * m + (second[seen] % np.uint64(m)).astype(np.int64)
            value = (time[seen].view(np.uint64) & ~np.uint64(0xFFFFFF)) | (draw[seen] & np.uint64(0xFFFFFF))
            np.minimum.at(out, cell, value)
        todo = (out.reshape(n, m) == NEVER).any(1)
        until[todo] *= 3
    return out.reshape(n, m)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """An n x BANDS matrix of bucket keys."""
    n = len(signature)
    parts = signature.reshape(n, BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (n, BANDS))
    for k in range(ROWS):
        key = combine(key, parts[:, :, k])
    return key


def _sketch(texts, batch) -> dict:
    words = Batch.of(texts, lower=True).words()
    n = len(texts)
    text, h = shingles(words)
    signature = signatures(*multiset(text, h), n)
    keys = band_keys(signature)
    # the words in order, as 128 bits: two sums of hashed (word, place)
    place = (np.arange(len(words.hash)) - np.repeat(words.first[:-1], words.counts)).astype(np.uint64)
    whole = np.zeros((n, 2), np.uint64)
    for k in (0, 1):
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(combine(words.hash, combine(place, np.uint64(k))), dtype=np.uint64)])
            whole[:, k] = combine(total[words.first[1:]] - total[words.first[:-1]], words.counts.astype(np.uint64))
    return {
        "doc_id": batch.column("doc_id"),
        "digest": pa.array([row.tobytes() for row in whole], pa.binary()),
        "bands": pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())),
    }


def _multisets(texts, batch) -> dict:
    text, h = shingles(Batch.of(texts, lower=True).words())
    order = np.lexsort((h, text))
    edge = np.searchsorted(text[order], np.arange(len(texts) + 1))
    sorted_ = h[order]
    return {"doc_id": batch.column("doc_id"), "bag": pa.array([sorted_[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])], pa.binary())}


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two sorted arrays of shingle hashes."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if min(len(x), len(y)) < 0.5 * max(len(x), len(y)):
        return min(len(x), len(y)) / max(len(x), len(y))  # an upper bound
    both = np.sort(np.concatenate([x, y]), kind="stable")
    edge = np.flatnonzero(both[1:] != both[:-1]) + 1
    kinds = both[np.concatenate([[0], edge])]
    in_x = np.searchsorted(x, kinds, "right") - np.searchsorted(x, kinds, "left")
    in_y = np.searchsorted(y, kinds, "right") - np.searchsorted(y, kinds, "left")
    return np.minimum(in_x, in_y).sum() / np.maximum(in_x, in_y).sum()


def verify(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """The pairs (a, b) whose multisets are similar enough."""

    def run(batches):
        for batch in batches:
            ok = [similarity(x, y) >= SIMILARITY for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    left = pairs.join(bags.select(F.col("doc_id").alias("a"), F.col("bag").alias("x")), "a")
    both = left.join(bags.select(F.col("doc_id").alias("b"), F.col("bag").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _pairs(batches):
    """All pairs (a < b) of the texts of small buckets."""
    for batch in batches:
        a, b = [], []
        for docs in batch.column("docs").to_pylist():
            for step in range(1, len(docs)):
                a += docs[:-step]
                b += docs[step:]
        x, y = np.array(a, np.int64), np.array(b, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def differences(ends: DataFrame, bags: DataFrame) -> DataFrame:
    """(leader, doc_id, room, e, diff, m0, m1, ...) of ends(leader, doc_id).

    room is the part of the leader's shingles that e_u and e_v may exceed in sum without anything in common; diff holds a
    hash for each occurrence in R and A, and m0, m1, ... is its bitmap.
    """

    def occurrences(kinds, count, side):
        occurrence = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return combine(np.repeat(kinds, count), (2 * occurrence + side).astype(np.uint64))

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            room, e, diff, bits = np.zeros(n), np.zeros(n), [], np.zeros((n, MAPS), np.uint64)
            for k, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                kinds, at = np.unique(np.concatenate([x, y]), return_inverse=True)
                more = np.bincount(at[len(x) :], minlength=len(kinds)) - np.bincount(at[: len(x)], minlength=len(kinds))
                gone, new = occurrences(kinds, np.maximum(-more, 0), 0), occurrences(kinds, np.maximum(more, 0), 1)
                room[k], e[k] = (1 - 2 * COMMON) * len(x), (1 - COMMON) * len(gone) + COMMON * len(new)
                both = np.concatenate([gone, new])
                diff.append(both.tobytes())
                np.bitwise_or.at(bits[k], ((both >> np.uint64(6)) % np.uint64(MAPS)).astype(np.int64), np.uint64(1) << (both & np.uint64(63)))
            maps = [pa.array(np.ascontiguousarray(bits[:, k]).view(np.int64)) for k in range(MAPS)]
            yield pa.RecordBatch.from_arrays([batch.column("leader"), batch.column("doc_id"), pa.array(room), pa.array(e), pa.array(diff, pa.binary()), *maps], names=["leader", "doc_id", "room", "e", "diff", *MAP_NAMES])

    left = ends.join(bags.select(F.col("doc_id").alias("leader"), F.col("bag").alias("x")).hint("merge"), "leader")
    both = left.join(bags.select("doc_id", F.col("bag").alias("y")).hint("merge"), "doc_id")
    return both.select("leader", "doc_id", "x", "y").mapInArrow(run, "leader long, doc_id long, room double, e double, diff binary" + "".join(f", {m} long" for m in MAP_NAMES))


def caps(diffs: DataFrame) -> DataFrame:
    """(leader, doc_id, room, e, cap, spare, m0, m1, ...).

    A text can link only to texts v with e_v <= cap and e <= cap_v; spare is how many differences its bitmap hides.
    """

    def explode(batches):
        for batch in batches:
            for leader, doc, diff in zip(batch.column("leader").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("diff").to_pylist()):
                h = np.frombuffer(diff, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), leader)), pa.array(np.full(len(h), doc)), pa.array(h)], names=["leader", "doc_id", "h"])

    rows = diffs.select("leader", "doc_id", "diff").mapInArrow(explode, "leader long, doc_id long, h long")
    own = rows.groupBy("leader", "h").agg(F.count("*").alias("df"), F.min("doc_id").alias("doc_id")).where("df = 1")
    own = own.groupBy("leader", "doc_id").agg(F.count("*").alias("own"))
    size = F.length("diff") / 8
    cap = size - F.coalesce("own", F.lit(0)) + F.col("room") - F.col("e") + 1e-6
    spare = size - sum(F.bit_count(m) for m in MAP_NAMES)
    return diffs.join(own.hint("merge"), ["leader", "doc_id"], "left").select("leader", "doc_id", "room", "e", cap.alias("cap"), spare.alias("spare"), *MAP_NAMES)


def _large(texts: DataFrame) -> DataFrame:
    """(doc_id, ..., key, n): a row for each large bucket of each text."""
    rows = texts.withColumn("__b", F.explode("buckets"))
    return rows.select(*[c for c in texts.columns if c != "buckets"], "__b.key", "__b.n").where(F.col("n") > SMALL)


def _split(texts: DataFrame, stars: DataFrame, leaders: DataFrame, limit: int) -> DataFrame:
    """(doc_id, root, key, main, leader, n) of the large buckets that hold several components; main is the largest one."""
    rooted = texts.select("doc_id", "buckets").join(stars.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left")
    large = _large(rooted.withColumn("root", F.coalesce("root", "doc_id")))
    count = large.groupBy("key", "root").agg(F.count("*").alias("size"))
    main = count.groupBy("key").agg(F.max(F.struct("size", "root")).getField("root").alias("main"), F.count("*").alias("roots")).where("roots > 1")
    groups = leaders.join(main.select("key", "main").hint("merge"), "key").select("key", "main", "leader", "n")
    return by_group(large.select("doc_id", "root", "key"), groups, "key", "n", limit)


BOUNDS = ["room", "e", "cap", "spare", *MAP_NAMES]


def _open(split: DataFrame, bounds: DataFrame, limit: int) -> DataFrame:
    """The rows of split that may have a link to another component: doc_id, key, root, out, partner, n and BOUNDS.

    `out` marks texts outside the main component that some text may link to, `partner` all that one of them may link to.
    """
    rows = split.where("doc_id <> leader").join(bounds.hint("merge"), ["leader", "doc_id"]).withColumn("away", F.col("root") != F.col("main"))
    away = lambda c: F.when(F.col("away"), F.col(c))
    reach = rows.groupBy("key").agg(F.max("cap").alias("far"), F.min("e").alias("near"), F.max(away("cap")).alias("far_out"), F.min(away("e")).alias("near_out"), F.count("*").alias("members"))
    rows = by_group(rows.select("doc_id", "key", "root", "away", "n", *BOUNDS), reach.where("far_out is not null"), "key", "members", limit)
    rows = rows.withColumn("out", F.col("away") & (F.col("e") <= F.col("far")) & (F.col("cap") >= F.col("near")))
    rows = rows.withColumn("partner", (F.col("e") <= F.col("far_out")) & (F.col("cap") >= F.col("near_out")))
    return rows.where("out or partner").select("doc_id", "key", "root", "out", "partner", "n", *BOUNDS)


def _rest(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows from `_open` that may be links, each once: from the first bucket that both have.

    Rows of large buckets are dealt to several tasks: texts outside by a salt, their partners to each of the salts.
    """
    texts = rows.groupBy("doc_id", "root").agg(F.sort_array(F.collect_list("key")).alias("keys"), F.collect_list(F.struct("key", "out", "partner", "n", *BOUNDS)).alias("b"))  # as many as there are bands at most
    rows = texts.withColumn("b", F.explode("b")).select("doc_id", "root", "keys", "b.*").withColumn("salts", F.greatest(F.lit(1), F.col("n").cast("int") / SALTED).cast("int"))
    left = rows.where("out").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"))
    right = rows.where("partner").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    one = lambda x: [F.col(c).alias(f"{x}_{c}") for c in ("key", "salt", "keys", "doc_id", "root", *BOUNDS)]
    need = F.col("x_e") + F.col("y_e") - F.col("x_room") - 1e-6
    bits = sum(F.bit_count(F.col(f"x_{m}").bitwiseAND(F.col(f"y_{m}"))) for m in MAP_NAMES)
    may = (F.col("x_key") == F.col("y_key")) & (F.col("x_salt") == F.col("y_salt")) & (F.col("x_root") != F.col("y_root"))
    may = may & (F.col("x_e") <= F.col("y_cap")) & (F.col("y_e") <= F.col("x_cap")) & (bits + F.least("x_spare", "y_spare") >= need)
    may = may & (F.array_min(F.array_intersect("x_keys", "y_keys")) == F.col("x_key"))
    found = left.select(*one("x")).hint("merge").join(right.select(*one("y")), may)
    pair = F.struct(F.least("x_doc_id", "y_doc_id").alias("a"), F.greatest("x_doc_id", "y_doc_id").alias("b"))
    return found.select(pair.alias("p")).select("p.*").distinct()


def _complete(texts: DataFrame, leaders: DataFrame, links: DataFrame, stars: DataFrame, bags: DataFrame, limit: int) -> DataFrame:
    """The components after all links inside large buckets are known."""
    split = materialize(_split(texts, stars, leaders, limit), "split")
    if split.isEmpty():
        return stars
    ends = split.where("doc_id <> leader").select("leader", "doc_id").distinct()
    bounds = materialize(caps(materialize(differences(ends, bags), "differences")), "caps")
    led = None
    for round_ in range(ROUNDS + 1):
        rows = materialize(_open(split, bounds, limit), "open")
        n = rows.count()
        if not n:
            return stars
        pairs = _rest(rows)
        if round_ == ROUNDS or pairs.count() <= SMALL * n:
            break
        outs = rows.where("out").select("doc_id", "key", "cap")
        fresh = outs if led is None else outs.join(led, [outs["key"] == led["led_key"], outs["doc_id"] == led["led"]], "left_anti")
        elected = fresh.groupBy("key").agg(F.max(F.struct("cap", (-F.col("doc_id")).alias("minus"))).alias("top"))
        sizes = outs.groupBy("key").agg(F.count("*").alias("n"))
        elected = materialize(elected.join(sizes.hint("merge"), "key").select("key", (-F.col("top.minus")).alias("leader"), "n"), "elected")
        now = elected.select(F.col("key").alias("led_key"), F.col("leader").alias("led"))
        led = now if led is None else led.union(now)
        tried = by_group(outs, elected, "key", "n", limit).where("doc_id <> leader")
        new = materialize(verify(tried.select(F.least("doc_id", "leader").alias("a"), F.greatest("doc_id", "leader").alias("b")).distinct(), bags), "links")
        if not new.isEmpty():
            links = links.union(new)
            stars = components(links)
            split = materialize(_split(texts, stars, leaders, limit), "split")
    return components(links.union(materialize(verify(pairs, bags), "links")))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, kept.

    class_id is the least id of the class; classes are the connected components of the links between texts with a
    weighted Jaccard similarity of SIMILARITY or more over five-word shingles in lower-case A-Z.  Texts with the same
    words are one class, so all null and empty texts are one; texts under five words have one shingle.  The row with the
    id class_id stays.  Rows repeated with one id share their fate if their texts do; ids should identify texts.  Null ids
    are not linked: class_id is null and the row is kept.  Other columns are not read.  An empty table gives an empty
    result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = rows.where("doc_id is not null")
    sketch = materialize(map_texts(known, "text", "doc_id long, digest binary, bands array<long>", _sketch), "sketch")
    base = sketch.select("doc_id", "digest")
    n = base.count()
    limit = n * BANDS // HEAVY
    same = materialize(base.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "same")
    first = same.select(F.col("digest").alias("d"), "keep_id").hint("merge")
    alone = sketch.join(first, (F.col("doc_id") == F.col("keep_id")) & (F.col("digest") == F.col("d")), "left_semi")
    rows_ = alone.select("doc_id", F.explode("bands").alias("key"))
    sizes = rows_.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = by_group(rows_, sizes, "key", "n", limit)
    texts = materialize(buckets.groupBy("doc_id").agg(F.collect_set(F.struct("key", "n")).alias("buckets"), F.sum("n").alias("weight")), "texts")  # as many as there are bands at most

    small = texts.select("doc_id", F.explode("buckets").alias("b")).where(F.col("b.n") <= SMALL).groupBy("b.key").agg(F.collect_list("doc_id").alias("docs"))
    large = _large(texts)
    leaders = large.groupBy("key").agg(F.max(F.struct("weight", (-F.col("doc_id")).alias("minus"))).alias("top"), F.count("*").alias("n"))
    leaders = materialize(leaders.select("key", (-F.col("top.minus")).alias("leader"), "n"), "leaders")
    led = by_group(large.select("doc_id", "key"), leaders, "key", "n", limit).where("doc_id <> leader")
    pairs = small.select("docs").mapInArrow(_pairs, "a long, b long")
    pairs = pairs.union(led.select(F.least("doc_id", "leader").alias("a"), F.greatest("doc_id", "leader").alias("b"))).distinct()

    bags = materialize(map_texts(known.join(sized(texts.select("doc_id")), "doc_id", "left_semi"), "text", "doc_id long, bag binary", _multisets), "bags")
    links = materialize(verify(pairs, bags), "links")
    stars = _complete(texts, leaders, links, components(links), bags, limit)

    rooted = same.join(stars.withColumnRenamed("node", "keep_id"), "keep_id", "left")
    rooted = rooted.select("digest", F.coalesce("root", "keep_id").alias("keep_id"), "group_size")
    found = attach(base, rooted, n).select("doc_id", F.col("keep_id").alias("class_id"), (F.col("doc_id") == F.col("keep_id")).alias("kept"))
    return found.unionByName(rows.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept")))
