"""Deduplication and upsert by one or several keys, anti-joins with what was seen before, and duplicate reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import normalize_url
from .linking import components, key_edges, label
from .ordered import running
from .skew import unique_join

#: Rows that one scan of components should have, and rounds before what is left is scanned by components; that comes sooner
#: where a round decides less than 1/FEW of the rows, as in long chains whose rows depend each on the one before.
SCAN_ROWS, ROUNDS, FEW = 20_000, 40, 20


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by `order`; rows with a null or empty key all stay.

    The winner is an aggregate with partial sums, so a key that holds a third of all rows is no hot group; the second step
    is a semi-join on (key, order).
    """
    keyed = df.where(F.coalesce(key, F.lit("")) != "")
    first = keyed.groupBy(F.col(key).alias("__key")).agg(F.min(order).alias("__order"))
    winners = keyed.join(first, (F.col(key) == F.col("__key")) & (F.col(order) == F.col("__order")), "left_semi")
    return winners.unionByName(df.where(F.coalesce(key, F.lit("")) == ""))


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by `order`, nulls and all; rows with a null or empty key are rejected."""
    keyed = df.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    last = keyed.groupBy(F.col(key).alias("__key")).agg(F.max(order).alias("__order"))
    return keyed.join(last, (F.col(key) == F.col("__key")) & (F.col(order) == F.col("__order")), "left_semi")


def upsert(stored: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """`stored` with the last new row of each key in place of what it had."""
    latest = last_wins(new, key, order)
    return stored.join(latest.select(key), key, "left_anti").select(stored.columns).unionByName(latest.select(stored.columns))


def unseen(df: DataFrame, seen: DataFrame, *keys: str) -> DataFrame:
    """Rows none of whose keys is among the identifiers of seen(id)."""
    for k in keys:
        df = df.join(seen.select(F.col("id").alias(f"__{k}")), F.col(k) == F.col(f"__{k}"), "left_anti")
    return df


def before_visit(urls: DataFrame, seen_urls: DataFrame, seen_ids: DataFrame) -> DataFrame:
    """urls(cell_id, url, place_id, ...) with `visit` and `duplicate`: those whose normalised URL and place id are both new.

    seen_urls(id) and seen_ids(id) may hold an id more than once.  `duplicates_skipped` of a cell is the sum of `duplicate`.
    """
    known = lambda ids, name: ids.select(F.col("id").alias(name)).distinct()
    rows = urls.withColumn("__u", normalize_url(F.col("url")))
    rows = rows.join(known(seen_urls, "__su"), F.col("__u") == F.col("__su"), "left").join(known(seen_ids, "__si"), F.col("place_id") == F.col("__si"), "left")
    duplicate = F.col("__su").isNotNull() | (F.col("__si").isNotNull() & (F.col("place_id") != ""))
    return rows.withColumns({"visit": ~duplicate, "duplicate": duplicate.cast("int")}).drop("__u", "__su", "__si")


def secondary_duplicates(df: DataFrame, most: int = 3) -> DataFrame:
    """Pairs of rows with the same phone or web site under different place ids: `most` matches of each row, by place id.

    Two equi-joins instead of one join on OR.  A limit per row is the feature: as no more than `most` ids other than its own
    can count for a row, each key's side holds the `most` + 1 least ids, which Spark also limits before its shuffle.
    """
    keyed = df.where(F.coalesce("place_id", F.lit("")) != "")
    pairs = None
    for k in ("phone", "website"):
        side = keyed.where(F.coalesce(k, F.lit("")) != "")
        left = side.select("seq", "place_id", F.col(k).alias("__k"))
        least = F.row_number().over(Window.partitionBy("__k").orderBy("other_id"))
        right = side.select(F.col("place_id").alias("other_id"), F.col(k).alias("__k")).distinct()
        right = right.withColumn("__n", least).where(F.col("__n") <= most + 1).drop("__n")
        found = left.join(right, "__k").where("place_id <> other_id").select("seq", "place_id", "other_id")
        pairs = found if pairs is None else pairs.union(found)
    rank = F.row_number().over(Window.partitionBy("seq").orderBy("other_id"))
    return pairs.distinct().withColumn("n", rank).where(F.col("n") <= most)


def _labels(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with `component`: the least `seq` of the rows that share keys, over chains of keys."""
    return label(df, keys)


def _bucket(labelled: DataFrame) -> Column:
    """A number for each component.  Components share no keys, so those of one number can be scanned as one."""
    return F.pmod(F.xxhash64("component"), F.lit(max(8, -(-labelled.count() // SCAN_ROWS)))).alias("bucket")


def greedy_dedup(df: DataFrame, keys: list[str], scratch: str, scan_rows: int = SCAN_ROWS) -> DataFrame:
    """Sequential dedup in `seq` order: a row is dropped if any of its keys was registered by a kept row.

    A dropped row registers nothing.  Keys must be strings, '' for none.  A round keeps the rows that are the first
    undecided ones of all their keys, and drops the undecided rows that share a key with a kept one; no key's rows meet in
    one task.  At most `scan_rows` rows that are still undecided are scanned one after another.  If there are more after
    ROUNDS rounds, or when rounds decide few rows, as in very long chains, each connected component is scanned by itself.
    """
    df.sparkSession.sparkContext.setCheckpointDir(scratch)
    has = [F.coalesce(k, F.lit("")) != "" for k in keys]
    bare = df.where(~F.coalesce(F.greatest(*has, F.lit(False)), F.lit(False)))
    left = df.select("seq", *keys).where(F.greatest(*has, F.lit(False))).checkpoint()
    kept = left.select("seq").limit(0)
    before = None
    for _ in range(ROUNDS):
        if (n := left.count()) <= scan_rows or before and (before - n) * FEW < before:
            break
        before = n
        pairs = [F.when(h, F.struct(F.lit(i).alias("kind"), F.col(k).alias("value"))) for i, (k, h) in enumerate(zip(keys, has))]
        pairs = left.select("seq", F.filter(F.array(*pairs), lambda x: x.isNotNull()).alias("all"))
        first = pairs.select("seq", F.size("all").alias("keys"), F.explode("all").alias("key"))
        first = first.groupBy("key").agg(F.min(F.struct("seq", "keys")).alias("first"), F.count("*").alias("rows"))
        first = first.select("key", "first.*", "rows").checkpoint()
        won = first.groupBy("seq").agg(F.count("*").alias("of"), F.min("keys").alias("keys")).where(F.col("of") == F.col("keys")).select("seq").checkpoint()
        kept = kept.union(won).checkpoint()
        used = first.join(won, "seq", "left_semi").select(F.col("key.kind").alias("kind"), F.col("key.value").alias("value"), (F.col("rows") > n // 1000).alias("hot"))
        for i, k in enumerate(keys):
            of = used.where(F.col("kind") == i).select(F.col("value").alias("__k"), "hot")
            left = left.join(F.broadcast(of.where("hot")), F.col(k) == F.col("__k"), "left_anti")
            left = left.join(of.where("not hot"), F.col(k) == F.col("__k"), "left_anti")
        left = left.checkpoint()

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        seen, stays = [set() for _ in keys], []
        for row in pdf[keys].itertuples(index=False):
            dup = any(v and v in s for v, s in zip(row, seen))
            stays.append(not dup)
            if not dup:
                for v, s in zip(row, seen):
                    if v:
                        s.add(v)
        return pd.DataFrame({"seq": pdf["seq"][stays]})

    if left.count() > scan_rows:
        labelled = _labels(left.select("seq", *[F.coalesce(k, F.lit("")).alias(k) for k in keys]), keys)
        rest = labelled.groupBy(_bucket(labelled)).applyInPandas(scan, "seq long")
    else:
        rest = left.groupBy(F.lit(0).alias("all")).applyInPandas(scan, "seq long")
    return df.join(kept.union(rest), "seq", "left_semi").unionByName(bare)


KINDS = ("url", "phone", "name")


def clean_sheet(df: DataFrame, scratch: str, scan_rows: int = SCAN_ROWS) -> DataFrame:
    """Greedy dedup by url, phone, and name where both are missing; a later SENT duplicate takes the place of the kept row.

    Columns: seq, name, phone, url (strings, '' for none), sent.  Returns place (the seq of the place in the result) and
    seq (the row that stands there).  Replaced rows' keys stay registered, new ones are not, and a replacement also
    matches on the name alone; of several places the first is taken.

    Rows with a url or phone are deduplicated by these alone, since only rows without both ask for names; of the latter the
    first of a name stays if no kept row before it has that name.  Then `_replace` follows the SENT duplicates.
    """
    df.sparkSession.sparkContext.setCheckpointDir(scratch)
    rows = df.select("seq", *[F.coalesce(k, F.lit("")).alias(k) for k in KINDS], F.coalesce("sent", F.lit(False)).alias("sent")).checkpoint()
    keyed = (F.col("url") != "") | (F.col("phone") != "")
    kept = greedy_dedup(rows.where(keyed), ["url", "phone"], scratch, scan_rows).checkpoint()
    names = kept.where("name <> ''").groupBy("name").agg(F.min("seq").alias("__before"))
    first = rows.where(~keyed & (F.col("name") != "")).groupBy("name").agg(F.min("seq").alias("seq"))
    first = first.join(names, "name", "left").where("__before is null or seq < __before").select("seq")
    bare = rows.where(~keyed).join(first, "seq", "left_semi").unionByName(rows.where(~keyed & (F.col("name") == "")))
    places = kept.unionByName(bare).select("seq", *KINDS).checkpoint()
    sent = rows.where("sent").join(places, "seq", "left_anti").select("seq", *KINDS).checkpoint()
    return _replace(places, sent, scan_rows)


def _replace(places: DataFrame, sent: DataFrame, scan_rows: int) -> DataFrame:
    """(place, seq): what stands in each of the places after each row of `sent`, in order, has replaced the row at the first
    place that shares a key with it; both have seq, url, phone and name.

    A row that stands somewhere goes when the next row of `sent` that shares a key with it comes, unless an earlier place
    takes that one.  So for the first place of each connected component the pointers from row to next row are its history,
    followed to the end by pointer doubling.  A round settles these places and takes out the rows they took; what is left
    falls into smaller components.  A key links rows up to the last row of `sent` that has it only.  The last `scan_rows`
    rows are replayed in one task; components of many places that compete for the same rows settle one place a round, so when
    rounds settle few rows each component is replayed by itself.
    """
    before = None
    done = places.select(F.col("seq").alias("place"), "seq").limit(0)
    while True:
        if sent.isEmpty():
            return done.unionByName(places.select(F.col("seq").alias("place"), "seq"))
        nodes = places.withColumn("asks", F.lit(False)).unionByName(sent.withColumn("asks", F.lit(True)))
        keys = F.array(*[F.when(F.col(k) != "", F.concat(F.lit(k + ":"), k)) for k in KINDS])
        lists = nodes.select("seq", "asks", F.explode(F.filter(keys, lambda x: x.isNotNull())).alias("key"))
        last = lists.where("asks").groupBy("key").agg(F.max("seq").alias("__last"))
        lists = unique_join(lists, last, "key").where("seq <= __last").drop("__last").checkpoint()
        label_ = components(key_edges(lists, "key", "seq")).checkpoint()
        linked = nodes.join(label_.withColumnRenamed("node", "seq"), "seq")
        heads = linked.groupBy("component").agg(F.min(F.when(~F.col("asks"), F.col("seq"))).alias("place")).where("place is not null").checkpoint()
        linked = unique_join(linked, heads, "component").checkpoint()  # components without a place drop out: nothing is there to replace
        alone = places.join(linked, "seq", "left_anti").select(F.col("seq").alias("place"), "seq")
        done = done.unionByName(alone).checkpoint()
        some = linked.select("seq", *KINDS, "asks")
        n = linked.count()
        if n <= scan_rows or before and (before - n) * FEW < before:
            bucket = F.lit(0).alias("bucket") if n <= scan_rows else _bucket(linked)
            return done.unionByName(linked.select(*some.columns, bucket).groupBy("bucket").applyInPandas(_replay, "place long, seq long"))
        before = n
        chain = lists.join(linked.where(F.col("asks") | (F.col("seq") == F.col("place"))).select("seq"), "seq", "left_semi")
        after = running(chain, "key", "seq", "asks", descending=True).where("last is not null").groupBy("seq").agg(F.min("last").alias("next"))
        jump = after.checkpoint()
        path = heads.select("place", F.col("place").alias("seq"))
        while not jump.isEmpty():
            path = path.unionByName(path.join(jump, "seq").select("place", F.col("next").alias("seq"))).checkpoint()
            jump = jump.join(jump.select(F.col("seq").alias("next"), F.col("next").alias("__n")), "next").select("seq", F.col("__n").alias("next")).checkpoint()
        done = done.unionByName(path.groupBy("place").agg(F.max("seq").alias("seq"))).checkpoint()
        left = some.join(path.select("seq"), "seq", "left_anti").checkpoint()
        places, sent = (left.where(F.col("asks") == asks).drop("asks") for asks in (False, True))


def _replay(pdf: pd.DataFrame) -> pd.DataFrame:
    """(place, seq) after one row of `asks` after another: a bounded number of rows."""
    where: dict[tuple[str, str], set[int]] = {}  # places by the keys of the row that stands there now
    stands: dict[int, tuple] = {}
    for row in pdf.sort_values("seq").itertuples(index=False):
        own = [(k, v) for k in KINDS if (v := getattr(row, k))]
        place = min((p for key in own for p in where.get(key, ())), default=None) if row.asks else row.seq
        if place is None:
            continue
        for key in stands.get(place, (None, ()))[1]:
            where[key].discard(place)
        for key in own:
            where.setdefault(key, set()).add(place)
        stands[place] = (row.seq, own)
    return pd.DataFrame({"place": list(stands), "seq": [s for s, _ in stands.values()]}, dtype="int64")
