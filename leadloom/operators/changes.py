"""Change detection between stored versions of a table, and a history with the time for which each version of a record held.

Every version carries a digest per field.  Versions are merged on key and digests alone; values are read for the keys that
changed, which are few where a table is collected again and again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .dedup import last_wins

DIGESTS = "__digests"


def digests(fields: list[str]) -> Column:
    """An array of one 64-bit digest per field; null is unlike any value.  Digests are compared for one key and field only."""
    return F.array(*[F.xxhash64(F.col(f).isNull(), F.col(f)) for f in fields])


def version(df: DataFrame, key: str, fields: list[str], order: str | None = None) -> DataFrame:
    """(key, fields..., digests) of a snapshot; with `order` the last row of each key, else keys must be unique.

    Rows with a null or empty key are rejected.
    """
    if order:
        df = last_wins(df, key, order).dropDuplicates([key])
    return df.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").select(key, *fields, digests(fields).alias(DIGESTS))


def differences(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change, changed) of two versions: change is added, removed or changed; changed names the fields that differ.

    One full join of keys and digests.  Added and removed records have no list of fields.
    """
    a = old.select(F.col(key).alias("__a"), F.col(DIGESTS).alias("__da"))
    b = new.select(F.col(key).alias("__b"), F.col(DIGESTS).alias("__db"))
    both = a.join(b, F.col("__a") == F.col("__b"), "full")
    differ = F.filter(F.array(*[F.when(F.col("__da")[i] != F.col("__db")[i], F.lit(f)) for i, f in enumerate(fields)]), lambda x: x.isNotNull())
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.size(differ) > 0, "changed")
    out = both.select(F.coalesce("__a", "__b").alias(key), change.alias("change"), F.when(change == "changed", differ).alias("changed"))
    return out.where("change is not null")


def field_changes(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change, field, before, after): one row for each field of each changed record that differs, as text, and one
    with a null field for each record that was added or removed."""
    found = differences(old, new, key, fields)
    names = F.explode_outer("changed").alias("field")
    rows = found.select(key, "change", names)
    text = lambda df, name: df.select(F.col(key).alias(f"__{name}"), F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))]).alias(name))
    changed = rows.where("change = 'changed'")
    keys = found.where("change = 'changed'").select(key)
    few = lambda df: df.join(keys, key, "left_semi")
    before, after = text(few(old), "before"), text(few(new), "after")
    changed = changed.join(before, F.col(key) == F.col("__before")).join(after, F.col(key) == F.col("__after"))
    changed = changed.select(key, "change", "field", F.col("before")[F.col("field")].alias("before"), F.col("after")[F.col("field")].alias("after"))
    none = F.lit(None).cast("string")
    return changed.unionByName(rows.where("change <> 'changed'").select(key, "change", "field", none.alias("before"), none.alias("after")))


def change_summary(changes: DataFrame) -> DataFrame:
    """(change, field, records) of `field_changes`."""
    return changes.groupBy("change", "field").agg(F.count("*").alias("records"))


def advance(history: DataFrame | None, snapshot: DataFrame, key: str, fields: list[str], at: Column) -> tuple[DataFrame, DataFrame]:
    """(records that end at this snapshot, records that hold from now on) after merging a version into those that held.

    history(key, fields..., digests, valid_from, valid_to) has the open records, with a null valid_to.  A record that is
    unchanged keeps its valid_from; one that changed or is gone ends `at` the snapshot; closed records are never read again.
    """
    start = snapshot.withColumns({"valid_from": at, "valid_to": F.lit(None).cast("timestamp")})
    if history is None:
        return start.limit(0), start
    found = differences(history, snapshot, key, fields).select(key, "change")
    gone = history.join(found.where("change <> 'added'"), key, "left_semi").withColumn("valid_to", at)
    stays = history.join(found.where("change <> 'added'"), key, "left_anti")
    fresh = start.join(found.where("change <> 'removed'"), key, "left_semi")
    return gone.select(start.columns), stays.select(start.columns).unionByName(fresh)


class History:
    """A history stored under a folder: open records by version, and the records that each version closed.

    Version n is written to closed/version=n and then open/version=n, so the greatest open version is the state; a version
    that failed half-way is written again in full.  Only open records are read by the next version.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, fields: list[str]):
        self.spark, self.path, self.key, self.fields = spark, path.rstrip("/"), key, fields

    def _read(self, part: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{part}")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        return None

    def last_version(self) -> int:
        """0 before the first version."""
        open_ = self._read("open_versions")
        return 0 if open_ is None else open_.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def open(self, number: int | None = None) -> DataFrame | None:
        number = self.last_version() if number is None else number
        return self._read(f"open/version={number}") if number else None

    def add(self, snapshot: DataFrame, at: Column, order: str | None = None) -> int:
        """Merge a snapshot that was taken `at` a time; returns its version."""
        last = self.last_version()
        ended, now = advance(self.open(last), version(snapshot, self.key, self.fields, order), self.key, self.fields, at)
        ended.write.mode("overwrite").parquet(f"{self.path}/closed/version={last + 1}")
        now.write.mode("overwrite").parquet(f"{self.path}/open/version={last + 1}")
        self.spark.range(1).select(F.lit(last + 1).alias("version")).write.mode("append").parquet(f"{self.path}/open_versions")
        return last + 1

    def table(self) -> DataFrame:
        """All records, with the time for which each held; valid_to is null for those that still do."""
        last = self.last_version()
        closed = self._read("closed").where(F.col("version") <= last).drop("version", DIGESTS)
        return self.open(last).drop(DIGESTS).unionByName(closed)

    def as_of(self, at: Column) -> DataFrame:
        """The records that held at a time."""
        return self.table().where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))
